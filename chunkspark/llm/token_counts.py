"""Token counts of documents in flat token files that have no index.

A token file is the documents' ids one after another, each document ended by a separator. Files
are cut into blocks without regard to documents; each block is searched for separators at once,
and a prefix scan over the blocks of a file gives each block the number of documents and the
length of the unfinished one before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkspark.llm.files import create, open_random, size_of, task_file
from chunkspark.llm.shared import materialise, new_folder, spread
from chunkspark.llm.text import blocks
from chunkspark.llm.tokens import encoder

#: Bytes of an id in files by `word_bpe_49k.json`, and of a block.
WIDTH = 2
BLOCK_BYTES = 1 << 22
#: End of a document in files by `word_bpe_49k.json`.
SEPARATOR = 49407
MANIFEST = "file string, place long, doc_id long"
SUMMARY = "file string, block long, first_id long, n_ids long, lengths array<long>, tail long"


def _written(path: str, folder: str, separator: int, width: int):
    def run(batches):
        code = encoder(path, special=False)
        kind = np.dtype(f"<u{width}")
        if separator > np.iinfo(kind).max:
            raise ValueError(f"separator {separator} does not fit in {width} bytes")
        name, out, n = None, None, 0
        for batch in batches:
            for a, b, raw, offsets in blocks(batch.column(1)):
                if out is None:
                    name = task_file(folder, "tokens")
                    out = create(name)
                ids, bounds = code.encode(raw, offsets)
                if len(ids) and int(ids.max()) > np.iinfo(kind).max:
                    raise ValueError(f"id {int(ids.max())} does not fit in {width} bytes")
                flat = np.insert(ids.astype(kind), bounds[1:], kind.type(separator))
                out.write(flat)
                m = b - a
                yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(np.arange(n, n + m)), batch.column(0).slice(a, m)], names=["file", "place", "doc_id"])
                n += m
        if out is not None:
            out.close()

    return run


def write_token_files(df: DataFrame, path: str, folder: str, text: str = "text", doc_id: str = "doc_id", separator: int = SEPARATOR, width: int = WIDTH) -> DataFrame:
    """Write each partition's documents to one file; returns which document is where (MANIFEST).

    Special tokens' strings in texts are ordinary text, so the separator ends documents only. Ids
    that don't fit in `width` bytes are an error.
    """
    slim = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text))
    return materialise(slim.mapInArrow(_written(path, folder, separator, width), MANIFEST), "manifest")


def _sized(width: int, block: int):
    def run(batches):
        for batch in batches:
            files, first, last = [], [], []
            for name in batch.column(0).to_pylist():
                n = size_of(name)
                for at in range(0, n, block):
                    files.append(name)
                    first.append(at // width)
                    last.append(min(at + block, n) // width)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["file", "first_id", "end_id"])

    return run


def _searched(separator: int, width: int, block: int):
    def run(batches):
        for batch in batches:
            for name, first, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open_random(name) as f:
                    ids = np.frombuffer(f.read_at((end - first) * width, first * width), dtype=f"<u{width}")
                ends = np.flatnonzero(ids == separator)
                lengths = np.diff(ends, prepend=-1) - 1
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                columns = [pa.array([name]), pa.array([first * width // block]), pa.array([first]), pa.array([len(ids)]), pa.array([lengths], pa.list_(pa.int64())), pa.array([tail])]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SUMMARY.split(", ")])

    return run


def count_documents(files: DataFrame, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK_BYTES) -> DataFrame:
    """One row per document of the token files named in `files` (column `file`): file, place, n_tokens, ended.

    Places count from 0 in a file. Ids after the last separator are a document that has not ended;
    an empty file has none, and two separators in a row end an empty document.
    """
    assert block % width == 0
    found = files.select("file").distinct().mapInArrow(_sized(width, block), "file string, first_id long, end_id long")
    dealt = spread(materialise(found, "block_list"), "file", "first_id")
    summaries = materialise(dealt.mapInArrow(_searched(separator, width, block), SUMMARY), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("lengths")
    after_last = F.when(n > 0, F.col("first_id") + F.col("n_ids") - F.col("tail"))  # first id after the block's last separator
    carried = F.col("first_id") - F.coalesce(F.max(after_last).over(before), F.lit(0))
    placed = summaries.withColumn("done", F.coalesce(F.sum(n).over(before), F.lit(0))).withColumn("carried", carried)
    placed = placed.withColumn("last", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1)
    whole = placed.select("file", "done", "carried", F.posexplode("lengths").alias("i", "length"))
    whole = whole.select("file", (F.col("done") + F.col("i")).alias("place"), (F.col("length") + F.when(F.col("i") == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = placed.filter("last").select("file", (F.col("done") + n).alias("place"), (F.col("tail") + F.when(n == 0, F.col("carried")).otherwise(0)).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest.filter("n_tokens > 0"))


def id_width(path: str, separator: int) -> int:
    """Bytes that hold every id of a tokenizer and the separator: 1, 2, 4 or 8."""
    from tokenizers import Tokenizer

    most = max(separator, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())
    return next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)


def token_counts(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", separator: int = SEPARATOR, width: int | None = None) -> DataFrame:
    """One row per row of `df`: doc_id, n_tokens, counted in flat token files of the shared folder.

    Ids take `width` bytes, by default as many as the vocabulary needs; `separator` must not be an
    id of ordinary text. Null and empty texts have 0 tokens. Repeated rows and rows with null ids
    are counted each for itself; an empty table gives no rows.
    """
    folder = new_folder(df.sparkSession, "tokens")
    width = width or id_width(path, separator)
    manifest = write_token_files(df, path, folder, text, doc_id, separator, width)
    return manifest.join(count_documents(manifest, separator, width), ["file", "place"]).select("doc_id", "n_tokens")
