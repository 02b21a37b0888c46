"""From assets to chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chunkspark.functions.text import location
from chunkspark.schema import CODE_CHUNK


#: Characters of sources that are parsed at a time; a longer file is parsed alone.
CHARACTERS = 1 << 20
#: Files that are parsed at a time, and chunks that are handed on at a time.
FILES, CHUNKS = 256, 1024


def parse_assets(assets: DataFrame) -> DataFrame:
    """Chunks of `assets` (id, domain_id, file_path, language, source), one row each; a file's faults give it none.

    A task holds the sources and chunks of a few files at a time, however many rows Spark sends together.
    """
    schema = T.StructType([*CODE_CHUNK.fields, T.StructField("domain_id", T.StringType())])
    kind = to_arrow_schema(schema)
    return assets.select("id", "domain_id", "file_path", "language", "source").mapInArrow(lambda batches: parsed(batches, kind), schema)


def _few(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of FILES files and CHARACTERS characters at most."""
    first = total = 0
    for i, size in enumerate(pc.fill_null(pc.utf8_length(batch.column("source")), 0).to_pylist()):
        if i > first and (total + size > CHARACTERS or i - first == FILES):
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if first < batch.num_rows:
        yield batch.slice(first)


def parsed(batches: Iterable[pa.RecordBatch], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The chunks of batches of assets, at most CHUNKS in a batch."""
    from chunkspark.chunkers import CHUNKERS

    for part in (x for whole in batches for x in _few(whole)):
        rows = []
        for asset, domain, path, language, source in zip(*(part.column(c).to_pylist() for c in ("id", "domain_id", "file_path", "language", "source")), strict=True):
            try:
                found = CHUNKERS.get(language)(source)
            except Exception:  # one bad file must not end the scan  # noqa: BLE001
                found = []
            lines = Counter((c.start_line, c.end_line) for c in found)
            for i, c in enumerate(found):
                row = c.row(asset, i, path, lines[c.start_line, c.end_line] > 1) | {"domain_id": domain}
                row["metadata"]["language_specific"] = list(row["metadata"]["language_specific"].items())
                rows.append(row)
                if len(rows) == CHUNKS:
                    yield pa.RecordBatch.from_pylist(rows, kind)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


def wrap_chunks(parsed: DataFrame) -> DataFrame:
    """Chunk rows: id path:start-end with the ordinal added where declarations share their lines, and meta as JSON."""
    loc = location(F.col("asset_id"), F.col("location.start_line"), F.col("location.end_line"))
    meta = F.to_json(F.struct("content", "location.file_path", "location.start_line", "location.end_line", F.col("name").alias("chunk_name"), "docstring"))
    return parsed.select(F.when(F.col("shares_lines"), F.concat(loc, F.lit("#"), F.col("ordinal").cast("string"))).otherwise(loc).alias("id"), "asset_id", "domain_id", "content", meta.alias("meta"))


def line_chunks(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """asset_id, chunk_id, content: each line of a document is a chunk."""
    lines = documents.select(F.col(doc_id).cast("string").alias("asset_id"), F.posexplode(F.split(text, "\n", -1)).alias("line", "content"))
    return lines.select("asset_id", location(F.col("asset_id"), F.col("line"), F.col("line")).alias("chunk_id"), "content")

