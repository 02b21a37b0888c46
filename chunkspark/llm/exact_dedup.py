"""Exact duplicates by a tree merge of sorted digest runs.

Every scan partition makes a run of digests, sorted, with copies merged. Runs then meet in
binomial rounds: run r goes to tree node r >> bits, where the runs that arrive are merged and of
each digest one row stays, with the verified identifier to keep and the number of copies. A slot
of leading digest bits has its own tree, so the last round is as wide as the slots and no task
holds all digests. A digest occurs once per run at most, so copies don't pile up in a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkspark.llm.shared import fresh, hashed_side, lookup_join, materialise, scratch
from chunkspark.llm.text import LOWER, blocks

#: Runs that merge in one round: 2 ** BITS.
BITS = 4
#: Leading digest bits that choose a tree.
SLOT_BITS = 16
RUN = "slot int, node int, digest binary, n_bytes long, id long, tag long, n long"


def _digests(column: str, lower: bool, names: list[str]):
    def run(batches):
        for batch in batches:
            for a, b, raw, offsets in blocks(batch.column(batch.schema.get_field_index(column))):
                view = memoryview(LOWER[raw] if lower else raw)
                digests = [hashlib.sha256(view[x:y]).digest() for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                own = [pa.array(digests, pa.binary()), pa.array(np.diff(offsets), pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *own], names=[*batch.schema.names, *names])

    return run


def with_digests(df: DataFrame, text: str, tag: str, digest: str, n_bytes: str, lower: bool = True) -> DataFrame:
    """`df` with a row tag, the SHA-256 of each normalised text and its length in bytes."""
    tagged = df.withColumn(tag, F.monotonically_increasing_id())
    schema = T.StructType([*tagged.schema.fields, T.StructField(digest, T.BinaryType()), T.StructField(n_bytes, T.LongType())])
    return tagged.mapInArrow(_digests(text, lower, [digest, n_bytes]), schema)


def _merge(batches):
    """Merge rows that arrive sorted by slot, node, digest, length, id and tag; the last of each digest stays."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if held is not None:
            held = pa.RecordBatch.from_arrays(held.columns, schema=batch.schema)
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if batch.num_rows == 0:
            continue
        col = dict(zip(batch.schema.names, batch.columns, strict=True))
        digests = np.frombuffer(b"".join(col["digest"].to_pylist()), dtype=np.uint64).reshape(-1, 4)
        new = np.any(digests[1:] != digests[:-1], axis=1)
        for c in ("slot", "node", "n_bytes"):
            x = col[c].to_numpy(zero_copy_only=False)
            new |= x[1:] != x[:-1]
        first = np.concatenate([[0], np.flatnonzero(new) + 1])
        last = np.concatenate([first[1:] - 1, [batch.num_rows - 1]])
        counts = np.add.reduceat(col["n"].to_numpy(zero_copy_only=False), first)
        out = batch.take(pa.array(last)).set_column(batch.schema.get_field_index("n"), "n", pa.array(counts, pa.int64()))
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def merge_runs(signatures: DataFrame, bits: int = BITS, keep: str = "largest") -> DataFrame:
    """One row per distinct digest: digest, n_bytes, id to keep, its tag, n copies.

    `signatures` has id, tag, digest, n_bytes; it must be materialised, since tags number the runs.
    """
    runs = signatures.select(
        F.conv(F.substring(F.hex("digest"), 1, SLOT_BITS // 4), 16, 10).cast("int").alias("slot"),
        F.shiftright("tag", 33).cast("int").alias("node"), "digest", "n_bytes", "id", "tag", F.lit(1).cast("long").alias("n"),
    )
    best_last = F.col("id").asc_nulls_first() if keep == "largest" else F.col("id").desc_nulls_first()
    order = ["slot", "node", "digest", "n_bytes", best_last, "tag"]
    out = runs.sortWithinPartitions(*order).mapInArrow(_merge, RUN)
    left = signatures.agg(F.max(F.shiftright("tag", 33))).first()[0] or 0
    while True:
        out = out.withColumn("node", F.shiftright("node", bits))
        out = out.repartition("slot", "node").sortWithinPartitions(*order).mapInArrow(_merge, RUN)
        left >>= bits
        if left == 0:
            break
    return out.select("digest", "n_bytes", F.col("id").alias("keep_id"), F.col("tag").alias("keep_tag"), F.col("n").alias("group_size"))


def duplicate_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id", lower: bool = True, keep: str = "largest") -> DataFrame:
    """One row per row of `df`: doc_id, keep_id, group_size, kept, digest.

    Texts are equal if identical after lower-casing A-Z (`lower`); null counts as empty. Of equal
    texts the row with the largest (or smallest) id stays; a null id ranks below all others and
    of rows with one id the last in scan order stays, so exactly one row of a group is kept. An
    empty table gives no rows; other columns are ignored.
    """
    slim = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    signatures = materialise(with_digests(slim, "text", "tag", "digest", "n_bytes", lower).drop("text"), "digests")
    return groups_of(signatures, keep).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "digest")


def groups_of(signatures: DataFrame, keep: str = "largest") -> DataFrame:
    """Signature rows (id, tag, digest, n_bytes) with keep_id, group_size and kept."""
    winners = materialise(merge_runs(signatures, keep=keep).filter("group_size > 1"), "winners")
    total = signatures.count()
    found = lookup_join(signatures, winners, ["digest", "n_bytes"], "group_size", total, F.col("tag"))
    return found.select(
        "id", "tag", "digest",
        F.when(F.col("keep_tag").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_tag") == F.col("tag"), F.lit(True)).alias("kept"),
    )


def drop_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", lower: bool = True, keep: str = "largest") -> DataFrame:
    """The rows of `df` that `duplicate_groups` keeps, with all their columns.

    Rows to drop are found by id and digest; texts are read a second time and not stored. Of equal
    texts under one id any one row stays.
    """
    key, tag, digest, n_bytes = (fresh(df, c) for c in ("row_key", "row_tag", "row_digest", "row_bytes"))
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("none"))
    with scratch(df.sparkSession) as keep_table:
        slim = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
        signatures = materialise(with_digests(slim, "text", "tag", "digest", "n_bytes", lower).drop("text"), "digests")
        found = groups_of(signatures, keep).select(F.coalesce(F.col("id").cast("string"), F.lit("none")).alias(key), F.col("digest").alias(digest), "kept")
        by_row = found.groupBy(key, digest).agg(F.count_if("kept").alias("n_kept"), F.count("*").alias("n")).filter("n > n_kept")
        changed = keep_table(by_row, "changed")
    gone = changed.filter("n_kept = 0").select(key, digest)
    some = changed.filter("n_kept > 0").select(key, digest)  # rows repeated under one id, of which one stays
    rows = with_digests(df, text, tag, digest, n_bytes, lower).withColumn(key, name)
    n = changed.count()
    out = rows.join(hashed_side(gone, n), [key, digest], "left_anti")
    if some.take(1):
        out = out.join(hashed_side(some, n), [key, digest], "left_anti").unionByName(rows.join(hashed_side(some, n), [key, digest], "left_semi").dropDuplicates([key, digest]))
    return out.select(*df.columns)
