"""What changed between two scans, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkspark.operators.store import work_folder

KEY = ["domain_id", "id"]


def diff(stored: DataFrame, seen: DataFrame, key: list[str] = KEY, hash_col: str = "asset_hash") -> DataFrame:
    """key, state of every asset stored or seen: added, modified, deleted or unchanged. One full outer join."""
    old = stored.select(*key, F.col(hash_col).alias("_old"), F.lit(1).alias("_stored"))
    new = seen.select(*key, F.col(hash_col).alias("_new"), F.lit(1).alias("_seen"))
    state = (
        F.when(F.col("_stored").isNull(), "added")
        .when(F.col("_seen").isNull(), "deleted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("modified")
    )
    return old.join(new, key, "full_outer").select(*key, state.alias("state"))


def dirty(stored: DataFrame, seen: DataFrame, key: list[str] = KEY, hash_col: str = "asset_hash") -> DataFrame:
    """Assets seen that aren't stored, or are with another hash."""
    old = stored.select(*key, F.col(hash_col).alias("_old"))
    return seen.join(old, key, "left").filter(~F.col(hash_col).eqNullSafe(F.col("_old"))).drop("_old")


def deleted(stored: DataFrame, seen: DataFrame, key: list[str] = KEY) -> DataFrame:
    return stored.join(seen.select(*key).distinct(), key, "left_anti")


def with_chunks(assets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Assets that have a chunk."""
    return assets.join(chunks.select("domain_id", F.col("asset_id").alias("id")).distinct(), KEY, "left_semi")


def chunks_of(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    return chunks.join(assets.select("domain_id", F.col("id").alias("asset_id")).distinct(), ["domain_id", "asset_id"], "left_semi")


def with_places(rows: DataFrame, within: str, order: str, place: str = "place") -> DataFrame:
    """`rows` with their place from 0 in `order` among those of one `within`, nulls first. No task holds a whole group.

    Rows are dealt by range over both columns and written, each part counts its own, and prefix
    sums of the counts say how many of a group lie in the parts before. Ties go in any order.
    """
    folder = work_folder(rows.sparkSession, "places")
    dealt = rows.repartitionByRange(within, order).withColumn("_part", F.spark_partition_id())
    dealt.write.parquet(folder)
    dealt = rows.sparkSession.read.schema(dealt.schema).parquet(folder)
    key = F.coalesce(F.xxhash64(within), F.lit(0))  # only spreads groups; their values are compared below
    dealt = dealt.withColumn("_spread", key)
    sizes = dealt.groupBy("_part", "_spread", F.struct(within).alias("_group")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_spread", "_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_part", "_spread", "_group").orderBy(F.col(order).asc_nulls_first())) - 1
    placed = dealt.withColumn("_group", F.struct(within)).withColumn("_local", local)
    return placed.join(sizes, ["_part", "_spread", "_group"]).select(*rows.columns, (F.col("_local") + F.col("_before")).alias(place))


def batches(assets: DataFrame, order: str, size: int = 200) -> DataFrame:
    """`assets` with `batch`: floor of their place in `order`, by `size`, within their domain."""
    return with_places(assets, "domain_id", order, "_place").withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")


def counts(states: DataFrame) -> DataFrame:
    """found, dirty and deleted assets."""
    return states.agg(
        F.count_if(F.col("state") != "deleted").alias("found"),
        F.count_if(F.col("state").isin("added", "modified")).alias("dirty"),
        F.count_if(F.col("state") == "deleted").alias("deleted"),
    )
