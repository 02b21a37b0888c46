"""Mix sources to target weights by Pareto order sampling. DataFrame and SQL functions only.

A source of size S with target t takes t / S copies of each document: the whole part is certain,
the rest is a sample. For it documents are ranked by their random odds u / (1 - u) divided by
their inclusion odds p / (1 - p), and the lowest ranks fill what the source still lacks. The
sample is fixed in words: it ends at the rank that would pass the remainder, and one further
document, the one nearest to the words that still lack, closes the gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkspark.llm.shared import fresh, lookup_join, materialise, scratch

#: Copies of one document, and multiples of a source's size, at most.
MOST = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Ranks are dealt into 2 ** DIGIT_BITS cells, and the cell at the boundary into as many again.
DIGIT_BITS = 12
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_order(sources: DataFrame, key: str) -> DataFrame:
    """`sources` with `place`, its position by code point from 0, nulls last. No task holds all of them."""
    dealt = sources.repartitionByRange(F.col(key).asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "sources")
    before = dealt.groupBy("_part").count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_last())) - 1
    return dealt.withColumn("_local", local).join(before.select("_part", "_before"), "_part").withColumn("place", F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def source_targets(sized: DataFrame, source: str = "source", size: str = "size", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source, n_docs, source_size, place, weight, target.

    Targets share all sizes by weight; one above `most` times its source's size stops there and
    the excess is reshared by weight until none is above. Sources without words have target 0.
    """
    sources = sized.groupBy(source).agg(F.count("*").alias("n_docs"), F.sum(size).alias("source_size"))
    table = source_order(sources, source)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    table = materialise(table.withColumn("weight", weight), "weights")
    limit = F.col("source_size").cast("double") * most
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:  # each pass stops at least one more source, or ends
        full = limit <= F.col("weight") * level
        row = table.agg(F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).first()
        if row[2] == stopped or not row[1]:
            break
        stopped = row[2]
        level = (total - row[0]) / row[1]
    return table.withColumn("target", F.least(limit, F.col("weight") * level))


def mix_counts(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 17, weights=WEIGHTS, importance: str | None = None) -> DataFrame:
    """One row per row of `df`: doc_id, size, source_size, target, taken (words), copies.

    `size` counts words, null texts having none. `importance`, a positive column, scales the
    copies of documents within a source. The draw depends on id, source, size and seed only, so
    reruns agree; repeated rows draw alike and count each for itself. Null ids and null sources
    are values like others (the null source is a source, last in order). An empty table gives
    no rows.
    """
    columns = [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.coalesce(F.col(importance).cast("double"), F.lit(1.0)).alias("importance") if importance else F.lit(1.0).alias("importance")]
    sized = materialise(df.select(*columns), "sizes")
    total = sized.count()
    targets = source_targets(sized)
    key = [F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("no_source")]
    means = sized.groupBy("source").agg(F.try_divide(F.sum(F.col("size") * F.col("importance")), F.sum("size")).alias("mean"))
    targets = targets.join(means, targets["source"].eqNullSafe(means["source"])).drop(means["source"])
    stats = targets.select(*key, "n_docs", "source_size", "target", "mean")
    spread = F.struct("doc_id", "size")
    docs = lookup_join(sized.select(*key, "doc_id", "size", "importance"), stats, ["source", "no_source"], "n_docs", total, spread)
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size") * F.col("importance") / F.col("mean"))).otherwise(0.0)
    docs = docs.withColumn("whole", F.floor(copies).cast("long")).withColumn("p", copies - F.floor(copies))
    u = (F.pmod(F.xxhash64(F.lit(seed), "source", "doc_id", "size"), F.lit(2**52)) + 0.5) / float(2**52)
    docs = docs.withColumn("_u", u).withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), F.expr("(_u / (1 - _u)) / (p / (1 - p))"))).drop("_u")
    docs = docs.withColumn("place", F.floor(F.col("rank") / (1 + F.col("rank")) * float(2 ** (2 * DIGIT_BITS))).cast("long"))
    docs = docs.withColumn("cell", F.shiftright("place", DIGIT_BITS).cast("int"))
    docs = materialise(docs, "ranked")
    by = ["source", "no_source"]
    base = docs.groupBy(*by).agg(F.sum(F.col("whole") * F.col("size")).alias("certain"), F.max("target").alias("target"))
    base = base.withColumn("lack", F.greatest(F.lit(0.0), F.col("target") - F.col("certain"))).select(*by, "lack")

    def boundary(cells: DataFrame, cell: str) -> DataFrame:
        """Of each source the first cell that would pass `lack`, and what lacks before it."""
        upto = F.sum("words").over(Window.partitionBy(*by).orderBy(cell))
        cells = cells.withColumn("upto", upto).filter(F.col("upto") > F.col("lack"))
        return cells.groupBy(*by).agg(F.min(F.struct(cell, (F.col("lack") - F.col("upto") + F.col("words")).alias("rest"))).alias("b")).select(*by, F.col(f"b.{cell}").alias(f"last_{cell}"), F.col("b.rest").alias("lack"))

    cells = docs.filter("rank is not null").groupBy(*by, "cell").agg(F.sum("size").alias("words"))
    coarse = materialise(boundary(cells.join(base, by), "cell"), "cells")
    inner = docs.filter("rank is not null").join(coarse.withColumn("cell", F.col("last_cell")), [*by, "cell"])
    fine = materialise(boundary(inner.groupBy(*by, "place", "lack").agg(F.sum("size").alias("words")), "place"), "places")
    edge = docs.filter("rank is not null").join(fine.withColumn("place", F.col("last_place")), [*by, "place"])
    order = Window.partitionBy(*by).orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.sum("size").over(order)).withColumn("n_upto", F.row_number().over(Window.partitionBy(*by).orderBy("rank", "doc_id", "size")))
    last = edge.groupBy(*by, "last_place", "lack").agg(F.coalesce(F.max(F.when(F.col("upto") <= F.col("lack"), F.struct("rank", "doc_id", "size", "upto"))), F.lit(None)).alias("e"))
    ends = last.select(*by, "last_place", F.col("e.rank").alias("last_rank"), F.col("e.doc_id").alias("last_id"), F.col("e.size").alias("last_size"), (F.col("lack") - F.coalesce("e.upto", F.lit(0))).alias("gap"))
    ends = materialise(ends, "ends")
    counts = targets.select(*key, "n_docs").join(ends, by, "left")
    seen = lookup_join(docs, counts.withColumnRenamed("n_docs", "rows"), by, "rows", total, spread)
    behind = (F.col("place") == F.col("last_place")) & F.coalesce(F.struct("rank", "doc_id", "size") <= F.struct(F.col("last_rank").alias("rank"), F.col("last_id").alias("doc_id"), F.col("last_size").alias("size")), F.lit(False))
    sampled = F.col("rank").isNotNull() & (F.col("last_place").isNull() | (F.col("place") < F.col("last_place")) | behind)
    seen = seen.withColumn("sampled", F.coalesce(sampled, F.lit(False)))
    closer = seen.filter("rank is not null and not sampled and size <= 2 * gap").groupBy(*by).agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("miss"), "rank", "doc_id", "size", "gap")).alias("c"))
    closer = closer.filter("c.miss < c.gap").select(*by, F.col("c.doc_id").alias("extra_id"), F.col("c.rank").alias("extra_rank"), F.col("c.size").alias("extra_size"))
    final = lookup_join(seen, targets.select(*key, F.col("n_docs").alias("rows2")).join(closer, by, "left"), by, "rows2", total, spread)
    extra = F.coalesce(F.col("doc_id").eqNullSafe(F.col("extra_id")) & (F.col("rank") == F.col("extra_rank")) & (F.col("size") == F.col("extra_size")), F.lit(False))
    taken = F.col("whole") + (F.col("sampled") | extra).cast("long")
    return final.select("doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "source_size", "target", (taken * F.col("size")).alias("taken"), taken.alias("copies"))


def mix(df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 17) -> DataFrame:
    """The rows of `df`, each as often as `mix_counts` takes it (0 to 3 times); columns stay.

    Rows that share an id, a source and a size are one draw; null ids and null sources are values
    like others. A document without words is taken as often as its source's whole copies say.
    """
    names = ["mix_id", "mix_no_id", "mix_source", "mix_no_source", "mix_size"]
    key, copies, rows, copy = [fresh(df, c) for c in names], fresh(df, "mix_copies"), fresh(df, "mix_rows"), fresh(df, "mix_copy")

    def keyed(frame: DataFrame, i: Column, s: Column, n: Column) -> DataFrame:
        i = i.cast("string")
        values = (F.coalesce(i, F.lit("")), i.isNull(), F.coalesce(s.cast("string"), F.lit("")), s.isNull(), n)
        return frame.withColumns(dict(zip(key, values, strict=True)))

    with scratch(df.sparkSession) as keep:
        counts = keyed(mix_counts(df, text, source, doc_id, seed), F.col("doc_id"), F.col("source"), F.col("size"))
        counts = keep(counts.groupBy(*key).agg(F.max("copies").alias(copies), F.count("*").alias(rows)), "copies")
    marked = keyed(df, F.col(doc_id), F.col(source), word_count(F.col(text)))
    total = counts.agg(F.sum(rows)).first()[0] or 0
    joined = lookup_join(marked, counts, key, rows, total, F.xxhash64(text)).filter(F.col(copies) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*df.columns)
