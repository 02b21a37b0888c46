"""Similarity search: exact, batched, filtered, over several domains, and approximate."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkspark.functions import vectors as V

#: Queries of one block: as many are sent to every task at a time.
QUERY_BLOCK = 4096
#: So many distances a task holds at a time.
CELLS = 4_000_000


def vector_literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def nearest(store: DataFrame, query: Column, k: int = 10, metric: str = "l2", id_col: str = "id", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows with `dist` and `score` = 1 - dist; ties go to the smaller id.

    One scan, each task keeps k rows, no shuffle of the store.
    """
    dist = V.distance(F.col(embedding), query, metric)
    scored = store.withColumn("dist", dist).withColumn("score", V.score(F.col("dist")))
    return scored.orderBy(F.col("dist").asc_nulls_last(), id_col).limit(k)


def search(store: DataFrame, query: Column, k: int = 10, metric: str = "l2", where: Column | None = None, prefilter: bool = False, threshold: float | None = None, id_col: str = "id", embedding: str = "embedding") -> DataFrame:
    """`nearest` with a metadata filter before it, or after it so that fewer than k rows may come, and a score threshold."""
    rows = store.filter(where) if where is not None and prefilter else store
    out = nearest(rows, query, k, metric, id_col, embedding)
    if where is not None and not prefilter:
        out = out.filter(where)
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    kind = V.metric_of(metric)
    if kind == "l1":
        return np.stack([np.abs(x - v).sum(1) for v in q], axis=1)
    inner = x @ q.T
    if kind == "max_inner_product":
        return -inner
    xx, qq = (x * x).sum(1)[:, None], (q * q).sum(1)[None]
    if kind == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - inner / np.sqrt(xx * qq)
    return np.sqrt(np.maximum(xx + qq - 2 * inner, 0))


def batch_nearest(store: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2", id_col: str = "id", embedding: str = "embedding", query_id: str = "qid", query_vector: str = "qv", within: str | None = None, digits: int | None = None) -> DataFrame:
    """The k nearest rows of the store to each query: qid, id, dist, rk.

    Queries go to the tasks in blocks of QUERY_BLOCK. Each task multiplies matrices and keeps k
    rows per query, so only tasks x queries x k rows are shuffled. `within` names a column of the
    store: k rows are then kept for each of its values, which comes after qid. Distances that agree
    after rounding to `digits` are ties. A question without a vector finds nothing.
    """
    parts = []
    rows = queries.filter(F.col(query_vector).isNotNull()).select(query_id, query_vector).toLocalIterator()
    block: list = []
    key = ["qid"] if within is None else ["qid", "within"]

    def flush():
        ids, q = [r[0] for r in block], np.array([r[1] for r in block], dtype=np.float64)

        def run(batches):
            best: pd.DataFrame | None = None
            step = max(1, CELLS // max(1, len(ids)))
            for whole in batches:
                whole = whole[whole["v"].notna()]
                for at in range(0, len(whole), step):
                    pdf = whole.iloc[at : at + step]
                    d = _distances(np.stack(pdf["v"].to_numpy()).astype(np.float64), q, metric)
                    d = d if digits is None else np.round(d, digits) + 0.0
                    codes = pd.factorize(pdf["within"], use_na_sentinel=False)[0] if within else np.zeros(len(pdf), int)
                    found = [best] if best is not None else []
                    for own in np.split(np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes))[:-1]):
                        near = d[own]
                        # all that is as near as the k-th, which ties may make more than k; null distances compare as false
                        last = np.partition(near, k - 1, axis=0)[k - 1] if len(own) > k else np.full(near.shape[1], np.inf)
                        r, c = np.nonzero(near <= np.where(np.isnan(last), np.inf, last))
                        got = pdf.iloc[own[r]].drop(columns="v")
                        found.append(got.assign(qid=c, dist=near[r, c]))
                    best = pd.concat(found).sort_values([*key, "dist", "id"])
                    best = best.groupby(key, dropna=False, sort=False).head(k)
            if best is not None:
                best["qid"] = [ids[i] for i in best["qid"]]
                yield best[schema.names]

        slim = store.select(F.col(id_col).alias("id"), F.col(embedding).alias("v"), *([F.col(within).alias("within")] if within else []))
        schema = T.StructType([T.StructField("qid", queries.schema[query_id].dataType), *([T.StructField("within", store.schema[within].dataType)] if within else []), T.StructField("id", store.schema[id_col].dataType), T.StructField("dist", T.DoubleType())])
        parts.append(slim.mapInPandas(run, schema))

    for row in rows:
        block.append(row)
        if len(block) == QUERY_BLOCK:
            flush()
            block = []
    if block or not parts:
        flush()
    w = Window.partitionBy(*key).orderBy("dist", "id")
    out = reduce(DataFrame.unionByName, parts).withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
    return out.withColumnRenamed("within", within) if within else out


def over_domains(results: dict[str, DataFrame], rerank: bool = False, k: int | None = None) -> DataFrame:
    """Results of several domains one after another, or ranked together and cut at k."""
    out = reduce(DataFrame.unionByName, (df.withColumn("domain", F.lit(name)) for name, df in results.items()))
    if rerank:
        out = out.orderBy(F.desc("score"), "domain")
        out = out if k is None else out.limit(k)
    return out


def lsh_model(store: DataFrame, embedding: str = "embedding", bucket: float = 1.0, tables: int = 8, seed: int = 5):
    """A random-projection index of the store and its transformed rows (columns `features`, `hashes`).

    `bucket` is in units of the vectors' mean length, so that recall doesn't depend on their scale.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rows = store.withColumn("features", array_to_vector(V.doubles(F.col(embedding))))
    length = store.agg(F.avg(V.norm(F.col(embedding)))).first()[0] or 1.0
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket * length, numHashTables=tables, seed=seed).fit(rows)
    return model, model.transform(rows)


def approximate_nearest(store: DataFrame, query, k: int = 10, id_col: str = "id", embedding: str = "embedding", tables: int = 8) -> DataFrame:
    """About the k nearest rows by L2; see the tests for its recall."""
    from pyspark.ml.linalg import Vectors

    model, rows = lsh_model(store, embedding, tables=tables)
    found = model.approxNearestNeighbors(rows, Vectors.dense([float(x) for x in query]), k, distCol="dist")
    return found.select(id_col, "dist").withColumn("score", V.score(F.col("dist")))


#: Cells of an approximate index, cells that a query looks into, rows that centres are fitted on, and rounds of fitting.
CELLS_OF_INDEX, PROBES, FIT_ROWS, FIT_ROUNDS = 64, 40, 20_000, 12


def fit_centres(store: DataFrame, id_col: str = "id", embedding: str = "embedding", cells: int = CELLS_OF_INDEX, seed: int = 5) -> np.ndarray:
    """Centres of cells, by k-means over at most FIT_ROWS rows chosen by a hash of the id; the index takes every row."""
    some = store.filter(F.col(embedding).isNotNull()).select(id_col, embedding).orderBy(F.xxhash64(id_col), id_col).limit(FIT_ROWS)
    x = np.array([r[1] for r in some.collect()], np.float64)
    if not len(x):
        return np.zeros((0, 0))
    draw = np.random.default_rng(seed)
    centres = x[draw.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(FIT_ROUNDS):
        own = np.argmin(_distances(x, centres, "l2"), axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def with_cells(store: DataFrame, centres: np.ndarray, embedding: str = "embedding") -> DataFrame:
    """`store` with `cell`, the nearest centre: a column to partition an index by. Rows without a vector have none."""

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype="Int32", index=vectors.index)
        full = vectors.notna()
        if full.any() and len(centres):
            out[full] = np.argmin(_distances(np.stack(vectors[full].to_numpy()).astype(np.float64), centres, "l2"), axis=1)
        return out

    return store.withColumn("cell", cell(F.col(embedding)))


#: Rows of a cell and questions that meet in one task.
PART_ROWS, PART_QUESTIONS = 1 << 15, 1 << 14


def approximate_batch(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int = 10, probes: int = PROBES, id_col: str = "id", embedding: str = "embedding", query_id: str = "qid", query_vector: str = "qv") -> DataFrame:
    """About the k nearest rows by L2 to each query: qid, id, dist, rk. `index` is a store `with_cells`.

    A query looks into the `probes` cells nearest to it. Cells are cut in parts of about PART_ROWS
    by their counts, queries in groups of about PART_QUESTIONS. A part and those of a group that
    look into its cell meet in a task by matrix products, of which k rows per query are shuffled. A
    query without a vector finds nothing.
    """
    from chunkspark.functions.arrays import matrix, nearest_rows

    @F.pandas_udf("array<int>")
    def nearest_cells(vectors: pd.Series) -> pd.Series:
        d = _distances(np.stack(vectors.to_numpy()).astype(np.float64), centres, "l2")
        return pd.Series(list(np.argsort(d, axis=1)[:, :probes].astype(np.int32)), index=vectors.index)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows, asked = rows.sort_by("id").combine_chunks(), asked.combine_chunks()
        r, c, dist = nearest_rows(matrix(rows["v"]), matrix(asked["qv"]), k) if rows.num_rows and asked.num_rows else ([], [], [])
        places = [pa.array(x, pa.int64()) for x in (r, c)]
        return pa.table([asked["qid"].take(places[0]), rows["id"].take(places[1]), pa.array(dist, pa.float64())], names=["qid", "id", "dist"])

    if not len(centres):
        return batch_nearest(index, queries, k, "l2", id_col, embedding, query_id, query_vector)
    slim = index.filter("cell IS NOT NULL").select(F.col(id_col).alias("id"), F.col(embedding).alias("v"), "cell")
    sizes = dict(slim.groupBy("cell").count().collect())
    parts = F.array(*(F.lit(max(1, -(-sizes.get(i, 0) // PART_ROWS))) for i in range(len(centres))))[F.col("cell")]
    asked = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("qid"), F.col(query_vector).alias("qv"))
    groups = max(1, -(-asked.count() // PART_QUESTIONS))
    asked = asked.select("qid", "qv", F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int").alias("group"), F.explode(nearest_cells("qv")).alias("cell"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    slim = slim.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    key, kinds = ["cell", "part", "group"], (asked.schema["qid"].dataType.simpleString(), slim.schema["id"].dataType.simpleString())
    found = slim.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(lambda a, b: run(a, b), f"qid {kinds[0]}, id {kinds[1]}, dist double")
    w = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
