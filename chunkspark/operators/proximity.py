"""An approximate index of vectors: a proximity graph in shards, kept as a table.

Rows are dealt by a hash of their id to shards of about SHARD_ROWS. In a shard every row is linked
to its nearest rows and from them back. Those are found exactly, block by block by matrix products:
the shard's bound makes the work grow with the rows, not with their square, and descent over
neighbours' neighbours took longer for worse lists. A search takes all questions through a shard's
graph at once, nearest rows first, and the shards' best rows are merged. An exact search checks a
shard's other rows against the distance that the walk has come to. The index is built once and read
by every search; further rows become further shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkspark.functions.arrays import nearest_rows

#: Rows of a shard.
SHARD_ROWS = 1 << 13
#: Neighbours of a row, and rows that it is a neighbour of and is linked back to, at most.
DEGREE, BACK = 12, 24
#: Rows that a search keeps in sight, entry points, rows that it goes on from at a time, and questions of one group.
BEAM, ENTRIES, STEP, QUESTIONS = 20, 24, 2, 1 << 14
#: Marks of seen rows that a task holds at a time.
MARKS = 1 << 25


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of the k nearest rows to each, itself left out; -1 and inf where there are fewer."""
    n = len(x)
    near, dist = np.full((n, k), -1), np.full((n, k), np.inf, np.float32)
    square, m = _squares(x), min(k, n - 1)
    for a in range(0, n, 1024) if m > 0 else ():
        d = square[a : a + 1024, None] + square[None] - 2 * x[a : a + 1024] @ x.T
        at = np.arange(len(d))
        d[at, a + at] = np.inf
        best = np.argpartition(d, m - 1, axis=1)[:, :m]
        near[a : a + 1024, :m], dist[a : a + 1024, :m] = best, np.take_along_axis(d, best, 1)
    return near, dist


def _backward(near: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Rows that have each row as a neighbour, the nearest `most` of them; -1 where there are fewer."""
    source, target, d = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel(), dist.ravel()
    full = target >= 0
    source, target, d = source[full], target[full], d[full]
    order = np.lexsort((d, target))
    source, target = source[order], target[order]
    first = np.searchsorted(target, np.arange(len(near)))
    rank = np.arange(len(target)) - first[target]
    out = np.full((len(near), most), -1)
    out[target[rank < most], rank[rank < most]] = source[rank < most]
    return out


def neighbour_lists(x: np.ndarray, degree: int = DEGREE, back: int = BACK) -> np.ndarray:
    """Places of each row's neighbours and of rows that it is one of, -1 after the last."""
    near, dist = _nearest(x, degree)
    both = np.concatenate([near, _backward(near, dist, back)], 1)
    order = np.argsort(both < 0, axis=1, kind="stable")
    return np.take_along_axis(both, order, 1).astype(np.int32)


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, k: int, beam: int = BEAM, seed: int = 5) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, distances) of about the k nearest rows to each question, nearest first, and how many distances that took."""
    n, m, beam = len(x), len(q), max(beam, k)
    square, q2 = _squares(x), _squares(q)
    start = np.sort(np.random.default_rng(seed).choice(n, min(ENTRIES, n), replace=False))
    near = np.full((m, beam), -1)
    dist = np.full((m, beam), np.inf, np.float32)
    done = np.zeros((m, beam), bool)
    seen = np.zeros((m, n), bool)
    seen[:, start] = True
    d = q2[:, None] + square[start][None] - 2 * q @ x[start].T
    order = np.argsort(d, axis=1, kind="stable")[:, :beam]
    near[:, : order.shape[1]], dist[:, : order.shape[1]] = start[order], np.take_along_axis(d, order, 1)
    looked, live = m * len(start), np.arange(m)
    while len(live):
        open_ = ~done[live] & (near[live] >= 0)
        pick = np.argsort(~open_, axis=1, kind="stable")[:, :STEP]  # the nearest that it hasn't gone on from
        may = np.take_along_axis(open_, pick, 1)
        going = may.any(axis=1)
        live, pick, may = live[going], pick[going], may[going]
        if not len(live):
            break
        at = np.take_along_axis(near[live], pick, 1)
        done[live[:, None], pick] |= may
        more = np.where(may[:, :, None], links[at], -1).reshape(len(live), -1)
        more[np.take_along_axis(seen[live], np.maximum(more, 0), 1)] = -1
        more.sort(axis=1)
        more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
        r, c = np.nonzero(more >= 0)
        found = more[r, c]
        seen[live[r], found] = True
        looked += len(found)
        far = np.full(more.shape, np.inf, np.float32)
        far[r, c] = q2[live[r]] + square[found] - 2 * np.einsum("ij,ij->i", q[live[r]], x[found])
        all_near, all_dist = np.concatenate([near[live], more], 1), np.concatenate([dist[live], far], 1)
        all_done = np.concatenate([done[live], np.zeros(more.shape, bool)], 1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        near[live], dist[live], done[live] = (np.take_along_axis(v, order, 1) for v in (all_near, all_dist, all_done))
    near[np.isinf(dist)] = -1
    return near[:, :k], np.sqrt(np.maximum(dist[:, :k], 0)), looked


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1)


def _built(table: pa.Table) -> pa.Table:
    table = table.sort_by("id").combine_chunks()
    links = neighbour_lists(_matrix(table["embedding"]))
    own = [links[i][links[i] >= 0] for i in range(len(links))]
    return table.append_column("place", pa.array(np.arange(len(links), dtype=np.int32))).append_column("links", pa.array(own, pa.list_(pa.int32())))


def _searched(k: int, beam: int, exact: bool, digits: int | None):
    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        shard = shard.sort_by("place").combine_chunks()
        if not shard.num_rows or not asked.num_rows:
            empty = [pa.array([], t) for t in (asked.schema.field("qid").type, shard.schema.field("id").type, pa.float64(), pa.int64())]
            return pa.table(empty, names=["qid", "id", "dist", "looked"])
        x, lists = _matrix(shard["embedding"]), shard["links"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        links = np.full((len(x), max(int(sizes.max()), 1)), -1, np.int32)
        row = np.repeat(np.arange(len(x)), sizes)
        links[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        asked = asked.combine_chunks()
        step = max(1, MARKS // max(len(x), 1))
        parts = []
        for a in range(0, asked.num_rows, step):
            own = asked.slice(a, step)
            q = _matrix(own["qv"])
            near, dist, looked = walk(x, links, q, k, beam)
            r, c = np.nonzero(near >= 0)
            at = near[r, c]
            apart = np.sqrt(np.square(x[at].astype(np.float64) - q[r].astype(np.float64)).sum(axis=1))
            if exact:
                last = np.zeros(len(q))
                np.maximum.at(last, r, apart)
                last[(near >= 0).sum(axis=1) < k] = np.inf
                r, at, apart = nearest_rows(x, q, k, digits, last)
                looked += len(x) * len(q)
            counted = np.zeros(len(r), np.int64)
            counted[:1] = looked
            parts.append(pa.table([own["qid"].take(pa.array(r)), shard["id"].take(pa.array(at)), pa.array(apart), pa.array(counted)], names=["qid", "id", "dist", "looked"]))
        return pa.concat_tables(parts)

    return run


class GraphIndex:
    """The index in a folder of any file system that Spark writes to: rows of shard, id, embedding, place and links."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def build(self, store: DataFrame, id_col: str = "id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS) -> GraphIndex:
        """Write the graph of `store`. Ids must be unique; rows without a vector are left out. Replaces what the folder has."""
        return self._write(store, id_col, embedding, shard_rows, 0, "overwrite")

    def add(self, store: DataFrame, id_col: str = "id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS) -> GraphIndex:
        """Further rows, as shards of their own; what is there stays as it is."""
        return self._write(store, id_col, embedding, shard_rows, self.rows().agg(F.max("shard")).first()[0] + 1, "append")

    def _write(self, store, id_col, embedding, shard_rows, first, mode):
        rows = store.filter(F.col(embedding).isNotNull()).select(F.col(id_col).alias("id"), F.col(embedding).cast("array<float>").alias("embedding"))
        shards = max(1, -(-rows.count() // shard_rows))
        dealt = rows.select((F.pmod(F.xxhash64("id"), F.lit(shards)) + first).cast("int").alias("shard"), "id", "embedding")
        kind = dealt.schema["id"].dataType.simpleString()
        graph = dealt.groupBy("shard").applyInArrow(lambda t: _built(t), f"shard int, id {kind}, embedding array<float>, place int, links array<int>")
        graph.write.mode(mode).parquet(self.path)
        return self

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "qid", query_vector: str = "qv", beam: int = BEAM, exact: bool = False, digits: int | None = None) -> DataFrame:
        """About the k nearest rows by L2 to each question: qid, id, dist, rk, looked.

        Questions go through each shard in groups of about QUESTIONS, side by side. Ties go to the
        smaller id; a question without a vector finds nothing. `looked` sums up, over all rows, to
        the distances that were taken of rows among the results. With `exact` they are the k nearest
        rows: in each shard all rows within the distance of the k-th that the walk found are looked
        for by matrix products, and distances that agree after rounding to `digits` are ties.
        """
        rows = self.rows()
        asked = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("qid"), F.col(query_vector).cast("array<float>").alias("qv"))
        shards = (rows.agg(F.max("shard")).first()[0] if rows.columns else None) or 0
        groups = max(1, -(-asked.count() // QUESTIONS))
        spread = asked.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards))))
        copied = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        kinds = asked.schema["qid"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
        run = _searched(k, beam, exact, digits)
        found = copied.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInArrow(lambda a, b: run(a, b), f"qid {kinds[0]}, id {kinds[1]}, dist double, looked long")
        w = Window.partitionBy("qid").orderBy("dist", "id")
        return found.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
