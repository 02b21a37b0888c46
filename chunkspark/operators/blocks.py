"""Exact nearest rows to a table of questions, by blocks that a bound can rule out.

Rows are sorted by their nearest pivot and their distance to it, dealt in that order to shelves,
and cut to blocks there. A block knows how far its rows are from every pivot, at least and at most.
By the triangle inequality no row of it is nearer to a question than the question's own distances
to the pivots lie outside of those ranges, so it is opened only if that bound doesn't exceed the
distance of the k-th row found so far. A question looks into its likeliest shelf first and then,
with the distance found there, into those shelves that may still hold something nearer.

Questions are a table like the rows: both are dealt to (shelf, part) groups of bounded size, and
nothing but pivots and the ranges of at most MOST_SHELVES shelves comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkspark.functions import vectors as V
from chunkspark.operators.search import FIT_ROWS, _distances
from chunkspark.operators.store import work_folder

#: Pivots; rows of a block and of a part of a shelf; shelves at most; questions of a group.
PIVOTS, BLOCK_ROWS, PART_ROWS, MOST_SHELVES, QUESTIONS = 32, 128, 1 << 15, 4096, 1 << 14
#: Distances that a task holds at a time.
CELLS = 4_000_000
#: Distances are sums of floating-point products: a bound may be off by so much of the vectors' size.
SLACK = 1e-6
#: Metrics for which the bound holds; cosine as half the square of the distance of unit vectors.
METRICS = ("l2", "l1", "cosine")


def _matrix(column: pa.ChunkedArray | pa.Array, unit: bool) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(column), -1 if len(column) else 0)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300) if unit else x


def _outside(reach: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For questions × blocks, the least distance that the ranges lo and hi (blocks × pivots) leave possible."""
    out = np.zeros((len(reach), len(lo)))
    for p in range(reach.shape[1]):
        own = reach[:, p : p + 1]
        np.maximum(out, np.maximum(own - hi[None, :, p], lo[None, :, p] - own), out=out)
    return out


def choose_pivots(rows: DataFrame, most: int, unit: bool, space: str, seed: int = 5) -> np.ndarray:
    """Rows far from one another, of at most FIT_ROWS chosen by a hash of the id: each is drawn by its squared distance to those before."""
    some = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).toArrow()
    x = _matrix(some["embedding"], unit)
    draw, far, chosen = np.random.default_rng(seed), np.full(len(x), 1.0), []
    while len(chosen) < most and far.sum() > 0:
        chosen.append(int(draw.choice(len(x), p=far / far.sum())))
        d = _distances(x, x[chosen[-1:]], space)[:, 0] ** 2
        d[d < SLACK] = 0.0
        far = d if len(chosen) == 1 else np.minimum(far, d)
    return x[chosen]


class _Best:
    """The k nearest rows so far of each question; ties go to the smaller rank."""

    def __init__(self, n: int, k: int, limit: np.ndarray):
        self.k, self.limit = k, limit.copy()
        self.q, self.dist, self.rank = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, asked: np.ndarray, d: np.ndarray, ranks: np.ndarray) -> None:
        """d: distances of questions `asked` to rows of these ranks."""
        r, c = np.nonzero(d <= self.limit[asked][:, None])
        if not len(r):
            return
        q, dist, rank = np.append(self.q, asked[r]), np.append(self.dist, d[r, c]), np.append(self.rank, ranks[c])
        order = np.lexsort((rank, dist, q))
        q, dist, rank = q[order], dist[order], rank[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.limit[q[last]] = np.minimum(self.limit[q[last]], dist[last])
        keep = place < self.k
        self.q, self.dist, self.rank = q[keep], dist[keep], rank[keep]


class BlockIndex:
    """A table of rows in blocks, in a folder of any file system that Spark writes to.

    Ids must be unique; rows without a vector are left out. Pivots are fitted on a bounded sample
    (`choose_pivots`), every row is filed. Vectors of no length are at distance 1 by cosine, as
    they have no direction. An empty store answers nothing.
    """

    def __init__(self, spark: SparkSession, path: str, metric: str = "l2"):
        self.spark, self.path, self.metric = spark, path.rstrip("/"), V.metric_of(metric)
        if self.metric not in METRICS:
            raise ValueError(f"no bound for {self.metric}; use batch_nearest")
        self.unit = self.metric == "cosine"
        self.space = "l1" if self.metric == "l1" else "l2"

    def build(self, store: DataFrame, id_col: str = "id", embedding: str = "embedding", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> BlockIndex:
        """File `store`; replaces what the folder has."""
        rows = store.filter(F.col(embedding).isNotNull()).select(F.col(id_col).alias("id"), V.doubles(F.col(embedding)).alias("embedding"))
        unit, space = self.unit, self.space
        centres = choose_pivots(rows, pivots, unit, space)
        kind = rows.schema["id"].dataType.simpleString()
        shelves = min(MOST_SHELVES, max(1, -(-rows.count() // part_rows)))

        def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = _distances(_matrix(batch["embedding"], unit), centres, space)
                cell = d.argmin(1) if len(d) else np.zeros(0, np.int64)
                reach = d[np.arange(len(d)), cell]
                yield pa.record_batch([batch["id"], batch["embedding"], pa.array(cell.astype(np.int32)), pa.array(reach)], names=["id", "embedding", "cell", "reach"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, lo, hi = 0, np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
            per_part = max(1, part_rows // block_rows)
            shelf, schema = -1, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                shelf, cells = batch["shelf"][0].as_py(), batch["cell"].to_numpy()
                d = _distances(_matrix(batch["embedding"], unit), centres, space)
                # a block ends where its pivot changes or it is full
                starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                since = np.arange(len(cells)) - np.repeat(starts, np.diff(np.append(starts, len(cells))))
                first = since % block_rows == 0
                at = np.flatnonzero(first)
                own_lo, own_hi = np.minimum.reduceat(d, at), np.maximum.reduceat(d, at)
                lo, hi = np.minimum(lo, own_lo.min(0)), np.maximum(hi, own_hi.max(0))
                number = block + np.cumsum(first) - 1
                block = int(number[-1]) + 1
                ranges = [[None] * len(cells), [None] * len(cells)]
                for i, a in enumerate(at):
                    ranges[0][a], ranges[1][a] = own_lo[i], own_hi[i]
                columns = [batch["shelf"], pa.array((number // per_part).astype(np.int32)), pa.array(number.astype(np.int32)), batch["id"], batch["embedding"]]
                out = pa.record_batch(columns + [pa.array(r, pa.list_(pa.float64())) for r in ranges], names=["shelf", "part", "block", "id", "embedding", "lo", "hi"])
                schema = out.schema
                yield out
            if block:  # the shelf's own ranges, and its last part
                yield pa.RecordBatch.from_pylist([{"shelf": shelf, "part": (block - 1) // per_part, "block": -1, "id": None, "embedding": None, "lo": lo, "hi": hi}], schema)

        placed = rows.mapInArrow(filed, f"id {kind}, embedding array<double>, cell int, reach double")
        dealt = placed.repartitionByRange(shelves, "cell", "reach", "id").withColumn("shelf", F.spark_partition_id()).sortWithinPartitions("cell", "reach", "id")
        blocks = dealt.mapInArrow(cut, f"shelf int, part int, block int, id {kind}, embedding array<double>, lo array<double>, hi array<double>")
        blocks.write.mode("overwrite").parquet(f"{self.path}/rows")
        pivots_of = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "pivot int, embedding array<double>")
        pivots_of.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/pivots")
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "qid", query_vector: str = "qv", digits: int | None = None) -> DataFrame:
        """The k nearest rows to each question: qid, id, dist, rk. `digits` and ties are as in `batch_nearest`."""
        return self.search_counted(queries, k, query_id, query_vector, digits)[0]

    def search_counted(self, queries: DataFrame, k: int = 10, query_id: str = "qid", query_vector: str = "qv", digits: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(`search`'s rows, one row of `looked`: distances taken). Question ids must be unique; questions without a vector find nothing."""
        all_rows = self.rows()
        kinds = queries.schema[query_id].dataType.simpleString(), all_rows.schema["id"].dataType.simpleString()
        asked = queries.filter(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("qid"), V.doubles(F.col(query_vector)).alias("qv"), F.lit(None).cast("double").alias("kth"))
        centres = np.array([r[1] for r in self.spark.read.parquet(f"{self.path}/pivots").orderBy("pivot").collect()])  # at most PIVOTS
        shelves = all_rows.filter("block = -1").select("shelf", "part", "lo", "hi").orderBy("shelf").collect()  # at most MOST_SHELVES
        found = f"{work_folder(self.spark, 'blocks')}/found"
        visit = self._visitor(all_rows, shelves, centres, k, digits, kinds)
        visit(asked, True).write.parquet(f"{found}/stage=1")
        first = self.spark.read.parquet(f"{found}/stage=1")
        kth = first.filter("id is not null").groupBy("qid").agg(F.max("dist").alias("kth"), F.count("*").alias("n")).filter(F.col("n") >= k)
        again = asked.drop("kth").join(kth.drop("n"), "qid", "left")
        visit(again, False).write.parquet(f"{found}/stage=2")
        both = self.spark.read.parquet(f"{found}/stage=1", f"{found}/stage=2")
        w = Window.partitionBy("qid").orderBy("dist", "id")
        best = both.filter("id is not null").select("qid", "id", "dist").withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)
        return best, both.agg(F.coalesce(F.sum("looked"), F.lit(0)).alias("looked"))

    def _visitor(self, all_rows: DataFrame, shelves: list, centres: np.ndarray, k: int, digits: int | None, kinds: tuple[str, str]):
        unit, space, metric = self.unit, self.space, self.metric
        names, parts = np.array([s["shelf"] for s in shelves], np.int64), np.array([s["part"] for s in shelves], np.int64) + 1
        lo, hi = (np.array([s[c] for s in shelves]).reshape(len(shelves), len(centres)) for c in ("lo", "hi"))
        half = 0.5 * 10.0**-digits if digits is not None else 0.0

        def reach_of(q: np.ndarray) -> np.ndarray:
            return _distances(q, centres, space)

        def allowed(kth: np.ndarray, reach: np.ndarray) -> np.ndarray:
            """The largest bound at which a block may still hold a row at most as far as the k-th, by distance in the pivots' space."""
            far = np.maximum(kth + 2 * half, 0)
            far = np.sqrt(2 * far) if unit else far
            return far + SLACK * (1 + reach.max(1, initial=0))

        def route(first: bool):
            def likeliest(reach: np.ndarray, bound: np.ndarray) -> np.ndarray:
                """By bound, then by how near the middles of a shelf's ranges are."""
                off = np.zeros_like(bound)
                for p in range(reach.shape[1]):
                    off += np.abs(reach[:, p : p + 1] - (lo[None, :, p] + hi[None, :, p]) / 2)
                return np.lexsort((off, bound), axis=1)[:, 0]

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for whole in batches:
                    step = max(1, CELLS // max(1, len(names)))
                    for a in range(0, whole.num_rows if len(names) else 0, step):
                        batch = whole.slice(a, step)
                        reach = reach_of(_matrix(batch["qv"], unit))
                        bound = _outside(reach, lo, hi)
                        best = likeliest(reach, bound)
                        if first:
                            r, c = np.arange(len(best)), best
                        else:
                            kth = batch["kth"].to_numpy(zero_copy_only=False).astype(np.float64)
                            may = bound <= np.where(np.isnan(kth), np.inf, allowed(kth, reach))[:, None]
                            may[np.arange(len(best)), best] = False  # been there
                            r, c = np.nonzero(may)
                        n = parts[c]
                        r, c = np.repeat(r, n), np.repeat(c, n)
                        part = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
                        taken = batch.take(pa.array(r))
                        yield pa.record_batch([*taken.columns, pa.array(names[c].astype(np.int32)), pa.array(part.astype(np.int32))], names=["qid", "qv", "kth", "shelf", "part"])

            return run

        def open_blocks(rows: pa.Table, asked: pa.Table) -> pa.Table:
            names_out = ["qid", "id", "dist", "looked"]
            if not rows.num_rows or not asked.num_rows:
                return pa.table([pa.array([], t) for t in (asked.schema.field("qid").type, rows.schema.field("id").type, pa.float64(), pa.int64())], names=names_out)
            rows = rows.sort_by("id").combine_chunks()
            x, blocks = _matrix(rows["embedding"], unit), rows["block"].to_numpy()
            order = np.argsort(blocks, kind="stable")  # within a block by id: a row's place is its rank
            starts = np.flatnonzero(np.append(True, np.diff(blocks[order]) != 0))
            members = np.split(order, starts[1:])
            heads = rows.filter(rows["lo"].is_valid()).sort_by("block").combine_chunks()
            own_lo, own_hi = _matrix(heads["lo"], False), _matrix(heads["hi"], False)
            asked, out, looked = asked.combine_chunks(), [], 0
            step = max(1, min(1024, CELLS // len(x)))
            for a in range(0, asked.num_rows, step):
                own = asked.slice(a, step)
                q, kth = _matrix(own["qv"], unit), own["kth"].to_numpy().astype(np.float64)
                reach = reach_of(q)
                bound = _outside(reach, own_lo, own_hi)
                best = _Best(len(q), k, np.where(np.isnan(kth), np.inf, kth))
                middle = sum((np.abs(reach[:, p : p + 1] - (own_lo + own_hi)[None, :, p] / 2) for p in range(reach.shape[1])), np.zeros_like(bound))
                likely = np.lexsort((middle, bound), axis=1)[:, 0]
                # each question's likeliest block first, so that it has a distance to judge the others by
                for b, ahead in [(b, True) for b in np.unique(likely)] + [(b, False) for b in np.argsort(bound.min(0), kind="stable")]:
                    near = np.flatnonzero(likely == b if ahead else (likely != b) & (bound[:, b] <= allowed(best.limit, reach)))
                    if len(near):
                        d = _distances(x[members[b]], q[near], metric).T
                        d = np.where(np.isnan(d), 1.0, d) if unit else d
                        looked += d.size
                        best.add(near, d if digits is None else np.round(d, digits) + 0.0, members[b])
                out.append(pa.table([own["qid"].take(pa.array(best.q)), rows["id"].take(pa.array(best.rank)), pa.array(best.dist), pa.nulls(len(best.q), pa.int64())], names=names_out))
            found = pa.concat_tables(out)
            count = pa.table([pa.nulls(1, found.schema.field(0).type), pa.nulls(1, found.schema.field(1).type), pa.nulls(1, pa.float64()), pa.array([looked])], names=names_out)
            return pa.concat_tables([found, count])

        def visit(asked: DataFrame, first: bool) -> DataFrame:
            routed = asked.mapInArrow(route(first), f"qid {kinds[0]}, qv array<double>, kth double, shelf int, part int")
            # a shelf that many ask for is copied to several groups of its questions
            copies = routed.groupBy("shelf").agg(F.ceil(F.count("*") / F.lit(QUESTIONS)).cast("int").alias("copies"))
            salted = routed.join(F.broadcast(copies), "shelf").withColumn("salt", F.pmod(F.xxhash64("qid"), F.col("copies")).cast("int"))
            rows = all_rows.filter("block >= 0").join(F.broadcast(copies), "shelf").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
            key = ["shelf", "part", "salt"]
            pairs = rows.select(*key, "block", "id", "embedding", "lo", "hi").groupBy(*key).cogroup(salted.select(*key, "qid", "qv", "kth").groupBy(*key))
            return pairs.applyInArrow(lambda a, b: open_blocks(a, b), f"qid {kinds[0]}, id {kinds[1]}, dist double, looked long")

        return visit
