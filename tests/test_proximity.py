import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkspark.functions import vectors as V
from chunkspark.operators import proximity as P
from chunkspark.operators.search import batch_nearest


def test_lists_are_the_nearest_rows():
    x = np.random.default_rng(1).normal(size=(300, 8)).astype(np.float32)
    links = P.neighbour_lists(x, 6, 4)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    for i, own in enumerate(links):
        assert set(own[:6]) == set(np.argsort(d[i], kind="stable")[:6])
        back = [j for j in np.argsort(d[i], kind="stable") if i in np.argsort(d[j], kind="stable")[:6]]
        assert [j for j in own[6:] if j >= 0] == back[:4]
    assert P.neighbour_lists(x[:1]).max() == -1 and P.neighbour_lists(x[:3]).shape == (3, P.DEGREE + P.BACK)


@pytest.mark.parametrize("n", [1, 5, 40])
def test_small_shards_are_searched_whole(n):
    x = np.random.default_rng(n).normal(size=(n, 4)).astype(np.float32)
    near, dist, _ = P.walk(x, P.neighbour_lists(x), x, 10)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(n):
        got = near[i][near[i] >= 0]
        assert list(got) == list(np.argsort(d[i], kind="stable")[: min(10, n)]) and np.allclose(dist[i][: len(got)], d[i][got], atol=1e-3)


@pytest.fixture(scope="module")
def rows(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), "embedding"), e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


def recall(found, exact):
    want = {}
    for r in exact.collect():
        want.setdefault(r.qid, set()).add(r.id)
    hits = sum(r.id in want[r.qid] for r in found)
    return hits / sum(map(len, want.values()))


def test_recall_and_distances_taken(spark, rows, tmp_path):
    store, asked = rows
    exact = batch_nearest(store, asked.withColumn("qv", V.doubles(F.col("qv"))), 10)
    index = P.GraphIndex(spark, f"file://{tmp_path}/g").build(store)
    found = index.search(asked, 10, beam=16).collect()
    assert recall(found, exact) >= 0.95 and len(found) == 10 * asked.count()
    assert sum(r.looked for r in found) <= 0.15 * store.count() * asked.count()
    many = P.GraphIndex(spark, f"file://{tmp_path}/m").build(store, shard_rows=300)
    assert many.rows().select("shard").distinct().count() == 7
    assert recall(many.search(asked, 10).collect(), exact) >= 0.95


def test_further_rows_and_odd_ones(spark, tmp_path):
    draw = np.random.default_rng(3).normal(size=(400, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(draw)] + [(900, None), (901, draw[7].tolist()), (902, draw[7].tolist())]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = P.GraphIndex(spark, f"file://{tmp_path}/g").build(df.filter("id < 300"))
    asked = spark.createDataFrame([(1, draw[350].tolist()), (2, draw[7].tolist()), (3, None)], "qid long, qv array<double>")
    assert 350 not in {r.id for r in index.search(asked, 3).collect()}
    index.add(df.filter("id >= 300"))
    found = index.search(asked, 3).collect()
    assert {r.qid for r in found} == {1, 2} and [r.id for r in sorted(found, key=lambda r: r.rk) if r.qid == 1][0] == 350
    assert {r.id for r in found if r.qid == 2} == {7, 901, 902} and max(r.dist for r in found if r.qid == 2) < 1e-6
    none = P.GraphIndex(spark, f"file://{tmp_path}/e").build(df.limit(0))
    assert none.search(asked, 3).collect() == [] and index.search(asked.limit(0), 3).collect() == []


def test_questions_without_a_vector(spark, rows):
    store, _ = rows
    asked = spark.createDataFrame([(1, None), (2, [0.1] * 64)], "qid long, qv array<double>")
    assert {r.qid for r in batch_nearest(store, asked, 3).collect()} == {2}


def test_exact_search_equals_brute_force(spark, tmp_path):
    """The registered query on rows enough that walks miss some, with many equal vectors and others that only rounding makes equal."""
    from chunkspark.catalog import QUERIES

    draw = np.random.default_rng(8)
    x = draw.normal(size=(6000, 48)).astype(np.float32)
    x[100:400] = x[100]
    x[500:540] = x[500] + draw.normal(size=(40, 48)).astype(np.float32) * 1e-8
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {}
    for r in sorted(QUERIES["k4_graph"](spark, str(tmp_path)).collect(), key=lambda r: r.rk):
        found.setdefault(r.qid, []).append(r.vec_id)
    v = x.astype(float)
    for q in range(0, 6000, 50):
        d = np.round(np.sqrt(np.square(v - v[q]).sum(axis=1)), 6)
        assert found[q] == list(np.lexsort((np.arange(len(v)), d))[:10])


@pytest.mark.parametrize("digits", [None, 1])
def test_nearest_rows(monkeypatch, digits):
    """Far from the origin, over several blocks, with and without known distances, fewer rows than k."""
    from chunkspark.functions import arrays

    monkeypatch.setattr(arrays, "CELLS", 3000)
    monkeypatch.setattr(arrays, "ANEW", 50)
    draw = np.random.default_rng(9)
    for n in (1, 4, 700):
        x = (1e3 + draw.normal(size=(n, 5))).astype(np.float32)
        x[n // 2 :: 3] = x[0]
        q = np.concatenate([x[: min(n, 60)], draw.normal(size=(5, 5)).astype(np.float32)])
        d = np.sqrt(np.square(x.astype(float)[None] - q.astype(float)[:, None]).sum(axis=2))
        d = d if digits is None else np.round(d, digits)
        want = [list(np.lexsort((np.arange(n), row))[:6]) for row in d]
        known = np.sort(np.sqrt(np.square(x.astype(float)[None] - q.astype(float)[:, None]).sum(axis=2)), axis=1)[:, :6].max(axis=1) if n > 6 else np.full(len(q), np.inf)
        for within in (None, known):
            r, c, dist = arrays.nearest_rows(x, q, 6, digits, within)
            assert [list(c[r == i]) for i in range(len(q))] == want
            assert all(np.allclose(dist[r == i], d[i][want[i]], atol=1e-12) for i in range(len(q)))
