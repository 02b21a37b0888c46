import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkspark.functions import vectors as V
from chunkspark.operators import blocks as B
from chunkspark.operators.search import batch_nearest


def clusters(spark, n=3000, dim=12, groups=15, seed=2):
    """Vectors about few centres; a third of all rows repeats one vector."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, dim)) * 8
    x = centres[draw.integers(groups, size=n)] + draw.normal(size=(n, dim))
    x[draw.choice(n, n // 3, replace=False)] = x[0]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").cache()


def pairs(df):
    return sorted((r.qid, r.rk, r.id, round(r.dist, 5) + 0.0) for r in df.collect())


@pytest.fixture(scope="module")
def store(spark):
    return clusters(spark)


@pytest.mark.parametrize("metric", ["l2", "l1", "cosine"])
def test_equals_all_distances_and_skips_most(spark, store, tmp_path, metric):
    asked = store.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qv"))
    index = B.BlockIndex(spark, f"file://{tmp_path}/b", metric).build(store, block_rows=32, part_rows=512)
    assert index.rows().filter("block = -1").count() > 3
    found, counted = index.search_counted(asked, 7, digits=6)
    assert pairs(found) == pairs(batch_nearest(store, asked, 7, metric, digits=6))
    assert counted.first().looked < 0.35 * store.count() * asked.count()


def test_hot_shelves_and_parts(spark, store, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "QUESTIONS", 16)
    monkeypatch.setattr(B, "MOST_SHELVES", 2)
    asked = store.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qv"))
    index = B.BlockIndex(spark, f"file://{tmp_path}/b").build(store, block_rows=32, part_rows=256)
    assert index.rows().select("part").distinct().count() > 3
    assert pairs(index.search(asked, 3, digits=6)) == pairs(batch_nearest(store, asked, 3, digits=6))


def test_random_directions_are_all_opened_and_right(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = e.filter("id % 50 = 0").select(F.col("id").alias("qid"), V.doubles(F.col("embedding")).alias("qv"))
    index = B.BlockIndex(spark, f"file://{tmp_path}/b").build(e, part_rows=128)
    found, counted = index.search_counted(asked, 5, digits=6)
    assert pairs(found) == pairs(batch_nearest(e, asked, 5, digits=6))
    assert counted.first().looked <= e.count() * asked.count()


def test_odd_rows_and_questions(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0]), ("d", [1.0, 0.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 2.0])], "qid int, qv array<double>")
    index = B.BlockIndex(spark, f"file://{tmp_path}/b").build(rows)
    assert pairs(index.search(asked, 2)) == [(1, 1, "a", 0.0), (1, 2, "d", 0.0), (3, 1, "c", 2.0), (3, 2, "a", 2.23607)]
    assert len(pairs(index.search(asked, 9))) == 6 and pairs(index.search(asked.limit(0), 2)) == []
    none = B.BlockIndex(spark, f"file://{tmp_path}/e").build(rows.limit(0))
    assert pairs(none.search(asked, 2)) == []
    with pytest.raises(ValueError, match="no bound"):
        B.BlockIndex(spark, f"file://{tmp_path}/x", "max_inner_product")
