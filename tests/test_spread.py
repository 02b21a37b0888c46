"""Work that is spread over tasks: places in groups, boxes in grids, windows without times."""

import random

import numpy as np
from pyspark.sql import functions as F

from chunkspark.operators.graph import in_boxes
from chunkspark.operators.limiter import rate_limit
from chunkspark.operators.sync import batches, with_places


def test_places_in_a_group_of_many_parts(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "", None]), i, rng.random()) for i in rng.sample(range(3000), 3000)]
    df = spark.createDataFrame(rows, "g string, at int, extra double").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = with_places(df, "g", "at").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for g in {r[0] for r in rows}:
        want |= {(g, at): i for i, at in enumerate(sorted(r[1] for r in rows if r[0] == g))}
    assert len(found) == 3000 and {(r.g, r.at): r.place for r in found} == want
    few = batches(df.withColumnRenamed("g", "domain_id").filter("domain_id = 'hot'"), "at", 200)
    assert few.columns == ["domain_id", "at", "extra", "batch"] and few.groupBy("batch").count().filter("count > 200").count() == 0
    assert with_places(df.limit(0), "g", "at").collect() == []


def boxes_of(rng, n):
    out = []
    for i in range(n):
        x, y = rng.uniform(-500, 500, 2)
        w, h = rng.choice([0, 0.001, 1, 7, 300], 2) * rng.uniform(0.5, 1.5, 2)
        out.append((str(rng.integers(3)), i, float(x), float(x + w), float(y), float(y + h)))
    return [*out, ("0", 900, 5.0, 4.0, 0.0, 9.0), ("1", 901, -np.inf, np.inf, -1e300, 1e300), ("2", 902, 3.0, 3.0, 4.0, 4.0)]


def test_boxes_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    boxes = boxes_of(rng, 60)
    nodes = [(str(rng.integers(3)), f"n{i}", *map(float, rng.uniform(-500, 500, 2))) for i in range(400)]
    nodes += [(b[0], f"edge{b[1]}", b[3], b[4]) for b in boxes[:40]] + [("2", "at", 3.0, 4.0), ("0", "none", None, 1.0), ("9", "alone", 0.0, 0.0)]
    found = in_boxes(spark.createDataFrame(nodes, "file string, id string, x double, y double"), spark.createDataFrame(boxes, "file string, box int, x_min double, x_max double, y_min double, y_max double"))
    got = sorted((r.id, r.box) for r in found.collect())
    want = sorted((n[1], b[1]) for n in nodes for b in boxes if n[0] == b[0] and n[2] is not None and b[2] <= n[2] <= b[3] and b[4] <= n[3] <= b[5])
    assert got == want and len(want) > 100


def test_many_boxes_of_one_file(spark):
    n = 30_000
    boxes = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("box"), (F.col("id") * 3.0).alias("x_min"), (F.col("id") * 3.0 + 2).alias("x_max"), F.lit(0.0).alias("y_min"), F.lit(1.0).alias("y_max"))
    nodes = spark.range(n).select(F.lit("f").alias("file"), F.col("id").cast("string").alias("id"), (F.col("id") * 3.0 + 1).alias("x"), F.lit(0.5).alias("y"))
    found = in_boxes(nodes, boxes)
    assert found.count() == n and found.filter("cast(id as long) <> box").count() == 0  # nodes x boxes would be 9 x 10^8


def test_requests_without_a_time(spark):
    rows = [(1, i, t) for i, t in enumerate([None, "2024-01-01 00:00:00", None, "2024-01-01 00:00:01", "2024-01-01 00:00:02", None])]
    df = spark.createDataFrame(rows, "user_id int, event_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.event_id: r.limited for r in rate_limit(df).collect()} == {0: False, 1: False, 2: False, 3: False, 4: True, 5: False}
