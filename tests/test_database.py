import json
import sqlite3

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkspark.sources import database as B

SCHEMA = "id long, label string, v double, ok boolean"


@pytest.fixture
def db(spark, tmp_path):
    spark.dataSource.register(B.DatabaseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    path = str(tmp_path / "x.db")
    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("CREATE TABLE items (id bigint, label text, v double precision, ok boolean)")
    con.executemany("INSERT INTO items VALUES (?, ?, ?, ?)", [(i, None if i % 7 == 0 else f"l{i % 3}", i / 2, i % 2) for i in range(1000)] + [(None, "l0", None, None)])
    con.commit()
    yield {"module": "sqlite3", "connect": json.dumps({"database": path, "timeout": 60}), "table": "items", "key": "id"}, path
    con.close()


def read(spark, options, **more):
    return spark.read.format("database").schema(SCHEMA).options(**options, **more).load()


def tables(path):
    return {r[0] for r in sqlite3.connect(path).execute("SELECT name FROM sqlite_master WHERE type = 'table'")}


def rows_of(path):
    return sqlite3.connect(path).execute("SELECT id, label, v, ok FROM items").fetchall()


def test_ranges_read_every_row_once(spark, db):
    options, _ = db
    for more in ({"partitions": "1"}, {"partitions": "6"}, {"cuts": "[10, 900, 5000]"}):
        got = read(spark, options, **more)
        assert got.rdd.getNumPartitions() == (4 if "cuts" in more else int(more["partitions"]))
        assert sorted((r.id if r.id is not None else -1, r.label, r.v, r.ok) for r in got.collect()) == sorted([(i, None if i % 7 == 0 else f"l{i % 3}", i / 2, bool(i % 2)) for i in range(1000)] + [(-1, "l0", None, None)], key=lambda x: x[0])
    assert read(spark, {k: v for k, v in options.items() if k != "key"}).count() == 1001


@pytest.mark.parametrize("where", ["label = 'l1'", "label <> 'l1'", "id IN (3, 4, 5000)", "NOT id IN (3, 4)", "label IS NULL", "NOT label IS NULL", "id > 990 AND label = 'l0'", "id <= 3", "v > 400.5", "label > 'l1'", "label LIKE 'l%' AND id < 9", "id = 1 OR id = 2", "ok", "id > 2000"])
def test_filters_mean_what_they_mean_in_spark(spark, db, where):
    options, _ = db
    want = spark.createDataFrame(read(spark, options).collect(), SCHEMA)
    key = lambda df: sorted(map(str, df.filter(where).collect()))
    assert key(read(spark, options)) == key(want)


def test_pushed_filters_leave_the_plan_and_narrow_the_ranges(spark, db):
    options, _ = db
    reader = B.DatabaseReader(T.StructType.fromDDL(SCHEMA), options)
    left = list(reader.pushFilters([D.EqualTo(("label",), "l1"), D.GreaterThan(("id",), 900), D.GreaterThan(("v",), 1.0), D.StringContains(("label",), "x"), D.Not(D.GreaterThan(("id",), 2))]))
    assert [type(f) for f in left] == [D.GreaterThan, D.StringContains, D.Not]
    assert reader.where == ["label = ?", "id > ?"] and reader.values == ["l1", 900]
    ranges = reader.partitions()
    assert len(ranges) == 8 and all(900 < p.low for p in ranges[1:])  # ends come from the rows that pass
    assert sum(b.num_rows for p in ranges for b in reader.read(p)) == sum(1 for i in range(901, 1000) if i % 7 and i % 3 == 1)
    plan = read(spark, options).filter("label = 'l1' AND v > 1.0")._jdf.queryExecution().executedPlan().toString()
    assert "l1" not in plan.split("Filter")[1].splitlines()[0] and "1.0" in plan


def test_appends_overwrites_and_upserts(spark, db):
    options, path = db
    new = spark.range(998, 1005).select("id", F.lit("new").alias("label"), F.lit(1.5).alias("v"), F.lit(True).alias("ok")).repartition(3)
    new.write.format("database").options(**options, upsert="id").mode("append").save()
    got = rows_of(path)
    assert len(got) == 1001 + 5 and {r[0] for r in got if r[1] == "new"} == set(range(998, 1005))
    new.write.format("database").options(**options).mode("append").save()
    assert len(rows_of(path)) == 1006 + 7
    new.limit(0).write.format("database").options(**options).mode("append").save()
    assert len(rows_of(path)) == 1013
    new.write.format("database").options(**options).mode("overwrite").save()
    assert sorted(rows_of(path)) == [(i, "new", 1.5, 1) for i in range(998, 1005)]
    assert tables(path) == {"items"}


def test_aborted_write_leaves_nothing(spark, db):
    options, path = db
    before = rows_of(path)
    bad = spark.range(0, 50, 1, 4).select("id", F.lit("x").alias("label"), F.lit(0.0).alias("v"), F.when(F.col("id") == 40, F.raise_error(F.lit("stop"))).otherwise(F.lit(True)).alias("ok"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("database").options(**options).mode("append").save()
    assert rows_of(path) == before and tables(path) == {"items"}


def test_an_attempt_that_does_not_count_is_left_out(db):
    options, path = db
    writer = B.DatabaseWriter(T.StructType.fromDDL(SCHEMA), options, False)
    lost, kept = (writer.write(iter([(5000, "a", 1.0, True)])) for _ in range(2))
    assert lost.table != kept.table
    writer.commit([kept, None])
    assert sum(r[0] == 5000 for r in rows_of(path)) == 1 and tables(path) == {"items"}


def test_a_failed_commit_changes_nothing(db):
    options, path = db
    before = rows_of(path)
    sqlite3.connect(path).execute("CREATE UNIQUE INDEX own ON items (id)")
    writer = B.DatabaseWriter(T.StructType.fromDDL(SCHEMA), options, False)
    staged = [writer.write(iter([(2000 + i, "a", 1.0, True), (i, "taken", 1.0, True)])) for i in range(2)]
    with pytest.raises(sqlite3.IntegrityError):
        writer.commit(staged)
    assert rows_of(path) == before and tables(path) == {"items"}


def test_wrong_options(spark, db):
    options, _ = db
    with pytest.raises(ValueError, match="not a name"):
        B.DatabaseReader(T.StructType.fromDDL(SCHEMA), options | {"table": "x; DROP TABLE y"})
    with pytest.raises(ValueError, match="needs the option"):
        B.Database.of({"module": "sqlite3"})
    with pytest.raises(ValueError, match="can't be written"):
        B.DatabaseWriter(T.StructType.fromDDL("v array<int>"), options, False)
