import os
import random

import pytest
from pyspark.sql import functions as F

from chunkspark.config import EmbeddingConfig
from chunkspark.operators import segments, store
from chunkspark.plans.index import Index
from chunkspark.streaming.jobs import change_stream, upsert_stream

SCHEMA = "id long, v string"


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


@pytest.fixture
def table(spark, tmp_path):
    return segments.Table(spark, f"file://{tmp_path}/t", spark.createDataFrame([], SCHEMA).schema, ["id"])


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def state(table):
    found = table.read().collect()
    assert len(found) == len({r.id for r in found})
    return {r.id: r.v for r in found}


def test_random_changes_equal_a_dict(spark, table):
    rng, want = random.Random(7), {}
    for step in range(24):
        kind = rng.choice(["upsert", "upsert", "delete", "insert", "update", "compact"])
        ids = rng.sample(range(12), rng.randrange(1, 5))
        new = rows(spark, *((i, f"{step}-{i}") for i in ids))
        if kind == "upsert":
            table.upsert(new)
            want |= {i: f"{step}-{i}" for i in ids}
        elif kind == "delete":
            table.delete(new.select("id"))
            want = {k: v for k, v in want.items() if k not in ids}
        elif kind == "compact":
            table.segments.compact()
        elif (kind == "insert") == (not set(ids) & set(want)) and (kind == "insert" or set(ids) <= set(want)):
            getattr(table, kind)(new)
            want |= {i: f"{step}-{i}" for i in ids}
        elif kind == "insert" or not set(ids) <= set(want):
            with pytest.raises(KeyError):
                getattr(table, kind)(new)
        assert state(table) == want
    assert len(table.segments.last()[1]) < 8


def test_a_small_change_writes_little(spark, tmp_path, table):
    table.upsert(spark.range(200_000).select("id", F.uuid().alias("v")))
    whole = size(f"{tmp_path}/t")
    assert whole > 5_000_000
    for i in range(9):
        before = size(f"{tmp_path}/t")
        table.upsert(rows(spark, (i, "new")))
        table.delete(rows(spark, (100 + i, "")).select("id"))
        assert size(f"{tmp_path}/t") - before < 60_000
    listed = table.segments.last()[1]
    assert len(listed) < 8 and listed[0]["bytes"] > 5_000_000
    found = table.read()
    assert found.count() == 200_000 - 9 and found.filter("v = 'new'").count() == 9


def test_merging_keeps_what_was_taken_back(spark, table):
    table.upsert(spark.range(5000).select("id", F.lit("old").alias("v")))
    for i in range(segments.FEWEST):
        table.delete(rows(spark, (i, "")).select("id"))
    table.upsert(rows(spark, (0, "again")))
    now = state(table)
    assert len(now) == 4997 and now[0] == "again" and not {1, 2, 3} & set(now)


def test_a_commit_in_between(spark, table, monkeypatch):
    """Appends follow each other; inserts are checked again; a merge keeps what came meanwhile."""
    other = segments.Table(spark, table.path, table.schema, table.keys)
    table.upsert(rows(spark, (1, "a")))
    commit, first = store.Versions.commit, []

    def late(log, after, content):
        if not first:
            first.append(1)
            other.upsert(rows(spark, (2, "other")))
        return commit(log, after, content)

    monkeypatch.setattr(store.Versions, "commit", late)
    table.upsert(rows(spark, (1, "b")))
    assert state(table) == {1: "b", 2: "other"}
    first.clear()
    with pytest.raises(KeyError):
        segments.Table(spark, table.path, table.schema, table.keys).insert(rows(spark, (2, "mine")))
    first.clear()
    with pytest.raises(KeyError):  # 2 comes while it is being inserted
        table.delete(rows(spark, (2, "")).select("id"))
        first.clear()
        table.insert(rows(spark, (2, "mine")))
    for i in range(10, 13):
        table.upsert(rows(spark, (i, "x")))
    first.clear()
    table.segments.compact()
    assert state(table) == {1: "b", 2: "other", 10: "x", 11: "x", 12: "x"}


def test_an_abandoned_change_leaves_the_state(spark, table, monkeypatch):
    table.upsert(rows(spark, (1, "a")))

    def fails(log, after, content):
        raise OSError("lost")

    monkeypatch.setattr(store.Versions, "commit", fails)
    for change in (lambda: table.upsert(rows(spark, (1, "b"))), lambda: table.delete(rows(spark, (1, "")).select("id")), lambda: table.replace(rows(spark, (5, "c")))):
        with pytest.raises(OSError, match="lost"):
            change()
    monkeypatch.undo()
    assert state(table) == {1: "a"}
    table.segments.sweep()
    assert sorted(n for n in table.versions.names() if n.startswith("s-")) == [s["name"] for s in table.segments.last()[1]]


def test_changes_are_fed_once(spark, tmp_path, table):
    seen = []

    def run():
        change_stream(table.segments, lambda df, epoch: seen.extend(map(tuple, df.collect())), f"file://{tmp_path}/c", 2).awaitTermination(240)
        new, seen[:] = sorted(seen), []
        return new

    table.upsert(rows(spark, (1, "a"), (2, "b")))
    table.upsert(rows(spark, (2, "c")))
    table.delete(rows(spark, (1, "")).select("id"))
    want = [(1, "delete", 3), (1, "upsert", 1), (2, "upsert", 1), (2, "upsert", 2)]
    assert run() == want == sorted(map(tuple, table.changes().collect()))
    assert run() == []
    for i in range(4):
        table.upsert(rows(spark, (i, "d")))  # merges of segments come between
    table.replace(rows(spark, (3, "e")))
    last = table.segments.last()[0]
    new = run()
    assert [x[:2] for x in new if x[2] == last] == [(0, "delete"), (1, "delete"), (2, "delete"), (3, "upsert")]
    assert sorted(x[0] for x in new if x[2] < last) == [0, 1, 2, 3] and new == sorted(map(tuple, table.changes(3).collect()))
    assert run() == []


def test_the_last_row_of_a_key_in_a_batch(spark, tmp_path, table):
    data = spark.createDataFrame([(1, f"{i}", i) for i in range(5)] + [(2, "x", 9)], "id long, v string, at int").repartition(4)
    data.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
    upsert_stream(stream, table, f"{tmp_path}/c", order="at").awaitTermination(240)
    assert state(table) == {1: "4", 2: "x"}
    with pytest.raises(Exception, match="order column"):
        upsert_stream(stream, table, f"{tmp_path}/c2").awaitTermination(240)


def test_index_writes_what_changed(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for i in range(60):
        (src / f"m{i}.py").write_text(f'def f{i}():\n    """{"words of many kinds " * 40}{i}"""\n    return {i}\n')
    index = Index(spark, f"file://{tmp_path}/state", EmbeddingConfig(dimension=256))
    index.sync(str(src), "code")
    (src / "m7.py").write_text("def g():\n    return 'changed'\n")
    (src / "m8.py").unlink()
    before = [s["bytes"] for s in index.segments("code").last()[1]]
    n = index.sync(str(src), "code")
    assert (n.found, n.dirty, n.deleted, n.chunks) == (59, 1, 1, 1)
    number, listed = index.segments("code").last()
    assert listed[-1]["bytes"] < 0.4 * sum(before)
    assert index.vectors.read("code").count() == index.chunks.read().count() == 59 and index.assets.read().count() == 59
    assert {(r.id, r.change) for r in index.changes("code", number - 1).collect()} == {("m7.py", "upsert"), ("m8.py", "delete")}
