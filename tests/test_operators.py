import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkspark.config import EmbeddingConfig
from chunkspark.functions import json as J
from chunkspark.functions import text as X
from chunkspark.functions import vectors as V
from chunkspark.operators import chat, segments, store, sync
from chunkspark.operators.embed import PROVIDERS, embed_texts, embedding
from chunkspark.operators.limiter import Window, rate_limit, remaining
from chunkspark.operators.search import approximate_nearest, batch_nearest, nearest, search, vector_literal
from chunkspark.plans.index import Index
from chunkspark.plans.retrieve import prompts, search_tool


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=8) * (1 + i % 3)).tolist(), i % 4) for i in range(200)]
    rows += [(200, [0.0] * 8, 0), (201, rows[0][1], 1), (202, None, 1)]
    return rows, spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(5)


@pytest.mark.parametrize("metric", ["l2", "cosine", "l1", "max_inner_product"])
def test_batch_equals_single_and_numpy(spark, vectors, metric):
    rows, store_df = vectors
    asked = spark.createDataFrame([(i, [float(x) for x in rows[i][1]]) for i in range(3)], "qid long, qv array<double>")
    found = {(r.qid, r.rk): (r.id, r.dist) for r in batch_nearest(store_df, asked, 6, metric).collect()}
    for i in range(3):
        single = nearest(store_df.filter("embedding is not null"), vector_literal(rows[i][1]), 6, metric).collect()
        assert [found[i, k + 1][0] for k in range(6)] == [r.id for r in single]
        assert np.allclose([found[i, k + 1][1] for k in range(6)], [r.dist for r in single], atol=1e-5)


def test_ties_zero_vectors_and_growing_k(spark, vectors):
    rows, store_df = vectors
    q = vector_literal(rows[0][1])
    assert [r.id for r in nearest(store_df, q, 2).collect()] == [0, 201]
    assert store_df.filter("id = 200").select(V.cosine_distance(F.col("embedding"), q)).first()[0] is None
    few, more = ({r.id for r in nearest(store_df, q, k).collect()} for k in (5, 9))
    assert few < more
    assert search(store_df, q, 10, where=F.col("label") == 3).count() < search(store_df, q, 10, where=F.col("label") == 3, prefilter=True).count() == 10
    scores = [r.score for r in nearest(store_df, q, 10).collect()]
    assert search(store_df, q, 10, threshold=scores[4]).count() == 5
    with pytest.raises(ValueError, match="no such"):
        V.metric_of("hamming")


def test_lsh_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    hits = 0
    for row in e.filter("vec_id < 5").collect():
        exact = {r.vec_id for r in nearest(e, vector_literal(row.embedding), 10, id_col="vec_id").collect()}
        hits += len(exact & {r.vec_id for r in approximate_nearest(e, row.embedding, 10, "vec_id", tables=12).collect()})
    assert hits >= 35


def test_window_edges():
    w = Window(2, 60)
    assert [w.limited(t) for t in (0, 10, 59, 60, 61, 70, 119, 120)] == [False, False, True, False, True, False, True, False]


def brute_limit(rows, limit, width):
    out, windows = {}, {}
    for key, us, event in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        live = [t for t in windows.get(key, []) if us - t < width]
        out[event] = len(live) >= limit
        windows[key] = live if out[event] else [*live, us]
    return out


def test_limits_of_a_hot_key(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k) if k else None, int(t), i) for i, (k, t) in enumerate(zip(rng.choice([0, 1, 1, 1, 2], 3000), rng.integers(0, 2000, 3000), strict=True))]
    df = spark.createDataFrame(rows, "user_id long, s long, event_id long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    found = {r.event_id: r.limited for r in rate_limit(df, limit=3, window_seconds=20).collect()}
    assert found == brute_limit(rows, 3, 20) and 0 < sum(found.values()) < 3000


def test_remaining(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 2, 30), (1, 3, 40), (2, 4, 0), (3, 5, 99)], "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts"))
    found = dict(remaining(df, F.timestamp_seconds(F.lit(60)), limit=2, window_seconds=60).collect())
    assert found == {1: 30.0, 2: 0.0, 3: 0.0}


def python_truncate(text, most, mark=X.SUMMARY):
    if len(text) <= most:
        return text
    parts = text.split(mark)
    if len(parts) != 2:
        return text[:most]
    k = int(most * len(parts[0]) / (len(parts[0]) + len(parts[1])))
    return parts[0][:k] + mark + parts[1][: most - k]


def test_truncate(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(["a", "é", "\n", X.SUMMARY], p=[0.6, 0.2, 0.18, 0.02]) for _ in range(rng.integers(0, 200))) for _ in range(300)] + [X.SUMMARY * 1, "x" * 100, "x" * 101]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r[1] for r in df.select("i", X.truncate_chunk(F.col("t"), 100)).orderBy("i").collect()] == [python_truncate(t, 100) for t in texts]


def test_comments_and_json(spark):
    df = spark.createDataFrame([("/** A.\n * B.\n */", '{"k": 1, "graph": {"elements": [1, 2]}}'), ("// c", "bad"), ("/* d */", "")], "c string, j string")
    assert [r[0] for r in df.select(X.clean_comment(F.col("c"))).collect()] == ["A.\nB.", "c", "d"]
    assert [tuple(r) for r in df.select(J.field(F.col("j"), "$.k"), F.size(J.elements(F.col("j")))).collect()] == [("1", 2), (None, 0), (None, 0)]
    assert [r[0] for r in df.select(J.content_of(F.col("j"), F.col("c"), "k")).collect()] == ["1", "// c", "/* d */"]


def test_store_table(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, v string").schema
    t = segments.Table(spark, f"file://{tmp_path}/t", schema, ["id"])

    def rows(*r):
        return spark.createDataFrame(list(r), schema)

    assert t.read().collect() == []
    t.insert(rows((1, "a"), (2, "b")))
    t.upsert(rows((2, "c"), (3, "d")))
    with pytest.raises(KeyError):
        t.insert(rows((3, "e")))
    with pytest.raises(KeyError):
        t.update(rows((9, "e")))
    t.update(rows((1, "z")))
    t.delete(rows((2, "")).select("id"))
    t.delete(rows().select("id"))
    assert {tuple(r) for r in t.read().collect()} == {(1, "z"), (3, "d")}
    assert [(r.v, r.score) for r in t.get(rows((3, "")).select("id")).collect()] == [("d", 0.0)]


def test_sync_keeps_domains_apart(spark):
    old = spark.createDataFrame([("x", "a", "1"), ("y", "a", "1"), ("x", "n", None)], "domain_id string, id string, asset_hash string")
    new = spark.createDataFrame([("x", "a", "1"), ("y", "a", "2"), ("z", "a", "1"), ("x", "n", None)], "domain_id string, id string, asset_hash string")
    assert {tuple(r) for r in sync.diff(old, new).collect()} == {("x", "a", "unchanged"), ("y", "a", "modified"), ("z", "a", "added"), ("x", "n", "unchanged")}


def test_embeddings(spark):
    config = EmbeddingConfig(dimension=16)
    one = embed_texts("alpha beta", config)
    assert len(one) == 16 and abs(sum(x * x for x in one) - 1) < 1e-6 and embed_texts(["alpha beta"], config) == [one]
    got = spark.createDataFrame([("alpha beta",), ("",), (None,)], "t string").select(embedding(F.col("t"), config)).collect()
    assert np.allclose(got[0][0], one) and set(got[2][0]) == {0.0}
    with pytest.raises(ValueError, match="nothing"):
        embed_texts([])
    with pytest.raises(ValueError, match="provider"):
        embed_texts("x", EmbeddingConfig(provider="none"))
    PROVIDERS.register("broken")(lambda config: lambda texts, mode: 1 / 0)
    with pytest.raises(RuntimeError, match="broken"):
        embed_texts("x", EmbeddingConfig(provider="broken"))


def test_index_sync_and_retrieval(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def alpha():\n    return 'apple pear'\n\ndef beta():\n    return 'river stone'\n")
    (src / "b.py").write_text("x = 1\n")
    index = Index(spark, f"file://{tmp_path}/state", EmbeddingConfig(dimension=64))
    run = lambda: index.sync(str(src), "code")
    assert run() == run().__class__(2, 2, 0, 2)
    n = run()
    assert (n.found, n.dirty, n.deleted, n.chunks) == (2, 0, 0, 0) and index.vectors.read().count() == 2
    (src / "a.py").write_text("def gamma():\n    return 'river stone'\n")
    (src / "b.py").unlink()
    n = run()
    assert (n.found, n.dirty, n.deleted, n.chunks) == (1, 1, 1, 1)
    assert [r.id for r in index.chunks.read().collect()] == ["a.py:0-1"] and [r.id for r in index.assets.read().collect()] == ["a.py"]
    asked = spark.createDataFrame([(1, "river stone"), (2, "nothing")], "qid long, question string")
    found = {r.qid: r for r in prompts(asked, {"code": index.search_store("code")}, 3, index.config).collect()}
    assert "gamma" in found[1].prompt
    assert "a.py:0-1" in search_tool({"code": index.search_store("code")}, "river", 3, index.config)[0]


def test_a_broken_sync_changes_nothing(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    for name in "ab":
        (src / f"{name}.py").write_text(f"def {name}():\n    return 1\n")
    index = Index(spark, f"file://{tmp_path}/state", EmbeddingConfig(dimension=8))

    def rows():
        return [sorted(r.id for r in level.read().collect()) for level in (index.assets, index.chunks, index.vectors)]

    commit = store.Versions.commit

    def fails(log, after, content):
        if "/state/" in log.path:
            raise OSError("lost")
        return commit(log, after, content)

    for step in range(3):
        before = rows()
        monkeypatch.setattr(store.Versions, "commit", fails)
        with pytest.raises(OSError, match="lost"):
            index.sync(str(src), "code")
        assert rows() == before
        monkeypatch.setattr(store.Versions, "commit", commit)
        index.sync(str(src), "code")
        assert rows() == [["a.py", "b.py"][: 2 - (step > 1)], *[["a.py:0-1", "b.py:0-1"][: 2 - (step > 1)]] * 2]
        if step == 0:
            (src / "a.py").write_text("def a():\n    return 2\n")
        else:
            (src / "b.py").unlink(missing_ok=True)
    other = Index(spark, f"file://{tmp_path}/state", EmbeddingConfig(dimension=8))
    other.sync(str(src), "b/../c")
    assert sorted(other.domain_ids()) == ["b/../c", "code"] and {r.id for r in other.domains.read().collect()} == {"b/../c", "code"}
    index.sweep("code")
    assert rows()[0] == ["a.py", "a.py"]


def test_the_second_of_two_writers_starts_over(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, v string").schema
    t = segments.Table(spark, f"file://{tmp_path}/t", schema, ["id"])
    t.insert(spark.createDataFrame([(1, "a")], schema))
    seen = []

    def make(now):
        if not seen:
            t.upsert(spark.createDataFrame([(2, "other")], schema))
        seen.append(now.count())
        return store.upsert(now, spark.createDataFrame([(3, "own")], schema), ["id"])

    t.change(make)
    assert seen == [1, 2] and {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "other"), (3, "own")}
    number, _ = t.versions.last()
    with pytest.raises(store.Conflict):
        t.versions.commit(number - 1, {})


def test_answers_and_progress(spark):
    rows = spark.createDataFrame([(1, "p", ["c"]), (2, "p", []), (3, "boom", ["c"])], "qid int, prompt string, retrieved_context array<string>")

    def model(prompt):
        return {"p": "fine"}[prompt]

    found = {r.qid: (r.answer, r.failed) for r in chat.answer(rows, model).collect()}
    assert found == {1: ("fine", False), 2: (chat.NO_CONTEXT, False), 3: (chat.FAILED, True)}
    asked = spark.createDataFrame([(1, None), (2, "RETRIEVING")], "qid int, failed string")
    steps = chat.progress(asked, failed_at="failed")
    got = {q: [r.status for r in steps.filter(F.col("qid") == q).orderBy("step").collect()] for q in (1, 2)}
    assert got == {1: list(chat.STEPS), 2: ["STARTING", "RETRIEVING", "ERROR"]}
    assert chat.out_of_order(steps).count() == 0
    assert chat.out_of_order(steps.withColumn("step", -F.col("step"))).count() > 0
