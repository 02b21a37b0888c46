"""Queries that take all of their input, against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkspark.catalog import QUERIES
from chunkspark.config import EmbeddingConfig
from chunkspark.operators import search
from chunkspark.operators.embed import embed_texts
from chunkspark.operators.graph import group_ids


def test_batch_asks_every_fiftieth_vector(spark, tmp_path, monkeypatch):
    """Also over several blocks of queries, several slices of rows and many equal vectors."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)] if i % 7 else [0.3] * 6) for i in range(1203)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(search, "QUERY_BLOCK", 10)
    monkeypatch.setattr(search, "CELLS", 700)
    found = {(r.qid, r.rk): r.vec_id for r in QUERIES["w1_batch_knn"](spark, str(tmp_path)).collect()}
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    want = {}
    for q in range(0, 1203, 50):
        d = np.round(np.sqrt(((v - v[q]) ** 2).sum(1)), 6)
        want |= {(q, n + 1): int(i) for n, i in enumerate(np.lexsort((np.arange(len(v)), d))[:5])}
    assert found == want


def test_batch_within_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [None, "a", "b", "rare"][min(i % 3 + (i == 5), 3)], [float(x) for x in rng.normal(size=4)] if i % 9 else None) for i in range(300)]
    store = spark.createDataFrame(rows, "id long, source string, embedding array<float>").repartition(4)
    asked = store.filter("id in (1, 2, 5)").select(F.col("id").alias("qid"), F.col("embedding").cast("array<double>").alias("qv"))
    found = {(r.qid, r.source, r.rk): r.id for r in search.batch_nearest(store, asked, 4, within="source").collect()}
    vectors = {i: np.array(v, np.float32).astype(float) for i, _, v in rows if v}
    want = {}
    for q in (1, 2, 5):
        for s in {r[1] for r in rows}:
            own = sorted((np.linalg.norm(vectors[i] - vectors[q]), i) for i, t, v in rows if t == s and v)[:4]
            want |= {(q, s, n + 1): i for n, (_, i) in enumerate(own)}
    assert found == want


def brute_components(nodes, boxes, edges):
    """Group of each node (id, x, y) after boxes and then edges (start, end), by relabelling all nodes each time."""
    group = list(range(len(nodes)))
    for x0, x1, y0, y1 in boxes:
        inside = [i for i, (_, x, y) in enumerate(nodes) if x0 <= x <= x1 and y0 <= y <= y1]
        for i in inside[1:]:
            group[i] = group[inside[0]]
    place = {n[0]: i for i, n in enumerate(nodes)}
    for s, t in edges:
        if s in place and t in place:
            low, high = sorted((group[place[s]], group[place[t]]))
            group = [low if g == high else g for g in group]
    return {n[0]: nodes[g][0] for n, g in zip(nodes, group, strict=True)}


def test_components_use_every_order(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy("c_custkey").collect()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy("o_orderkey").collect()
    boxes = [(x, x + 900, y, y + 40) for x, y in ((0, 0), (500, 20), (6000, 30))]
    want = {}
    for nation in {c.c_nationkey for c in customers}:
        nodes = [(c.c_custkey, c.c_acctbal, c.c_custkey % 97) for c in customers if c.c_nationkey == nation]
        own = {n[0] for n in nodes}
        want |= brute_components(nodes, boxes, [(o.o_custkey, o.o_custkey + 25 * (o.o_orderkey % 5 + 1)) for o in orders if o.o_custkey in own])
    found = {int(r.id): int(r.component) for r in QUERIES["a2_components"](spark, sf_dir).collect()}
    assert found == want


def test_groups_equal_relabelling():
    rng = np.random.default_rng(6)
    for _ in range(30):
        nodes = [(str(i), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (40, 2)))]
        boxes = [(x, x + 4, y, y + 4) for x, y in rng.uniform(0, 8, (3, 2))]
        edges = [(str(a), str(b)) for a, b in rng.integers(0, 45, (25, 2))]
        got = group_ids([{"id": i, "x": x, "y": y} for i, x, y in nodes], [dict(zip(("x_min", "x_max", "y_min", "y_max"), b, strict=True)) for b in boxes], [{"start_id": s, "end_id": t} for s, t in edges])
        assert {n[0]: nodes[g][0] for n, g in zip(nodes, got, strict=True)} == brute_components(nodes, boxes, edges)


@pytest.mark.parametrize("transitive", [False, True])
@pytest.mark.parametrize("pairs", [0, 1 << 19])
def test_components_without_whole_files(spark, monkeypatch, pairs, transitive):
    """Files of chains, of overlapping boxes, of ids given twice and of edges without an end, as each file alone gives them."""
    from chunkspark.operators import graph

    monkeypatch.setattr(graph, "PAIRS", pairs, raising=False)
    rng = np.random.default_rng(13)
    nodes, boxes, edges, want = [], [], [], {}
    for f in range(6):
        n = [40, 40, 40, 1, 40, 60][f]
        own = [{"id": str(i if f != 2 else i // 2), "x": float(x), "y": float(y)} for i, (x, y) in enumerate(rng.uniform(0, 10, (n, 2)))]
        own_boxes = [{"x_min": x, "x_max": x + 4, "y_min": y, "y_max": y + 4} for x, y in rng.uniform(0, 8, ([9, 3, 3, 1, 0, 0][f], 2)).tolist()]
        ends = [(i + 1, i) for i in rng.permutation(59)] if f == 5 else rng.integers(0, 48, (14, 2))
        own_edges = [{"start_id": str(a), "end_id": str(b)} for a, b in ends]
        group = group_ids(own, own_boxes, own_edges, transitive)
        want |= {(str(f), i): (x["id"], own[g]["id"]) for i, (x, g) in enumerate(zip(own, group, strict=True))}
        for kept, rows in ((nodes, own), (boxes, own_boxes), (edges, own_edges)):
            kept += [{"file": str(f), "position": i} | r for i, r in enumerate(rows)]
    frames = [spark.createDataFrame(rows).withColumn("position", F.col("position").cast("int")).repartition(3) for rows in (nodes, boxes, edges)]
    found = graph.components(*frames, transitive)
    assert pairs or "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert Counter((r.file, r.id, r.component) for r in found.collect()) == Counter((f, *v) for (f, _), v in want.items())


def test_every_order_is_an_edge(spark, sf_dir):
    assert QUERIES["j8_edges"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_retrieval_searches_every_source(spark, tmp_path):
    """With a source without a name, a source of one document, equal and missing texts."""
    rng = np.random.default_rng(7)
    words = ["river", "stone", "cloud", "paper", "light", "mill", "data", "été"]
    texts = [" ".join(rng.choice(words, 1 + i % 9)) for i in range(120)]
    docs = [(i, "the same text" if i % 8 == 0 else None if i % 31 == 5 else texts[i], "lone" if i == 7 else [None, "src0", "src2", "hot", "hot"][i % 5]) for i in range(120)]
    asked = [(i, " ".join(rng.choice(words, 4))) for i in range(6)] + [(6, "the same")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.qid, r.domain, r.rk): r.doc_id for r in QUERIES["x9_retrieve"](spark, str(tmp_path)).collect()}
    config = EmbeddingConfig(dimension=256)
    v = np.array(embed_texts([t or "" for _, t, _ in docs], config))
    want = {}
    for q, text in asked:
        d = np.round(np.linalg.norm(v - np.array(embed_texts(text, config, "query")), axis=1), 6)
        for s in {x[2] for x in docs}:
            own = sorted((d[i], i) for i, _, t in docs if t == s)[:3]
            want |= {(q, s, n + 1): i for n, (_, i) in enumerate(own)}
    assert found == want


def test_embedding_of_every_document(spark, tmp_path):
    """Long, missing, empty and repeated texts; each vector is counted from the whole text."""
    texts = ["river stone", None, "", "river stone", " \n", "été Größe " * 30_000 + "last", "x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.embedding for r in QUERIES["x1_embed"](spark, str(tmp_path)).collect()}
    assert sorted(found) == list(range(len(texts)))
    for i, text in enumerate(texts):
        want = np.zeros(64)
        for word, n in Counter(re.findall(r"\w+", (text or "").lower())).items():
            h = zlib.crc32(word.encode())
            want[h % 64] += n if h >> 31 else -n
        assert np.allclose(found[i], want / (np.linalg.norm(want) or 1), atol=1e-6)


def test_recall_of_cells(spark, sf_dir):
    """Recall at 10 of the registered query, over every vector whose id is divisible by 50."""
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    found = {}
    for r in QUERIES["k4_cells"](spark, sf_dir).collect():
        found.setdefault(r.qid, set()).add(r.vec_id)
    asked = [i for i in rows if i % 50 == 0]
    exact = {q: set(sorted(rows, key=lambda i: (float(np.linalg.norm(rows[i] - rows[q])), i))[:10]) for q in asked}
    assert sum(len(exact[q] & found[q]) for q in asked) >= 0.9 * 10 * len(asked) > 0
    assert all(len(x) == 10 for x in found.values())


def test_cells_make_no_pairs(spark, monkeypatch):
    """Cells of many rows, one of them with most, in parts: no join of questions with rows, and all cells together are exact. Questions without a vector find nothing."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(900, 6)).astype(np.float32)
    x[200:600] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(990, None)]
    store = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = store.filter("id % 30 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qv"))
    monkeypatch.setattr(search, "PART_ROWS", 100, raising=False)
    monkeypatch.setattr(search, "PART_QUESTIONS", 9, raising=False)
    centres = search.fit_centres(store, cells=7)
    found = search.approximate_batch(search.with_cells(store, centres), centres, asked, 5, probes=7)
    assert "Join" not in found._jdf.queryExecution().toString()
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.rk):
        got.setdefault(r.qid, []).append(r.id)
    v = x.astype(float)
    assert got == {q: list(np.lexsort((np.arange(900), np.sqrt(np.square(v - v[q]).sum(axis=1))))[:5]) for q in range(0, 900, 30)}


@pytest.mark.parametrize("scale", [None, 1, 100])
def test_lsh_recall_of_the_registered_query(spark, sf_dir, scale):
    """Recall at 10 with the default tables, over every vector whose id is divisible by 50; also for norms of 1 to 3 and of 100 to 300."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    if scale:
        e = e.withColumn("embedding", F.transform("embedding", lambda x: x * scale * (1 + F.col("vec_id") % 3)))
    rows = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    asked, hits = [i for i in rows if i % 50 == 0], 0
    for q in asked:
        exact = sorted(rows, key=lambda i: (round(float(np.linalg.norm(rows[i] - rows[q])), 6), i))[:10]
        hits += len(set(exact) & {r.vec_id for r in search.approximate_nearest(e, rows[q], 10, "vec_id").collect()})
    assert hits >= 0.9 * 10 * len(asked) > 0


def test_default_limits(spark, tmp_path):
    """Texts of 9,999 to 10,001 characters and sizes of 999,999 to 1,000,001, in all three shapes of f2_truncate."""
    mark, sizes = "\nSUMMARY:\n", [9_968, 9_999, 10_000, 10_001, 20_003]
    rows = [(i, "abcdé" * (n // 5) + "z" * (n % 5), "en", "src0", size) for i, (n, size) in enumerate(((n, s) for n in sizes for s in (999_999, 1_000_000, 1_000_001)), 100)]
    rows += [(r[0] + shift, *r[1:]) for r in rows for shift in (100, 200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.text for r in QUERIES["f2_truncate_default"](spark, str(tmp_path)).collect()}
    want = {}
    for i, text, lang, source, _ in rows:
        t = (text, text + mark + lang + source, lang + mark + text + mark)[i % 3]
        parts = t.split(mark)
        if len(t) > 10_000 and len(parts) == 2:
            k = 10_000 * len(parts[0]) // (len(parts[0]) + len(parts[1]))
            t = parts[0][:k] + mark + parts[1][: 10_000 - k]
        want[i] = t if len(t) <= 10_000 or len(parts) == 2 else t[:10_000]
    assert found == want
    assert {r.doc_id for r in QUERIES["p3_size_default"](spark, str(tmp_path)).collect()} == {r[0] for r in rows if r[4] <= 1_000_000}
