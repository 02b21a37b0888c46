import hashlib
from collections import defaultdict

from chunkspark.llm.exact_dedup import drop_duplicates, duplicate_groups, merge_runs, with_digests
from chunkspark.llm.shared import materialise

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOW)].append(i)
    return groups


def test_groups_equal_brute_force(spark, rng):
    rows = [(i, rng.choice(["A b", "a B", "c", "Éa", "éa", "", None])) for i in range(400)]
    found = duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(40)).collect()
    want = expected(rows)
    by_id = dict(rows)
    assert len(found) == 400 and sum(r.kept for r in found) == len(want)
    for r in found:
        own = want[(by_id[r.doc_id] or "").translate(LOW)]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert bytes(r.digest) == hashlib.sha256((by_id[r.doc_id] or "").translate(LOW).encode()).digest()


def test_smallest_stays(spark):
    df = spark.createDataFrame([(3, "a"), (1, "A"), (2, "b"), (None, "a")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in duplicate_groups(df, keep="smallest").collect()}
    assert got == {(3, 1, False), (1, 1, True), (2, 2, True), (None, 1, False)}


def test_many_runs_take_several_rounds(spark):
    df = spark.range(0, 3000, 1, 300).selectExpr("id as doc_id", "cast(id % 7 as string) as text")
    signatures = materialise(with_digests(df, "text", "tag", "digest", "n_bytes").selectExpr("doc_id as id", "tag", "digest", "n_bytes"), "t")
    merged = merge_runs(signatures, bits=2).collect()
    assert sorted(r.keep_id for r in merged) == list(range(2993, 3000)) and {r.group_size for r in merged} == {428, 429}


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    found = duplicate_groups(odd_docs).collect()
    assert len(found) == 15
    twice = [r for r in found if r.doc_id == 12]
    assert sorted(r.kept for r in twice) == [False, True] and {r.group_size for r in twice} == {2}
    kept = drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, 10, 11, 12, None]))
    assert duplicate_groups(no_docs).collect() == [] and drop_duplicates(no_docs).collect() == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, 6), (2, "A", 7, 8)], "doc_id long, text string, row_tag int, row_digest int")
    assert [tuple(r) for r in drop_duplicates(df).collect()] == [(2, "A", 7, 8)]


def test_digests_of_large_batches():
    """Batches of more rows and bytes than a block, and slices of a batch."""
    import pyarrow as pa

    from chunkspark.llm.exact_dedup import _digests

    texts = [None if i % 97 == 0 else f"Text É {i} " + "X" * (i % 50) * (100 if i % 11 == 0 else 1) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts, pa.string())], names=["i", "t"])
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lower in (True, False):
        for given in ([batch], [batch.slice(0, 700), batch.slice(700, 1), batch.slice(701)]):
            found = [r for x in _digests("t", lower, ["d", "n"])(given) for r in x.to_pylist()]
            assert [r["i"] for r in found] == list(range(3000))
            for r in found:
                data = ((r["t"] or "").translate(low) if lower else r["t"] or "").encode()
                assert r["d"] == hashlib.sha256(data).digest() and r["n"] == len(data)


def test_texts_are_not_shuffled_for_a_few_copies(spark):
    docs = spark.createDataFrame([(i, f"text number {i % 195}") for i in range(200)], "doc_id long, text string")
    found = drop_duplicates(docs)
    assert found.count() == 195
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" not in plan and "hashpartitioning" not in plan
