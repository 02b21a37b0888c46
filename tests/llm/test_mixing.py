import re
from collections import Counter, defaultdict

import pytest

from chunkspark.llm.mixing import mix, mix_counts, source_targets
from chunkspark.llm.shared import materialise

from .conftest import sentence


def water(sizes):
    """Targets by the definition: shares by weight, those above three times their size stopped, the rest reshared."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        w = sum(weight[s] for s in rest)
        share = {s: (total - sum(fixed.values())) * weight[s] / w for s in rest} if rest and w else {}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


@pytest.fixture(scope="module")
def docs(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(1500):
        source = rng.choice(["big"] * 12 + ["é", "Z", "a", "tiny"] + [None]) if i > 3 else "tiny"
        n = rng.randrange(5) if source == "tiny" else rng.choice([2, 20, 90, 400])
        rows.append((i, sentence(rng, n) if n else rng.choice(["", None]), source, "x"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, mix_id string").repartition(6)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_sums(docs):
    rows, df = docs
    found = mix_counts(df).collect()
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += size(t)
    want, taken = water(sizes), defaultdict(int)
    by_id = {r[0]: r for r in rows}
    assert sorted(r.doc_id for r in found) == list(range(1500))
    for r in found:
        _, t, s, _ = by_id[r.doc_id]
        assert r.size == size(t) and r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[s] += r.taken
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.02, abs=5)
    assert any(v == 3 * sizes[s] for s, v in want.items()) and sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_agree_and_partitions_don_t_matter(docs):
    _, df = docs
    assert {tuple(r) for r in mix_counts(df).collect()} == {tuple(r) for r in mix_counts(df.repartition(3)).collect()}


def test_mix_repeats_rows(docs):
    rows, df = docs
    counts = {r.doc_id: r.copies for r in mix_counts(df).collect()}
    mixed = mix(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: c for i, c in counts.items() if c})


def test_importance_shifts_copies_within_a_source(spark):
    df = spark.createDataFrame([(i, "w " * 10, "a" if i < 300 else "b", 3.0 if i % 2 else 1.0) for i in range(400)], "doc_id long, text string, source string, q double")
    found = {r.doc_id: r for r in mix_counts(df, importance="q").collect()}
    odd, even = (sum(found[i].copies for i in range(300) if i % 2 == k) for k in (1, 0))
    assert odd > 1.8 * even
    assert sum(found[i].taken for i in range(300)) == pytest.approx(found[0].target, rel=0.02)


def test_weights_share_when_no_source_stops(spark):
    sized = materialise(spark.createDataFrame([(c, 100) for c in "abcd"], "source string, size long"), "s")
    assert {r.source: round(r.target, 3) for r in source_targets(sized).collect()} == {"a": 57.143, "b": 114.286, "c": 171.429, "d": 57.143}


def test_odd_rows_and_empty_tables(odd_docs, no_docs, spark):
    found = mix_counts(odd_docs).collect()
    assert len(found) == 15 and mix(odd_docs).columns == odd_docs.columns
    assert mix(odd_docs).count() == sum(r.copies for r in found)
    assert mix_counts(no_docs).collect() == [] and mix(no_docs).collect() == []
    blank = mix_counts(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert {(r.taken, r.target) for r in blank} == {(0, 0.0)}
