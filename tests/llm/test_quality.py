import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkspark.llm import quality_classifier as qc
from chunkspark.llm import quality_rules as qr
from chunkspark.llm.text import blocks

from .conftest import ODD


def expected(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def counts(texts):
    out = []
    for _, _, raw, offsets in blocks(pa.array(texts, pa.string()), most=40):
        out += zip(*(x.tolist() for x in qr.scan(raw, offsets, None)[0]), strict=True)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab #|\n\t\r\x0bé中 \U0001f600", max_size=40)), max_size=6))
def test_counts_equal_brute_force(texts):
    assert counts(texts) == [expected(t) for t in texts]


def test_counts_of_odd_texts():
    assert counts(ODD) == [expected(t) for t in ODD]


@pytest.fixture(scope="module")
def tables(spark):
    path = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def test_verdicts(spark, tables):
    docs, labels = tables
    found = {r.doc_id: r for r in qr.quality_report(docs, labels).collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    for r in found.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed) and 0 <= r.probability <= 1
    clean = [found[i] for i, q in quality.items() if q == 1 and not found[i].base_failed]
    junk = [found[i] for i, q in quality.items() if q == 0]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean) and sum(not r.kept for r in junk) >= 0.85 * len(junk)
    kept = qr.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found.values())


def test_rules_on_odd_rows_and_empty_tables(odd_docs, no_docs, no_labels):
    with pytest.raises(ValueError, match="labelled rows"):
        qr.quality_report(odd_docs, no_labels)
    found = qr.quality_report(odd_docs, no_labels, without_model=True).collect()
    assert len(found) == 15 and all(r.probability is None and r.kept == (not r.base_failed) for r in found)
    assert qr.drop_low_quality(odd_docs, no_labels, without_model=True).columns == odd_docs.columns
    assert qr.quality_report(no_docs, no_labels).collect() == []


def test_classifier_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    found = qc.classify(labelled, labels).select("doc_id", "held_out", "score", "predicted").collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
    out = [r for r in found if r.held_out]
    good, bad = (np.array([r.score for r in out if quality[r.doc_id] == q]) for q in (1, 0))
    assert (good[:, None] > bad[None]).mean() > 0.99
    assert np.mean([r.predicted == quality[r.doc_id] for r in out]) > 0.97


def test_labels_of_held_out_rows_are_not_read(spark, tables):
    docs, labels = tables
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (qc.learn(docs, x, "text", "doc_id", "quality") for x in (labels, flipped))
    assert one.rules == two.rules and np.array_equal(one.weights, two.weights) and one.bias == two.bias


def test_compiled_rules_equal_the_ensemble(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, len(qc.STATS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.4) | (x[:, 5] > 0.9)).astype(float)
    rules = qc.fit_rules(x, y, np.ones(300))
    assert 0 < len(rules.rules) < 300 and np.mean((rules.logit(x) > 0) == (y > 0)) > 0.9
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, " + ", ".join(f"{s} double" for s in qc.STATS))
    got = np.array([r.s for r in df.select("i", rules.score().alias("s")).orderBy("i").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-rules.logit(x))))


def test_classifier_on_odd_rows_and_empty_tables(odd_docs, no_docs, no_labels):
    found = qc.classify(odd_docs, no_labels).collect()
    assert len(found) == 15 and {r.score for r in found} == {0.5} and all(v is not None and v == v for r in found for v in r[2:])
    assert qc.classify(no_docs, no_labels).collect() == []


def plain_statistics(text):
    """The statistics by their names, without arrays."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n_words, chars, symbols, dups, repeated = expected(text)
    words, chars, n = max(n_words, 1), max(chars, 1), len
    letters = n(re.findall("[A-Za-z]", text))
    lines = text.count("\n") + (text != "")
    loud = [x for x in w if n(re.findall("[A-Za-z]", x)) > 1 and not re.search("[a-z]", x)]
    return [
        np.log1p(n_words), expected(text)[1] / words, symbols / words, dups / max(lines, 1), repeated / words, n(re.findall("[A-Z]", text)) / max(letters, 1),
        n(re.findall("[0-9]", text)) / chars, n(re.findall("[.,;:!?]", text)) / words, text.count("|") / words, n(re.findall("[!?]", text)) / words,
        n(re.findall(r"[#*$%&<>=@~^_{}\[\]\\/]", text)) / words, np.log1p(lines), n_words / max(lines, 1), sum(n(x.encode()) <= 3 for x in w) / words, sum(n(x.encode()) >= 12 for x in w) / words,
        n(set(w)) / words, n(re.findall("[^\x00-\x7f]", text)) / chars, n(loud) / words, n(re.findall("[.,;:!?]\n", text)) / max(lines, 1),
    ]


def all_statistics(texts, most=40):
    return np.concatenate([qc.statistics(raw, offsets) for _, _, raw, offsets in blocks(pa.array(texts, pa.string()), most=most)]) if texts else np.zeros((0, 19))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abAB9 .!#|\n\t\x0bé中\U0001f600", max_size=40)), max_size=6))
def test_statistics_equal_brute_force(texts):
    assert np.allclose(all_statistics(texts), np.array([plain_statistics(t) for t in texts]).reshape(-1, 19))


def test_statistics_of_odd_and_neighbouring_texts():
    texts = [*ODD, "ends with a stop.", "\nbegins with a break", "WORDS of $many# kinds_\n" * 50]
    assert np.allclose(all_statistics(texts, 1 << 20), [plain_statistics(t) for t in texts])


def test_weights_of_labels(spark, tables, monkeypatch):
    """Rows of a sample weigh as many as all usable rows with their label."""
    docs, labels = tables
    seen = []
    monkeypatch.setattr(qc, "TRAIN_ROWS", 30)
    monkeypatch.setattr(qc, "fit_rules", lambda x, y, weight: seen.append((y, weight)) or qc.RuleEnsemble([], np.zeros(0), 0.0))
    qc.learn(docs, labels, "text", "doc_id", "quality")
    y, weight = seen[0]
    usable = Counter(r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    assert Counter(y.tolist()) == {0: 30, 1: 30} and all(weight[y == v].sum() == pytest.approx(usable[v]) for v in (0, 1))
