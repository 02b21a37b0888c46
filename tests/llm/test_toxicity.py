import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkspark.llm import toxicity as tx
from chunkspark.llm.text import blocks, hash_text, mix

from .conftest import ODD


def plain_words(sentence):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in sentence)
    return set(re.findall(r"[0-9a-z\x80-\U0010FFFF]+", low))


def plain_sentences(text):
    """(start, stop, distinct words) of sentences with words, in code points."""
    out, at = [], 0
    for m in re.finditer(r"[^.!?\n]*[.!?\n]|[^.!?\n]+", text or ""):
        if w := plain_words(m[0]):
            out.append((m.start(), m.end(), w))
    return out


def plain_weight(model, word):
    raw = word.encode()
    own = [hash_text([raw])[0]] + [mix(hash_text([raw[:n]]) + np.uint64(n))[0] for n in tx.BEGINNINGS if len(raw) >= n]
    return sum(float(model.weights[int(h) >> (64 - tx.BITS)]) for h in own)


def plain_score(model, text):
    spans, none = [], 1.0
    for a, b, words in plain_sentences(text):
        p = 1 / (1 + math.exp(-(model.bias + sum(plain_weight(model, w) for w in words))))
        none *= 1 - p
        spans += [(a, b)] if p >= tx.TOXIC_FROM else []
    return 1 - none, spans


def scored(model, texts, most=60):
    class Shared:
        value = model

    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    rows = [r for b in tx._scored(Shared, 1)(iter([batch])) for r in b.to_pylist()]
    return [(r["score"], [(s["start"], s["stop"]) for s in r["spans"]], r["n_sentences"]) for r in rows]


def random_model(seed=3):
    rng = np.random.default_rng(seed)
    return tx.BagModel(rng.normal(0, 1, 1 << tx.BITS).astype(np.float32), -1.0)


MODEL = random_model()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abIDIOT .!?\n\réÄ中\U0001f600#9", max_size=50)), max_size=6))
def test_scores_and_spans_equal_brute_force(texts):
    for (score, spans, n), text in zip(scored(MODEL, texts), texts, strict=True):
        want, places = plain_score(MODEL, text)
        assert abs(score - want) < 1e-5 and spans == places and n == len(plain_sentences(text))


def test_scores_of_odd_texts():
    for (score, spans, _), text in zip(scored(MODEL, ODD), ODD, strict=True):
        want, places = plain_score(MODEL, text)
        assert abs(score - want) < 1e-5 and spans == places


def bag_texts(rng, n):
    """Documents of clean sentences, half of them with one bad sentence; where it stands is not told to the model."""
    clean = [f"w{i}" for i in range(300)]
    texts, toxic, places = [], [], []
    for i in range(n):
        parts = [" ".join(rng.choice(clean) for _ in range(8)) for _ in range(rng.randrange(2, 12))]
        bad = rng.randrange(len(parts)) if i % 2 else None
        if bad is not None:
            parts[bad] += rng.choice([" vileness", " vilely", " foul", " foulest"])
        texts.append(". ".join(parts) + ".")
        toxic.append(i % 2)
        places.append(bad)
    return texts, np.array(toxic), places


def test_training_on_labels_of_documents_finds_the_sentences():
    rng = random.Random(1)
    texts, toxic, places = bag_texts(rng, 1600)
    model = tx.train(texts[:1400], toxic[:1400], np.ones(1400))
    right = located = found = 0
    for text, y, bad in list(zip(texts, toxic, places, strict=True))[1400:]:
        score, spans = plain_score(model, text)
        right += (score >= 0.5) == y
        if y and spans:
            found += 1
            located += [p[:2] for p in plain_sentences(text)].index(spans[0]) == bad and len(spans) == 1
    assert right >= 195 and found >= 90 and located >= 0.97 * found
    assert tx.train(texts[:4], toxic[:4], np.ones(4)) is None


def test_gradient_is_that_of_the_likelihood():
    """Training lowers the weighted negative log-likelihood of noisy-or, and one more step changes little."""
    texts, toxic, _ = bag_texts(random.Random(2), 120)
    weight = np.where(toxic == 1, 2.0, 1.0)

    def loss(model):
        total = 0.0
        for t, y, w in zip(texts, toxic, weight, strict=True):
            p = min(max(plain_score(model, t)[0], 1e-12), 1 - 1e-12)
            total -= w * math.log(p if y else 1 - p)
        return total / weight.sum()

    losses = [loss(tx.train(texts, toxic, weight, steps)) for steps in (1, 20, 80, 150)]
    assert losses[0] > losses[1] > losses[2] > 0 and losses[3] < 0.1


@pytest.fixture(scope="module")
def tables(spark):
    path = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def test_held_out_rows(spark, tables):
    docs, labels = tables
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    found = tx.score_toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).collect()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1
    out = [r for r in found if r.held_out]
    bad, clean = (np.array([r.score for r in out if toxic[r.doc_id] == y]) for y in (1, 0))
    assert (bad[:, None] > clean[None]).mean() > 0.95 and (bad >= 0.5).mean() > 0.7 and (clean >= 0.5).mean() < 0.01


def test_labels_of_held_out_rows_are_not_read(spark, tables):
    from pyspark.sql import functions as F

    docs, labels = (t.filter("doc_id < 900") for t in tables)
    flipped = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (tx.learn(docs, x) for x in (labels, flipped))
    assert np.array_equal(one.weights, two.weights) and one.bias == two.bias and one.weights.any()


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs, no_labels):
    assert tx.score_toxicity(no_docs, no_labels).collect() == []
    found = tx.score_toxicity(odd_docs, no_labels).collect()
    assert len(found) == 15 and {(r.score, r.predicted, len(r.spans)) for r in found} == {(0.0, 0, 0)}
    texts, toxic, _ = bag_texts(random.Random(6), 200)
    texts[1] = texts[3] = "foul " * 60_000  # too long to learn from, but scored
    rows = [(i, t, 0.5, 1) for i, t in enumerate(texts)] + [(None, "foul", 0.5, 1), (1, texts[1], 0.5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, spans int")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    found = tx.score_toxicity(docs, labels).collect()
    assert len(found) == 202 and sum(r.doc_id == 1 for r in found) == 2
    assert all(r.predicted == 1 for r in found if r.doc_id in (None, 1, 3))
