"""Toxic sentences learnt from labels of whole documents: multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with probability p = 1 / (1 + exp(-z)), where z
sums weights of its distinct words, and a document if any of its sentences is: the noisy-or
1 - product of (1 - p). Labels of documents alone train the weights, by gradients through the
noisy-or, so the blame in a toxic document goes to the sentences that look it. A word's weight
is that of its hashed self and of its beginnings, which inflected words share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkspark.llm.quality_rules import labelled_sample
from chunkspark.llm.shared import slices
from chunkspark.llm.text import LETTERS, LOWER, U64, blocks, mix, row_of, span_hashes, table, word_bounds

#: Labelled rows of each label that the model is trained on, at most, and the longest text among them in characters.
TRAIN_ROWS, TRAIN_CHARS = 2500, 1 << 16
#: Fewest labelled rows of each label.
FEWEST_ROWS = 4
#: Buckets of words and their beginnings, beginnings in bytes, and documents that a bucket must occur in to have a weight.
BITS, BEGINNINGS, FEWEST_DOCS = 20, (3, 4, 5, 6, 7, 8), 6
STEPS, RATE, RIDGE, SPARSE = 150, 0.05, 1e-4, 0.1
TOXIC_FROM = 0.5
_END = table(b".!?\n")
_HEAD = ~table(range(0x80, 0xC0))  # first bytes of characters


def buckets(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(word, feature) buckets of words given their hashes: the word, then its beginnings, -1 where it is shorter than that."""
    drop = U64(64 - BITS)
    out = np.full((len(starts), 1 + len(BEGINNINGS)), -1, np.int32)
    out[:, 0] = words >> drop
    for k, n in enumerate(BEGINNINGS, 1):
        longer = np.flatnonzero(ends - starts >= n)
        part = span_hashes(raw, starts[longer], starts[longer] + n)
        out[longer, k] = mix(part + U64(n)) >> drop
    return out


@dataclass
class Bags:
    """Texts of one block as bags of sentences of distinct words."""

    first: np.ndarray  # first sentence of each row
    start: np.ndarray  # byte bounds of sentences with a word
    stop: np.ndarray
    sentence: np.ndarray  # of each entry
    word: np.ndarray  # of each entry, a row of `features`
    hashes: np.ndarray  # of words
    features: np.ndarray


def bags(raw: np.ndarray, offsets: np.ndarray) -> Bags:
    """Sentences end after . ! ? or a line break; those without a word of letters or digits are left out."""
    low = LOWER[raw]
    starts, ends, first = word_bounds(low, offsets, LETTERS)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Bags(np.zeros(len(offsets), np.int64), none, none, none, none, none.astype(U64), np.zeros((0, 1 + len(BEGINNINGS)), np.int32))
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(_END[raw]) + 1]))
    at = np.searchsorted(cuts, starts, "right") - 1
    full, sentence = np.unique(at, return_inverse=True)
    row = np.zeros(len(full), np.int64)
    row[sentence] = row_of(first)
    hashes, one, word = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
    entries = np.unique(sentence * len(hashes) + word)
    features = buckets(low, starts[one], ends[one], hashes)
    return Bags(np.searchsorted(row, np.arange(len(offsets))), cuts[full], cuts[full + 1], entries // len(hashes), entries % len(hashes), hashes, features)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class BagModel:
    weights: np.ndarray  # 2 ** BITS
    bias: float

    def logits(self, own: Bags) -> np.ndarray:
        """z of each sentence."""
        of_word = np.append(self.weights, np.float32(0))[own.features].sum(axis=1, dtype=np.float64)
        return self.bias + np.bincount(own.sentence, of_word[own.word], len(own.start))

    def scores(self, own: Bags, z: np.ndarray) -> np.ndarray:
        """Noisy-or of each row's sentences; 0 without any."""
        upto = np.concatenate([[0.0], np.cumsum(_softplus(z))])
        return np.clip(-np.expm1(upto[own.first[:-1]] - upto[own.first[1:]]), 0.0, 1.0)


def train(texts: list[str], toxic: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> BagModel | None:
    """Weights that make the noisy-or of sentences likely, given each document's label and weight; None with too few labels."""
    toxic = np.asarray(toxic, bool)
    if min(toxic.sum(), (~toxic).sum()) < FEWEST_ROWS:
        return None
    docs, sentences, entries, hashes, features = [], [], [], [], []
    n_docs = n_sentences = n_words = 0
    for a, b, raw, offsets in blocks(pa.array(texts, pa.large_string())):
        own = bags(raw, offsets)
        docs.append(row_of(own.first) + n_docs)
        sentences.append(own.sentence + n_sentences)
        entries.append(own.word + n_words)
        hashes.append(own.hashes)
        features.append(own.features)
        n_docs, n_sentences, n_words = n_docs + b - a, n_sentences + len(own.start), n_words + len(own.hashes)
    doc, sentence = np.concatenate(docs), np.concatenate(sentences)
    # one row for each word of all blocks
    _, one, name = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    word, features = name[np.concatenate(entries)], np.concatenate(features)[one]
    pairs = np.unique(doc[sentence] * len(one) + word)
    in_docs = np.bincount(features[pairs % max(len(one), 1)].ravel() + 1, minlength=(1 << BITS) + 1)[1:]
    used = np.flatnonzero(in_docs >= FEWEST_DOCS)
    place = np.full((1 << BITS) + 1, len(used))
    place[used] = np.arange(len(used))
    features = place[features]
    w, b = np.zeros(len(used) + 1), -np.log(1 + len(doc) / max(n_docs, 1))
    weight = weight / weight.sum()
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):  # Adam on the negative log-likelihood with a ridge term, then shrinking
        z = b + np.bincount(sentence, w[features].sum(axis=1)[word], len(doc))
        s = np.bincount(doc, _softplus(z), n_docs)
        pull = np.where(toxic, -1 / np.expm1(np.maximum(s, 1e-9)), 1.0) * weight
        dz = pull[doc] / (1 + np.exp(-np.clip(z, -40, 40)))
        of_word = np.bincount(word, dz[sentence], len(features))
        g = np.bincount(features.ravel(), np.repeat(of_word, features.shape[1]), len(w)) + RIDGE * w
        g[-1] = 0
        g = np.append(g, dz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * SPARSE, 0)
        w[-1] = 0
    out = np.zeros(1 << BITS, np.float32)
    out[used] = w[:-1]
    return BagModel(out, float(b))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: CRC-32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _trained(batches):
    texts, toxic, weight = [], [], []
    for batch in batches:
        texts += batch.column(2).to_pylist()
        toxic += batch.column(1).to_pylist()
        weight += batch.column(3).to_pylist()
    model = train(texts, np.array(toxic) == 1, np.array(weight))
    if model is not None:
        used = np.flatnonzero(model.weights).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([used.tobytes()], pa.binary()), pa.array([model.weights[used].tobytes()], pa.binary()), pa.array([model.bias])], names=["used", "weights", "bias"])


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> BagModel | None:
    """The model of a bounded sample of labelled rows that aren't held out, trained by one task; None with too few of a label.

    A label's rows weigh as much as all usable rows with it, so that scores fit the corpus.
    """
    usable = labels.filter(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    n = dict(usable.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect())  # two rows
    short = docs.filter(F.length(F.coalesce(F.col(text), F.lit(""))) <= TRAIN_CHARS)
    sample = labelled_sample(short, labels, text, doc_id, label, TRAIN_ROWS, lambda c: ~held_out(c))
    weight = F.when(F.col("_label") == 1, n.get(1, 0) / min(max(n.get(1, 0), 1), TRAIN_ROWS)).otherwise(n.get(0, 0) / min(max(n.get(0, 0), 1), TRAIN_ROWS))
    one = sample.select("_id", F.col("_label").cast("int").alias("_label"), "_text", weight.alias("_weight")).repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id")
    found = one.mapInArrow(_trained, "used binary, weights binary, bias double").collect()
    if not found:
        return None
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.frombuffer(found[0]["used"], np.uint32)] = np.frombuffer(found[0]["weights"], np.float32)
    return BagModel(weights, found[0]["bias"])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))


def _scored(model, at: int):
    def run(batches):
        m: BagModel | None = model.value
        for batch in slices(batches):
            for a, b, raw, offsets in blocks(batch.column(at)):
                own = bags(raw, offsets)
                z = m.logits(own) if m is not None else np.full(len(own.start), -np.inf)
                score = m.scores(own, z) if m is not None else np.full(b - a, 0.0)
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                hit = np.flatnonzero(p >= TOXIC_FROM)
                upto = np.concatenate([[0], np.cumsum(_HEAD[raw])])
                row = row_of(own.first)[hit]
                base = upto[offsets[row]]
                spans = pa.StructArray.from_arrays([pa.array(upto[own.start[hit]] - base), pa.array(upto[own.stop[hit]] - base), pa.array(p[hit])], ["start", "stop", "score"])
                bounds = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                columns = [pa.array(score), pa.array(np.diff(own.first)), pa.ListArray.from_arrays(pa.array(bounds), spans).cast(SPANS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["doc_id", "score", "n_sentences", "spans"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted, n_sentences, spans.

    `spans` are the sentences of a probability of TOXIC_FROM or more: start, stop (code points, end
    exclusive) and score. Scores depend on the text alone; null texts count as empty, and texts
    without words score 0. With fewer than FEWEST_ROWS labelled rows of either label every score is 0.
    Rows without an id are not held out, and are not learnt from either. Repeated rows are scored
    each for itself; other columns are ignored; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, text, doc_id, label))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    found = slim.mapInArrow(_scored(model, 1), f"doc_id {kind}, score double, n_sentences long, spans array<struct<start:long,stop:long,score:double>>")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= TOXIC_FROM, 1).otherwise(0).alias("predicted"), "n_sentences", "spans")
