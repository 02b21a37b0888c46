"""Quality rules: counts over whole texts and a hashed n-gram model with fixed thresholds.

The model is a logistic regression over the frequencies of hashed words, word pairs and character
4-grams of a text, trained on a bounded sample of labelled rows and calibrated on rows that it
was not trained on. Executors hash the sample's texts and one of them trains; the driver sees the
weights only. It is scored in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkspark.llm.shared import fresh
from chunkspark.llm.text import NOT_SPACE, U64, blocks, equal_spans, mix, row_of, span_hashes, table, word_bounds

#: Buckets of each of the three feature families.
BITS = 16
#: Labelled rows of each label that the model is trained on, at most and at least.
TRAIN_ROWS, FEWEST_ROWS = 1500, 8
#: A document stays if its calibrated probability of good quality is at least this.
KEEP_FROM = 0.5
MIN_WORDS = 50
#: Percent of words in repeated 3-word windows above which a text fails.
MAX_REPEATED = 50
SYMBOLS = table(b"#*$%&|<>")
INSIDE_CHARS = NOT_SPACE & ~table(range(0x80, 0xC0))  # first bytes of characters in words
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_K = U64(0x9E3779B97F4A7C15)


def per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `mask` over [bounds[i], bounds[i + 1])."""
    upto = np.zeros(len(mask) + 1, np.float64 if mask.dtype.kind == "f" else np.int64)
    np.cumsum(mask, out=upto[1:])
    return upto[bounds[1:]] - upto[bounds[:-1]]


def dup_lines(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their row."""
    breaks = np.flatnonzero(raw == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    row = np.searchsorted(offsets, starts, "right") - 1
    # an empty row and a break at a row's end both yield empty lines; they have no word
    words = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(NOT_SPACE[raw], out=words[1:])
    full = (ends > starts) & (words[np.maximum(ends, starts)] > words[starts])
    starts, ends, row = starts[full], ends[full], row[full]
    keys = mix(span_hashes(raw, starts, ends) + row.astype(U64) * _K)
    _, first, name = np.unique(keys, return_index=True, return_inverse=True)
    again = np.ones(len(keys), bool)
    again[first] = False
    n = np.bincount(row[again], minlength=len(offsets) - 1)
    line, like = np.flatnonzero(again), first[name[again]]
    lengths = ends - starts
    same = (row[line] == row[like]) & (lengths[line] == lengths[like])
    same[same] = equal_spans(raw, starts[line[same]], lengths[line[same]], raw, starts[like[same]])
    for r in np.unique(np.concatenate([row[line[~same]], row[like[~same]]])).tolist():  # hashes clash
        own = [raw[a:b].tobytes() for a, b in zip(starts[row == r].tolist(), ends[row == r].tolist(), strict=True)]
        n[r] = len(own) - len(set(own))
    return n


def repeated_windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words in 3-word windows that their row has more than once."""
    covered = np.zeros(len(words), bool)
    if len(words) < 3:
        return covered
    at = np.flatnonzero(row[2:] == row[:-2])

    def hits(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Repeated windows, and the first window of each one's key."""
        keys = mix(words[at] + mix(words[at + 1]) * U64(3) + mix(words[at + 2] * U64(5)) + row[at].astype(U64) * _K)
        _, first, name, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        several = n[name] > 1
        return at[several], at[first[name[several]]]

    hit, like = hits(words)
    lengths = ends - starts
    same = row[hit] == row[like]
    for k in range(3):
        x, y = hit + k, like + k
        alike = lengths[x] == lengths[y]
        same &= alike & equal_spans(raw, starts[x], np.where(alike, lengths[x], 0), raw, starts[y])
    if not same.all():  # hashes clash: name windows by their words
        names: dict[tuple, int] = {}
        texts = [raw[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        key = np.array([names.setdefault((int(row[i]), *texts[i : i + 3]), len(names)) for i in at.tolist()])
        hit = at[np.bincount(key)[key] > 1]
    for k in range(3):
        covered[hit + k] = True
    return covered


def scan(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray | None):
    """Counts of each row (see COUNTS) and, with weights, the model's raw score."""
    starts, ends, first = word_bounds(raw, offsets, NOT_SPACE)
    words = span_hashes(raw, starts, ends)
    row = row_of(first)
    covered = repeated_windows(raw, starts, ends, words, row)
    counts = (np.diff(first), per_row(INSIDE_CHARS[raw], offsets), per_row(SYMBOLS[raw], offsets), dup_lines(raw, offsets), per_row(covered, first))
    if weights is None:
        return counts, None
    score = np.zeros(len(offsets) - 1)
    for family, (values, bounds) in enumerate(features(raw, offsets, words, first, row)):
        n = np.maximum(np.diff(bounds), 1)
        score += per_row(weights[family][values].astype(np.float64), bounds) / n
    return counts, score


def features(raw, offsets, words, first, row):
    """(buckets, bounds by row) of words, word pairs and character 4-grams."""
    drop = U64(64 - BITS)
    yield (words >> drop).astype(np.int32), first
    if len(words) > 1:
        at = np.flatnonzero(row[1:] == row[:-1])
        pairs = (mix(words[at] * U64(3) + words[at + 1]) >> drop).astype(np.int32)
        yield pairs, np.searchsorted(at, first)
    else:
        yield np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    chars, of_row = characters(raw, offsets)
    if len(chars) > 3:
        grams = chars[:-3].copy()
        for k in range(1, 4):
            grams = grams * _K + chars[k : len(chars) - 3 + k]
        grams = ((grams * _K) >> drop).astype(np.int32)
        starts = np.arange(len(grams))
        # grams that reach into the next row
        inside = starts + 3 < of_row[np.searchsorted(of_row, starts, "right")]
        at = np.flatnonzero(inside)
        yield grams[at], np.searchsorted(at, of_row)
    else:
        yield np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)


def characters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the UTF-8 bytes of each character as one number, first character of each row)."""
    wide = raw >= 0x80
    if not wide.any():
        return raw.astype(U64), offsets
    begins = ~(wide & (raw < 0xC0))
    at = np.flatnonzero(begins)
    chars = raw[at].astype(U64)
    ends = np.append(at[1:], len(raw))
    for k in range(1, 4):
        more = np.flatnonzero(ends - at > k)
        chars[more] |= raw[at[more] + k].astype(U64) << U64(8 * k)
    return chars, np.searchsorted(at, offsets)


@dataclass
class NgramModel:
    weights: np.ndarray  # (3, 2 ** BITS)
    slope: float
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -30, 30)))


def _platt(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit of labels to scores, by Newton's method, slightly damped."""
    scale = float(np.std(score)) or 1.0
    x = np.stack([score / scale, np.ones_like(score)], 1)
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - target) + 1e-2 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def frequencies(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets of all families, their frequencies) of each row."""
    starts, ends, first = word_bounds(raw, offsets, NOT_SPACE)
    words = span_hashes(raw, starts, ends)
    idx, val, of = [], [], []
    for family, (values, bounds) in enumerate(features(raw, offsets, words, first, row_of(first))):
        row = row_of(bounds)
        keys, n = np.unique(row.astype(np.int64) << 32 | (values.astype(np.int64) + family * (1 << BITS)), return_counts=True)
        r = keys >> 32
        idx.append((keys & 0xFFFFFFFF).astype(np.uint32))
        val.append((n / np.maximum(np.diff(bounds), 1)[r]).astype(np.float32))
        of.append(r)
    order = np.argsort(np.concatenate(of), kind="stable")
    idx, val, of = (np.concatenate(x)[order] for x in (idx, val, of))
    cuts = np.searchsorted(of, np.arange(len(offsets)))
    return [(idx[a:b], val[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def train(sample: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, steps: int = 150) -> NgramModel | None:
    """The model of labelled texts, given their `frequencies`; None where a label has fewer than FEWEST_ROWS rows."""
    good = np.asarray(good, bool)
    if min(good.sum(), (~good).sum()) < FEWEST_ROWS:
        return None
    n_texts, sizes = len(sample), np.array([len(x) for x, _ in sample])
    idx = np.concatenate([x for x, _ in sample]).astype(np.int32)
    val = np.concatenate([x for _, x in sample]).astype(np.float32)
    sample.clear()
    # rare and common buckets alike: each is scaled by its root mean square. Sums go along runs of
    # one row or of one bucket, over arrays of 32 bits
    order = np.argsort(idx, kind="stable").astype(np.int32)
    buckets, by_bucket = np.unique(idx[order], return_index=True)
    rms = np.full(3 << BITS, 1e-4, np.float32)
    rms[buckets] += np.sqrt(np.add.reduceat(np.square(val[order]), by_bucket) / n_texts) if len(buckets) else 0
    val /= rms[idx]
    full = np.flatnonzero(sizes)
    by_row = (np.cumsum(sizes) - sizes)[full]
    val_of_bucket, row_of_bucket = val[order], np.repeat(np.arange(n_texts, dtype=np.int32), sizes)[order]
    del order

    def scores(w: np.ndarray) -> np.ndarray:
        out = np.zeros(n_texts)
        if len(full):
            out[full] = np.add.reduceat(val * w[idx], by_row)
        return out

    fit = np.arange(n_texts) % 4 != 3
    share = np.where(good, 0.5 / good[fit].sum(), 0.5 / (~good)[fit].sum()) * fit
    w, mean, var = (np.zeros(3 << BITS, np.float32) for _ in range(3))
    b = 0.0
    for t in range(1, steps + 1):  # Adam on the balanced logistic loss with a ridge term
        err = (1 / (1 + np.exp(-np.clip(scores(w) + b, -30, 30))) - good) * share
        g = np.float32(2e-6) * w
        if len(buckets):
            g[buckets] += np.add.reduceat(val_of_bucket * err.astype(np.float32)[row_of_bucket], by_bucket)
        b -= 0.5 * err.sum()
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        w = w - (0.003 * (mean / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-5)).astype(np.float32)
    score = scores(w)
    w = w / rms
    slope, shift = _platt(score[~fit], good[~fit])
    return NgramModel(w.reshape(3, -1).astype(np.float32), slope, shift)


def labelled_sample(df: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, most: int = TRAIN_ROWS, where=None) -> DataFrame:
    """_id, _label, _text of up to `most` ids of each label, chosen by a hash of the id; one row for each id.

    Only the chosen ids (2 * `most` rows at most) are broadcast, so the documents are not shuffled.
    An id with both labels, or several texts, counts once, by the smallest.
    """
    ids = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).filter("_id is not null and _label in (0, 1)")
    if where is not None:
        ids = ids.filter(where(F.col("_id")))
    ids = ids.groupBy("_id").agg(F.min("_label").alias("_label"))
    chosen = None
    for value in (0, 1):
        some = ids.filter(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = df.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def _hashed(batches):
    for batch in batches:
        keys, label = batch.column(0), batch.column(1)
        for a, b, raw, offsets in blocks(batch.column(2)):
            found = frequencies(raw, offsets)
            binary = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), label.slice(a, b - a), *binary], names=["_id", "_label", "idx", "val"])


def _trained(batches):
    sample, good = [], []
    for batch in batches:
        good += batch.column(1).to_pylist()
        for idx, val in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            sample.append((np.frombuffer(idx, np.uint32), np.frombuffer(val, np.float32)))
    model = train(sample, np.array(good) == 1)
    if model is not None:
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.slope]), pa.array([model.shift])], names=["weights", "slope", "shift"])


def fit(df: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str) -> NgramModel | None:
    """The model of a bounded sample of labelled rows, trained by one task.

    That task holds at most 3 * 2 ** BITS frequencies of a row, however long its text is.
    """
    sample = labelled_sample(df, labels, text, doc_id, label).select("_id", F.col("_label").cast("int").alias("_label"), "_text")
    kind = sample.schema["_id"].dataType.simpleString()
    hashed = sample.mapInArrow(_hashed, f"_id {kind}, _label int, idx binary, val binary")
    one = hashed.repartition(1).sortWithinPartitions(F.xxhash64("_id"), "_id")
    found = one.mapInArrow(_trained, "weights binary, slope double, shift double").collect()
    return NgramModel(np.frombuffer(found[0]["weights"], np.float32).reshape(3, -1), found[0]["slope"], found[0]["shift"]) if found else None


def _scored(at: int, model, names: list[str]):
    """Rows go out block by block, so a worker holds one batch and no copy of it."""

    def run(batches):
        m: NgramModel | None = model.value
        weights = None if m is None else m.weights
        for batch in batches:
            for a, b, raw, offsets in blocks(batch.column(at)):
                counts, score = scan(raw, offsets, weights)
                p = np.full(b - a, np.nan) if m is None else m.probability(score)
                own = [*(pa.array(x.astype(np.int64)) for x in counts), pa.array(p, pa.float64(), from_pandas=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *own], names=[*batch.schema.names, *names])

    return run


def score_quality(df: DataFrame, labels: DataFrame | None, text: str = "text", doc_id: str = "doc_id", label: str = "quality", keep: list[str] | None = None, names: list[str] | None = None, without_model: bool = False) -> DataFrame:
    """Columns `keep` of `df` (all by default), then the five counts and the probability of good quality.

    `names` renames those six columns. Null texts count as empty. FEWEST_ROWS labelled rows of each
    label are needed for a model; with fewer, `without_model` gives null probabilities, and else
    it is an error. Empty tables give no rows, repeated rows are scored each for itself.
    """
    found = fit(df, labels, text, doc_id, label) if labels is not None else None
    if found is None and not without_model and not df.isEmpty():
        raise ValueError(f"a model needs {FEWEST_ROWS} labelled rows of each label")
    model = df.sparkSession.sparkContext.broadcast(found)
    keep = list(df.columns) if keep is None else keep
    own = fresh(df, "quality_text")
    slim = df.select(*keep, F.col(text).alias(own))
    names = names or [*COUNTS, "probability"]
    schema = T.StructType([*slim.schema.fields, *(T.StructField(n, T.LongType()) for n in names[:5]), T.StructField(names[5], T.DoubleType())])
    return slim.mapInArrow(_scored(len(keep), model, names), schema).drop(own)


def base_failed(n_words: str, n_repeat: str):
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat) > MAX_REPEATED * F.col(n_words))


def quality_report(df: DataFrame, labels: DataFrame | None, text: str = "text", doc_id: str = "doc_id", without_model: bool = False) -> DataFrame:
    """One row per row of `df`: doc_id, the five counts, probability, base_failed, kept.

    Where `without_model` lets there be no model, the base rules alone decide.
    """
    out = score_quality(df, labels, text, doc_id, keep=[doc_id], without_model=without_model).withColumn("base_failed", base_failed("n_words", "n_repeat_words"))
    return out.withColumn("kept", ~F.col("base_failed") & passes("probability"))


def passes(probability: str):
    return F.coalesce(F.col(probability) >= KEEP_FROM, F.lit(True))


def drop_low_quality(df: DataFrame, labels: DataFrame | None, text: str = "text", doc_id: str = "doc_id", without_model: bool = False) -> DataFrame:
    """The rows of `df` that `quality_report` keeps, with all their columns."""
    names = [fresh(df, f"quality_{c}") for c in (*COUNTS, "probability")]
    scored = score_quality(df, labels, text, doc_id, names=names, without_model=without_model)
    return scored.filter(~base_failed(names[0], names[4]) & passes(names[5])).select(*df.columns)
