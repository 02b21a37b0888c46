"""Quality by a sparse ensemble of rules over text statistics.

Small trees are grown on the statistics of labelled rows, each on what the trees before it leave.
Every path from a root to a node is a rule, a conjunction of comparisons. A logistic regression
with an L1 penalty keeps few of them, and the weighted rules become one Spark column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkspark.llm.quality_rules import labelled_sample, per_row, scan
from chunkspark.llm.shared import fresh
from chunkspark.llm.text import NOT_SPACE, U64, blocks, mix, row_of, span_hashes, table, word_bounds

STATS = (
    "words", "word_length", "symbols", "dup_lines", "repeated", "capitals", "digits", "points", "bars", "stops",
    "marks", "lines", "line_words", "short_words", "long_words", "distinct", "beyond_ascii", "upper_words", "ended_lines",
)
#: Labelled rows of each label that the rules are learnt from, at most.
TRAIN_ROWS = 2500
TREES, DEPTH, BINS, SEED = 40, 3, 32, 11
PENALTY = 0.002
#: A document is predicted good from this score on.
GOOD_FROM = 0.7

_UPPER, _DIGIT = table(range(0x41, 0x5B)), table(range(0x30, 0x3A))
_LETTER = table([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_POINT, _BAR, _STOP, _MARK = table(b".,;:!?"), table(b"|"), table(b"!?"), table(b"#*$%&<>=@~^_{}[]\\/")
_WIDE, _BREAK = table(range(0xC0, 0x100)), table([0x0A])


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATS per text. Ratios of nothing are 0."""
    (n_words, chars, symbols, dups, repeats), _ = scan(raw, offsets, None)
    starts, ends, first = word_bounds(raw, offsets, NOT_SPACE)
    size = ends - starts
    letters = per_row(_LETTER[raw], offsets)
    lines = per_row(_BREAK[raw], offsets) + (np.diff(offsets) > 0)
    is_break = np.flatnonzero(_BREAK[raw])
    is_break = is_break[~np.isin(is_break, offsets[:-1])]  # before a text's first character stands nothing of its own
    ended = np.zeros(len(raw), bool)
    ended[is_break] = _POINT[raw[is_break - 1]]
    upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
    lettered = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    loud = (lettered[ends] - lettered[starts] > 1) & (upper[ends] - upper[starts] == lettered[ends] - lettered[starts])
    row = row_of(first)
    _, one = np.unique(mix(span_hashes(raw, starts, ends) + mix(row.astype(U64))), return_index=True)
    distinct = np.bincount(row[one], minlength=len(offsets) - 1)
    words, least = n_words.astype(np.float64), np.maximum(n_words, 1)
    chars1, lines1, letters1 = np.maximum(chars, 1), np.maximum(lines, 1), np.maximum(letters, 1)
    return np.stack([
        np.log1p(words), chars / least, symbols / least, dups / lines1, repeats / least, per_row(_UPPER[raw], offsets) / letters1,
        per_row(_DIGIT[raw], offsets) / chars1, per_row(_POINT[raw], offsets) / least, per_row(_BAR[raw], offsets) / least, per_row(_STOP[raw], offsets) / least,
        per_row(_MARK[raw], offsets) / least, np.log1p(lines), words / lines1, per_row(size <= 3, first) / least, per_row(size >= 12, first) / least,
        distinct / least, per_row(_WIDE[raw], offsets) / chars1, per_row(loud, first) / least, per_row(ended, offsets) / lines1,
    ], axis=1)


@dataclass(frozen=True)
class Split:
    stat: int
    above: bool
    value: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.stat] > self.value if self.above else x[:, self.stat] <= self.value

    def column(self, names) -> Column:
        c = F.col(names[self.stat])
        return c > self.value if self.above else c <= self.value


@dataclass
class RuleEnsemble:
    rules: list[tuple[Split, ...]]
    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for rule, w in zip(self.rules, self.weights, strict=True):
            out += w * np.logical_and.reduce([s.holds(x) for s in rule])
        return out

    def score(self, names=STATS) -> Column:
        """The score from 0 to 1 as an expression over the columns of statistics."""
        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(reduce(lambda a, b: a & b, (s.column(names) for s in rule)), float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[tuple[Split, ...]]:
    """Rules from the paths of boosted regression trees; each tree sees half of the rows and statistics."""
    draw = np.random.default_rng(SEED)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    f = np.full(len(y), np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    rules: dict[tuple[Split, ...], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = weight * (y - p), weight * p * (1 - p) + 1e-9
        rows = np.flatnonzero(draw.random(len(y)) < 0.5)
        stats = draw.permutation(x.shape[1])[: max(3, x.shape[1] // 2)]
        todo: list[tuple[np.ndarray, tuple[Split, ...]]] = [(rows, ())]
        while todo:
            own, path = todo.pop()
            best = (1e-3, None, 0)
            G, H = g[own].sum(), h[own].sum()
            if len(path) < depth and len(own) >= 20:
                for j in stats:
                    if not len(cuts[j]):
                        continue
                    gl = np.cumsum(np.bincount(bins[own, j], g[own], len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(bins[own, j], h[own], len(cuts[j]) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], int(j), k)
            if path:
                rules[tuple(sorted(path, key=lambda s: (s.stat, s.above, s.value)))] = None
            if best[1] is None:
                hold = np.logical_and.reduce([s.holds(x) for s in path]) if path else np.ones(len(y), bool)
                f = f + 0.2 * hold * G / (H + 1)
                continue
            j, value = best[1], float(cuts[best[1]][best[2]])
            left = x[own, j] <= value
            todo += [(own[left], (*path, Split(j, False, value))), (own[~left], (*path, Split(j, True, value)))]
    return list(rules)


def fit_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> RuleEnsemble:
    """Lasso logistic weights of grown rules, by accelerated proximal gradient steps."""
    weight = weight / weight.sum()
    rules = grow(x, y, weight * len(y))
    a = np.stack([np.logical_and.reduce([s.holds(x) for s in r]) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(y), 0))
    spread = np.sqrt(np.maximum(a.mean(0) * (1 - a.mean(0)), 1e-4))
    mean = weight @ a
    a = (a - mean) / spread
    v = np.ones(a.shape[1]) if a.shape[1] else np.zeros(0)
    for _ in range(20):  # largest eigenvalue of the weighted Gram matrix
        v = a.T @ (weight * (a @ v))
        v /= np.linalg.norm(v) + 1e-12
    step = 1 / (0.25 * (np.linalg.norm(a.T @ (weight * (a @ v))) + 1) + 1e-9)
    w, b = np.zeros(a.shape[1]), float(np.log((weight @ y + 1e-3) / (weight @ (1 - y) + 1e-3)))
    w_near, b_near, t = w, b, 1.0
    for _ in range(steps):
        err = weight * (1 / (1 + np.exp(-(a @ w_near + b_near))) - y)
        w_new = w_near - step * (a.T @ err)
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * penalty, 0)
        b_new = b_near - step * err.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_near, b_near = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    w = w / spread
    kept = np.flatnonzero(w)
    return RuleEnsemble([rules[i] for i in kept], w[kept], float(b - w @ mean))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: CRC-32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(df: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str) -> RuleEnsemble:
    """Rules from a bounded sample of labelled rows that aren't held out. The driver sees the sample's statistics only."""
    sample = labelled_sample(df, labels, text, doc_id, label, TRAIN_ROWS, lambda c: ~held_out(c)).select("_id", F.col("_label").cast("int"), "_text")
    sample = sample.select(F.xxhash64("_id").alias("_hash"), "_id", "_label", "_text")
    schema = T.StructType([*sample.schema.fields[:3], *(T.StructField(s, T.DoubleType()) for s in STATS)])
    rows = sorted(sample.mapInArrow(_statistics(3, list(STATS)), schema).collect(), key=lambda r: (r["_hash"], r["_id"]))
    y = np.array([r["_label"] for r in rows], dtype=np.int64)
    if not 0 < y.sum() < len(y):
        return RuleEnsemble([], np.zeros(0), 0.0)
    x = np.array([r[3:] for r in rows], dtype=np.float64)
    usable = labels.filter(F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    n = dict(usable.filter(F.col(label).isin(0, 1)).groupBy(label).count().collect())  # two rows
    weight = np.where(y == 1, n.get(1, 1) / max(y.sum(), 1), n.get(0, 1) / max((1 - y).sum(), 1)).astype(np.float64)
    return fit_rules(x, y.astype(np.float64), weight)


def _statistics(at: int, names: list[str]):
    def run(batches):
        for batch in batches:
            for a, b, raw, offsets in blocks(batch.column(at)):
                x = statistics(raw, offsets)
                kept = [c.slice(a, b - a) for c in batch.columns[:at]]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(x.shape[1]))], names=[*batch.schema.names[:at], *names])

    return run


def classify(df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row per row of `df`: doc_id, held_out, score, predicted, and the statistics.

    Scores depend on the text alone. Null texts count as empty and are scored too. Without labels
    of both kinds every score is 0.5. Rows without an id are not held out, and are not learnt from
    either. Repeated rows are scored each for itself; an empty table gives no rows.
    """
    rules = learn(df, labels, text, doc_id, label)
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(fresh(df, "quality_text")))
    schema = T.StructType([slim.schema.fields[0], *(T.StructField(s, T.DoubleType()) for s in STATS)])
    stats = slim.mapInArrow(_statistics(1, list(STATS)), schema)
    scored = stats.withColumn("score", rules.score())
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0).alias("predicted"), *STATS)
