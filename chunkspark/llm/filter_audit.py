"""What filters of a corpus do to each other: survivors in every order and Shapley values.

A document is a mask of the filters that it fails, and a part (a source) of the corpus its counts
by mask, 2 ** filters at most. The number of documents that a set of filters removes extends to a
polynomial, linear in each filter's variable:

    f(x) = sum over masks m of n[m] * (1 - product over i in m of (1 - x[i]))

Its values at the corners of the unit cube are the removals of sets, so they give survivors in
any order. A filter's Shapley value is the integral of its partial derivative along the diagonal;
times the number of orders it is a whole number.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkspark.llm.mixing import word_count
from chunkspark.llm.shared import lookup_join, materialise

NAMES = "ABCDE"
SPACES, CAPITALS = "\t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
#: Columns counted by mask: documents, and those whose loss is told apart.
COUNTS = ("n", "good", "toxic")


def text_fails(text: Column) -> list[Column]:
    """Filters A to D: few words, few distinct words, many capitals, odd signs. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = word_count(text)
    pieces = F.array_distinct(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "))
    distinct = F.size(F.array_remove(pieces, ""))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [words < MIN_WORDS, 100 * distinct < MIN_DISTINCT * words, 100 * capitals > MAX_CAPITALS * F.length(text), text.rlike("[#$%&*|]")]


def mask_of(fails: Sequence[Column]) -> Column:
    """Bit i is set where filter i fails; nulls count as false."""
    mask = F.lit(0)
    for i, f in enumerate(fails):
        mask = mask + F.when(f, 1 << i).otherwise(0)
    return mask


def document_masks(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, part, mask of the five filters, good, toxic (0 or 1).

    The fifth filter fails where a smaller id has the same text. A null id is neither smaller nor
    larger than any. A null source is the part ''. Of an id's labels any good or toxic one counts;
    ids without labels are neither. Repeated rows count each for itself.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    columns = [F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), F.sha2(whole, 256).alias("digest"), F.length(whole).alias("size"), mask_of(text_fails(F.col(text))).alias("own")]
    rows = materialise(docs.select(*columns).withColumn("digest", F.unhex("digest")), "masks")
    shared = rows.groupBy("digest", "size").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("copies")).filter("copies > 1")
    # rows without an id stay out of the joins, whose key they all would share; none is smaller or larger than another
    named = rows.filter("doc_id is not null")
    named = lookup_join(named, materialise(shared, "copies"), ["digest", "size"], "copies", rows.count(), F.struct("doc_id", "part"))
    repeats = F.when(F.col("doc_id") > F.col("smallest"), 1 << 4).otherwise(0)
    known = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id"))
    known = known.agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    named = named.select("doc_id", "part", (F.col("own") + repeats).alias("mask")).join(known, "doc_id", "left")
    named = named.select("doc_id", "part", "mask", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS[1:]))
    return named.unionByName(rows.filter("doc_id is null").select("doc_id", "part", F.col("own").alias("mask"), *(F.lit(0).alias(c) for c in COUNTS[1:])))


@lru_cache
def _polynomial(k: int) -> np.ndarray:
    """(set, mask): how often a document of this mask counts in the coefficient of this set's monomial."""
    sets = np.arange(1 << k)
    size = np.array([bin(s).count("1") for s in sets])
    inside = (sets[:, None] & sets[None, :]) == sets[:, None]
    return np.where(inside & (sets[:, None] > 0), np.where(size % 2 == 1, 1, -1)[:, None], 0)


@lru_cache
def _corners(k: int) -> np.ndarray:
    """(corner, set): whether the set's monomial is 1 at the corner."""
    sets = np.arange(1 << k)
    return ((sets[:, None] & sets[None, :]) == sets[None, :]).astype(np.int64)


@lru_cache
def _integrals(k: int) -> np.ndarray:
    """(filter, set): orders times the integral of the monomial's partial derivative along the diagonal, in whole numbers.

    The derivative of a set's monomial by a filter in it is t ** (size - 1) on the diagonal, whose
    integral from 0 to 1 is 1 / size.
    """
    out = np.zeros((k, 1 << k), np.int64)
    for s in range(1, 1 << k):
        whole = factorial(k) * Fraction(1, bin(s).count("1"))
        if whole.denominator != 1:
            raise ArithmeticError(f"{k} filters' orders don't clear the fractions")
        for i in range(k):
            out[i, s] = whole.numerator * (s >> i & 1)
    return out


def interactions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(removed, shapley) of rows of counts by mask: removed[row, set] documents, and shapley[row, filter] times all orders."""
    k = int(counts.shape[1]).bit_length() - 1
    coefficients = counts @ _polynomial(k).T
    return coefficients @ _corners(k).T, coefficients @ _integrals(k).T


def _orders(names: str):
    """(orders as text, their filters by step, sets of the filters up to and with each step)."""
    k = len(names)
    orders = np.array(list(permutations(range(k))))
    upto = np.cumsum(1 << orders, axis=1)
    return ["".join(names[i] for i in o) for o in orders], orders, upto


def _audited(names: str):
    texts, orders, upto = _orders(names)
    k = len(names)
    text = pa.array(np.repeat(np.array(texts, object), k), pa.string())
    step = np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))
    own, after = orders.reshape(-1), upto.reshape(-1)
    before = after - (1 << own)

    def run(batches):
        for batch in batches:
            parts, cells = batch.column("part"), batch.column("counts")
            row, flat = cells.value_parent_indices().to_numpy(), cells.flatten()
            counts = [np.zeros((batch.num_rows, 1 << k), np.int64) for _ in COUNTS]
            for c, name in zip(counts, COUNTS, strict=True):
                c[row, flat.field("mask").to_numpy()] = flat.field(name).to_numpy()
            (removed, shapley), *lost = (interactions(c) for c in counts)
            for r in range(batch.num_rows):
                here = removed[r, after] - removed[r, before]
                fails = removed[r, 1 << own]
                columns = [counts[0][r].sum() - removed[r, after], here, fails - here, counts[0][r][1 << own], *(x[r, after] - x[r, before] for x, _ in lost), shapley[r, own]]
                whole = [pa.array([parts[r].as_py()] * len(step), pa.string()), text, pa.array(step), *map(pa.array, columns)]
                yield pa.RecordBatch.from_arrays(whole, names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    return run


def audit(masks: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of all filters, and step, from rows of part, mask, good and toxic (see `document_masks`).

    kept and removed are documents after and by this step, redundant those that fail its filter but
    went before, unique_fails those that fail it alone; good_lost and toxic_lost are labelled ones
    among the removed, and shapley its filter's removals summed over all orders. `names` has a
    letter for each bit of the mask, at most 7. No rows give no parts.
    """
    if not 0 < len(names) <= 7:
        raise ValueError("1 to 7 filters can be audited")
    by_mask = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), *(F.sum(c).cast("long").alias(c) for c in COUNTS[1:]))
    rows = by_mask.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("counts"))  # a row for each mask
    return rows.mapInArrow(_audited(names), "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
