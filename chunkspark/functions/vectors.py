"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l1", "l2", "max_inner_product")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), term), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null where a vector has no length."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def metric_of(name: str) -> str:
    """The metric that `name` contains, looked for in the order of METRICS."""
    for metric in METRICS:
        if metric in name:
            return metric
    raise ValueError(f"no such similarity metric: {name}")


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Distance by metric; inner products are negated so that less is nearer."""
    kind = metric_of(metric)
    if kind == "cosine":
        return cosine_distance(a, b)
    if kind == "l1":
        return l1(a, b)
    if kind == "l2":
        return l2(a, b)
    return -dot(a, b)


def score(dist: Column) -> Column:
    """Similarity of a distance: 1 - distance."""
    return F.lit(1.0) - dist


def normalize(v: Column) -> Column:
    """Unit vector; a vector without length stays as it is."""
    length = norm(v)
    return F.when(length > 0, F.transform(doubles(v), lambda x: x / length)).otherwise(doubles(v))


def settled(x: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, digits) + 0.0
