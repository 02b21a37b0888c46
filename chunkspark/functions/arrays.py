"""Blocks of vectors in numpy: the part of a search that one task does."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: So many distances are held at a time, and so many of them taken anew from the vectors themselves.
CELLS, ANEW = 1 << 20, 1 << 16


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of vectors, none of them null, as rows in its own kind of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def few_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows with fewer than k equal ones before them. Others are never among the k nearest, as ties go to earlier rows."""
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, same = np.unique(whole, return_inverse=True)
    order = np.argsort(same, kind="stable")
    same = same[order]
    return np.sort(order[np.arange(len(x)) - np.searchsorted(same, same) < k])


def nearest_rows(x: np.ndarray, q: np.ndarray, k: int, digits: int | None = None, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(questions, rows, distances) of the k nearest rows by L2 to each question; ties go to the earlier row.

    Products of matrices rule rows out, with room for their rounding; what is left is measured by
    its differences. Distances that agree after rounding to `digits` are ties. `within` gives for
    each question a distance that k rows are known to be in (infinite: none).
    """
    keep = few_copies(x, k)
    x, q = x[keep].astype(np.float64), q.astype(np.float64)
    n, xx, qq = len(x), np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
    room = (x.shape[1] + 16) * 4.5e-16 * (np.max(xx[np.isfinite(xx)], initial=0) + qq)
    tie = 0.0 if digits is None else 10.0**-digits
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(q), step := max(1, CELLS // n)):
        d = q[a : a + step] @ x.T
        d *= -2
        d += xx
        d += qq[a : a + step, None]
        if within is not None:
            last = within[a : a + step]
        elif n > k:
            last = np.sqrt(np.maximum(np.partition(d, k - 1, axis=1)[:, k - 1], 0) + room[a : a + step])
        else:
            last = np.full(len(d), np.inf)
        last = np.where(np.isnan(last), np.inf, last)
        r, c = np.nonzero(d <= ((last * (1 + 1e-12) + tie) ** 2 + room[a : a + step])[:, None])
        dist = np.empty(len(r))
        for b in range(0, len(r), ANEW):
            dist[b : b + ANEW] = np.sqrt(np.square(x[c[b : b + ANEW]] - q[a + r[b : b + ANEW]]).sum(axis=1))
        dist = dist if digits is None else np.round(dist, digits) + 0.0
        order = np.lexsort((c, dist, r))
        r, c, dist = r[order], c[order], dist[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((r[best] + a, keep[c[best]], dist[best]))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))
