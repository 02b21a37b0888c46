"""Vectorised scans of UTF-8 text in Arrow batches.

A block is a run of rows whose texts lie in one byte buffer: `(bytes, offsets)` with offsets of
one entry more than rows. Blocks hold about BLOCK bytes, or one text if it is longer, so the
memory of a task follows the block and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 20
U64 = np.uint64


def blocks(text: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each block; nulls count as empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    text = pc.fill_null(text, "")
    n = len(text)
    if n == 0:
        return
    _, where, data = text.buffers()
    offsets = np.frombuffer(where, dtype=np.int64, count=n + 1 + text.offset)[text.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def table(allowed) -> np.ndarray:
    """Boolean lookup over byte values."""
    out = np.zeros(256, bool)
    out[list(allowed)] = True
    return out


#: Bytes of words that ASCII white space bounds, and of words of digits, a-z and all beyond ASCII.
NOT_SPACE = ~table([0x20, *range(0x09, 0x0E)])
LETTERS = table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def word_bounds(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the maximal runs of `inside` bytes; first[i] is the first word of row i."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    m = inside[raw]
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    before[edges] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Spans of more bytes are hashed and compared one by one.
LONG = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)
_SEED = U64(0x9E3779B97F4A7C15)


def _eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, with zeros after the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand.

    Each 8 bytes go through a nonlinear bijection with the hash of those before, so no family of
    texts collides by construction.
    """
    lengths = ends - starts
    out = mix(lengths.astype(U64) + _SEED)
    eights = _eights(raw)
    todo, at = np.flatnonzero((lengths > 0) & (lengths <= LONG)), 0
    while len(todo):
        left = lengths[todo] - at
        out[todo] = mix((out[todo] ^ (eights[starts[todo] + at] & _MASK[np.minimum(left, 8)])) + _SEED)
        todo, at = todo[left > 8], at + 8
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), 7)
    return out


def equal_spans(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, other: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether the `lengths` bytes of `raw` at each of `starts` are those of `other` at `others`."""
    x, y = _eights(raw), _eights(other)
    same = np.ones(len(starts), bool)
    todo, at = np.flatnonzero((lengths > 0) & (lengths <= LONG)), 0
    while len(todo):
        left = lengths[todo] - at
        same[todo] &= ((x[starts[todo] + at] ^ y[others[todo] + at]) & _MASK[np.minimum(left, 8)]) == 0
        todo, at = todo[left > 8], at + 8
    for i in np.flatnonzero(lengths > LONG).tolist():
        a, b, n = int(starts[i]), int(others[i]), int(lengths[i])
        same[i] = raw[a : a + n].tobytes() == other[b : b + n].tobytes()
    return same


def row_of(first: np.ndarray) -> np.ndarray:
    """Row of each word, given the first word of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def hash_text(words: list[bytes]) -> np.ndarray:
    """span_hashes of whole words."""
    raw = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return span_hashes(raw, np.concatenate([[0], ends[:-1]]), ends)
