"""Token ids of whole texts by a public tokenizer, a piece at a time.

The tokenizer lower-cases and never joins characters across white space, around digits or between
ASCII letters and signs, so a text's ids are those of such pieces in order. Each worker keeps the
ids of the pieces it has met and asks the tokenizer for new ones only.
"""

from __future__ import annotations

import os

import numpy as np

from chunkspark.llm.text import LOWER, equal_spans, span_hashes

#: Classes of bytes: white space, letters, apostrophes and all beyond ASCII, digits, the rest.
SPACE, LETTER, STICKY, DIGIT, SIGN = range(5)
KIND = np.full(256, SIGN, np.uint8)
KIND[[0x20, 0x09, 0x0A, 0x0D]] = SPACE
KIND[0x61:0x7B] = KIND[0x41:0x5B] = LETTER
KIND[0x30:0x3A] = DIGIT
KIND[0x80:] = KIND[0x27] = STICKY
#: Whether a piece ends between bytes of two classes. The tokenizer never joins letters to signs
#: or a digit to anything; what apostrophes and other characters join is left to it.
APART = np.zeros((5, 5), bool)
APART[SPACE] = APART[:, SPACE] = APART[DIGIT] = APART[:, DIGIT] = True
APART[LETTER, SIGN] = APART[SIGN, LETTER] = True
#: Blocks with this in them keep their case and are split at white space only: special tokens begin with it.
MARK = b"<|"
#: A character of one id that stands between words sent together.
BETWEEN = "\x01"


def piece_bounds(raw: np.ndarray, offsets: np.ndarray, marked: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of pieces that have the same ids alone as in their text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = KIND[raw]
    if marked:
        kind[kind != SPACE] = STICKY
    cut = np.empty(len(raw) + 1, bool)
    cut[0] = cut[-1] = True
    cut[1:-1] = APART.reshape(-1)[kind[:-1] * np.uint8(5) + kind[1:]]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    full = kind[edges[:-1]] != SPACE
    starts, ends = edges[:-1][full], edges[1:][full]
    return starts, ends, np.searchsorted(starts, offsets)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class HashTable:
    """Numbers of 64-bit keys in order of arrival; looks up whole arrays at once. Doubles before it is half full."""

    def __init__(self, bits: int):
        self._clear(bits)
        self.n = 0

    def _clear(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 if it isn't there."""
        at = (keys & self.mask).astype(np.int64)
        out = self.values[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & int(self.mask)
            out[wrong] = self.values[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number distinct keys that aren't there yet."""
        numbers = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        bits = len(self.keys).bit_length() - 1
        if 2 * self.n > len(self.keys):
            while 2 * self.n > 1 << bits:
                bits += 1
            full = self.values >= 0
            old, olds = self.keys[full], self.values[full]
            self._clear(bits)
            self._put(old, olds)
        self._put(keys, numbers)

    def _put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        at = (keys & self.mask).astype(np.int64)
        while len(keys):
            free = self.values[at] < 0
            self.values[at[free]] = numbers[free]
            self.keys[at[free]] = keys[free]
            stay = self.values[at] != numbers
            keys, numbers, at = keys[stay], numbers[stay], (at[stay] + 1) & int(self.mask)


class WordEncoder:
    """Ids of blocks of text (see `text.blocks`).

    Forgets what it knows before a block when that is over 2 ** bits / 2 pieces or 256 MB of them; a
    block of more pieces than that, which is one very long text, is learnt whole.
    """

    def __init__(self, path: str, special: bool = True, bits: int = 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.bits = bits
        (self.between,) = self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.table = HashTable(self.bits)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 12, np.int32)
        self.count = np.zeros(1 << 12, np.int32)
        self.used = 0
        # the pieces' bytes tell pieces of one hash apart
        self.bytes = np.zeros(1 << 16, np.uint8)
        self.start = np.zeros(1 << 12, np.int32)
        self.size = np.zeros(1 << 12, np.int32)
        self.stored = 0

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. Words are sent some hundred at a time, with a mark between them."""
        out: list[list[int]] = []
        for at in range(0, len(words), 512):
            part = [w.decode("utf-8", "replace") for w in words[at : at + 512]]
            if any(BETWEEN in w for w in part):
                out += [e.ids for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
                continue
            ids = self.tokenizer.encode_batch_fast([f" {BETWEEN} ".join(part)], add_special_tokens=False)[0].ids
            one: list[int] = []
            for i in ids:
                if i == self.between:
                    out.append(one)
                    one = []
                else:
                    one.append(i)
            out.append(one)
        return out

    def _learn(self, words: list[bytes], hashes: np.ndarray | None) -> None:
        """Keep the ids of `words`, found by hash unless there is none."""
        found = self._ids(words)
        counts = np.fromiter(map(len, found), np.int32, len(found))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum()))
        n = self.table.n
        while len(self.begin) < n + len(words):
            self.begin, self.count, self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.count, self.start, self.size))
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.bytes) < self.stored + sizes.sum():
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        new = slice(n, n + len(words))
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[new] = self.used + np.cumsum(counts) - counts
        self.count[new] = counts
        self.bytes[self.stored : self.stored + int(sizes.sum())] = np.frombuffer(b"".join(words), np.uint8)
        self.start[new] = self.stored + np.cumsum(sizes) - sizes
        self.size[new] = sizes
        self.used += len(ids)
        self.stored += int(sizes.sum())
        if hashes is None:
            self.table.n += len(words)
        else:
            self.table.add(hashes)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): row i has ids[bounds[i]:bounds[i + 1]]."""
        marked = MARK in raw.tobytes()
        if not marked:
            raw = LOWER[raw]
        starts, ends, first = piece_bounds(raw, offsets, marked)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        hashes = span_hashes(raw, starts, ends)
        if self.table.n > 1 << (self.bits - 1) or self.stored > 1 << 28:
            self._forget()
        places = self.table.find(hashes)
        new = np.flatnonzero(places < 0)
        if len(new):
            keys, one = np.unique(hashes[new], return_index=True)
            at = new[one]
            data = raw.tobytes()
            self._learn([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], keys)
            places[new] = self.table.find(hashes[new])
        lengths = ends - starts
        wrong = self.size[places] != lengths
        wrong |= ~equal_spans(raw, starts, np.where(wrong, 0, lengths), self.bytes[: self.stored], self.start[places])
        if len(clash := np.flatnonzero(wrong)):
            data, n = raw.tobytes(), self.table.n
            self._learn([data[a:b] for a, b in zip(starts[clash].tolist(), ends[clash].tolist(), strict=True)], None)
            places[clash] = np.arange(n, n + len(clash))
        counts = self.count[places]
        upto = np.zeros(len(counts) + 1, np.int32)
        np.cumsum(counts, out=upto[1:])
        at = np.repeat(self.begin[places] - upto[:-1], counts)
        at += np.arange(upto[-1], dtype=np.int32)
        return self.pool[at], upto[first]


_ENCODERS: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, special: bool = True) -> WordEncoder:
    """The worker's encoder of this tokenizer file. Unless `special`, special tokens' strings are ordinary text."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = WordEncoder(path, special)
    return _ENCODERS[path, special]
