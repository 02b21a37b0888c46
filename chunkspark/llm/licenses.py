"""Licence notices in texts, by a generalised suffix automaton of template words.

Texts stream through the automaton of all templates and phrases, a word at a time, which gives
for each word the longest run of words ending there that stands in some template (matching
statistics). Places of a phrase are read off the states that end with it. Long matches are
chained along a template into spans, and a template that a chain covers well gives its label.
Only stretches of words that occur in templates reach the automaton: any other word resets it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkspark.llm.license_text import PHRASES, TEMPLATES
from chunkspark.llm.text import LETTERS, LOWER, blocks, equal_spans, hash_text, span_hashes, word_bounds

#: Words of a match that may take part in a chain, and words that a chain may skip.
MIN_MATCH = 4
MAX_GAP = 8
#: Share of a template's words that a chain must cover for its label.
MIN_COVER = 0.7


def words_of(text: str) -> list[bytes]:
    raw = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    starts, ends, _ = word_bounds(raw, np.array([0, len(raw)]), LETTERS)
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(starts, ends, strict=True)]


@dataclass
class State:
    length: int
    link: int = -1
    next: dict[int, int] = field(default_factory=dict)
    #: (template, index of the last word) of one or more places that end here.
    ends: set[tuple[int, int]] = field(default_factory=set)
    #: (words, phrase) of the phrases that end here.
    phrases: list[tuple[int, int]] = field(default_factory=list)


class SuffixAutomaton:
    """Generalised suffix automaton of several sequences of word numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.states = [State(0)]
        for t, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word)
                self.states[last].ends.add((t, i))
        for s in sorted(range(1, len(self.states)), key=lambda s: -self.states[s].length):
            self.states[self.states[s].link].ends |= self.states[s].ends
        self.states[0].ends = set()

    def _extend(self, last: int, word: int) -> int:
        states = self.states
        if word in states[last].next:  # another sequence has been here
            to = states[last].next[word]
            return to if states[to].length == states[last].length + 1 else self._split(last, word, to)
        new = len(states)
        states.append(State(states[last].length + 1))
        at = last
        while at >= 0 and word not in states[at].next:
            states[at].next[word] = new
            at = states[at].link
        if at < 0:
            states[new].link = 0
        else:
            to = states[at].next[word]
            states[new].link = to if states[to].length == states[at].length + 1 else self._split(at, word, to)
        return new

    def _split(self, at: int, word: int, to: int) -> int:
        states = self.states
        copy = len(states)
        states.append(State(states[at].length + 1, states[to].link, dict(states[to].next), set()))
        states[to].link = copy
        while at >= 0 and states[at].next.get(word) == to:
            states[at].next[word] = copy
            at = states[at].link
        return copy

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        states = self.states
        while state and word not in states[state].next:
            state = states[state].link
            length = states[state].length
        to = states[state].next.get(word)
        return (0, 0) if to is None else (to, length + 1)

    def mark(self, phrase: int, sequence: list[int]) -> None:
        """Note at every state whose matches may end with the phrase that they do."""
        state = length = 0
        for word in sequence:
            state, length = self.step(state, length, word)
        assert length == len(sequence), "phrases are among the sequences"
        below: dict[int, list[int]] = {}
        for s, x in enumerate(self.states):
            below.setdefault(x.link, []).append(s)
        todo = [state]
        while todo:
            s = todo.pop()
            self.states[s].phrases.append((length, phrase))
            todo += below.get(s, [])


class LicenseScanner:
    """Scans blocks of text for the given templates and phrases."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.templates = [(label, words_of(text)) for label, text in templates]
        self.phrases = [(label, words_of(text)) for label, text in phrases]
        vocabulary = sorted({w for _, ws in (*self.templates, *self.phrases) for w in ws})
        number = {w: i for i, w in enumerate(vocabulary)}
        hashes = hash_text(vocabulary)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype(np.int32)
        self.spelling = np.frombuffer(b"".join(vocabulary), np.uint8)
        self.length = np.array([len(w) for w in vocabulary])
        self.start = np.cumsum(self.length) - self.length
        # a sieve on low bits lets most words pass without a search
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.sizes = [len(ws) for _, ws in self.templates]
        sequences = [[number[w] for w in ws] for _, ws in (*self.templates, *self.phrases)]
        self.automaton = SuffixAutomaton(sequences)
        for p, (_, ws) in enumerate(self.phrases):
            self.automaton.mark(p, [number[w] for w in ws])
        self.shortest = min(len(ws) for _, ws in self.phrases)

    def numbered(self, raw, starts, ends) -> np.ndarray:
        """Number of each word, -1 where no template has it."""
        hashes = span_hashes(raw, starts, ends)
        out = np.full(len(hashes), -1, np.int32)
        maybe = np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[maybe]
        found, name = maybe[hit], self.numbers[at[hit]]
        alike = self.length[name] == (ends - starts)[found]
        found, name = found[alike], name[alike]
        same = equal_spans(raw, starts[found], self.length[name], self.spelling, self.start[name])
        out[found[same]] = name[same]
        return out

    def scan(self, raw: np.ndarray, offsets: np.ndarray):
        """(words of each row, {row: (places, spans)}) of the rows in which something was found.

        Places are (first word, phrase); spans are (first word, last word, template, cover).
        """
        raw = LOWER[raw]
        starts, ends, first = word_bounds(raw, offsets, LETTERS)
        numbers = self.numbered(raw, starts, ends)
        known = np.concatenate([[False], numbers >= 0, [False]])
        row_edge = np.zeros(len(known) + 1, bool)
        row_edge[first + 1] = True
        begins = np.flatnonzero(known[1:-1] & (~known[:-2] | row_edge[1 : len(numbers) + 1]))
        stops = np.flatnonzero(known[1:-1] & (~known[2:] | row_edge[2 : len(numbers) + 2])) + 1
        long = stops - begins >= self.shortest
        found: dict[int, tuple[list, list]] = {}
        matches: dict[int, list] = {}
        states, step = self.automaton.states, self.automaton.step
        begins, stops = begins[long], stops[long]
        rows = np.searchsorted(first, begins, "right") - 1
        for row, a, b in zip(rows.tolist(), begins.tolist(), stops.tolist(), strict=True):
            state = length = 0
            base = int(first[row])
            stretch = numbers[a:b].tolist()
            for i, word in enumerate(stretch):
                state, after = step(state, length, word)
                if after <= length and length >= MIN_MATCH:
                    matches.setdefault(row, []).append((a - base + i - length, length, old))
                length = after
                old = state
                for words, phrase in states[state].phrases:
                    if words <= length:
                        found.setdefault(row, ([], []))[0].append((a - base + i + 1 - words, phrase))
            if length >= MIN_MATCH:
                matches.setdefault(row, []).append((a - base + len(stretch) - length, length, old))
        for row, own in matches.items():
            if spans := self.chain(own):
                found.setdefault(row, ([], []))[1].extend(spans)
        return np.diff(first), found

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Spans of templates that chains of matches (first word, words, state) cover well."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for at, length, state in matches:
            for template, last in self.automaton.states[state].ends:
                if template < len(self.templates):
                    by.setdefault(template, []).append((at, last - length + 1, length))
        spans = []
        for template, own in by.items():
            size = self.sizes[template]
            open_: list[list[int]] = []  # [first word, end word, template end, words covered], by arrival
            for at, where, length in sorted(own):
                best = None
                for c in open_:
                    ahead, along = at - c[1], where - c[2]
                    if -length < ahead <= MAX_GAP and -length < along <= MAX_GAP and (best is None or c[3] > best[3]):
                        best = c
                if best is None:
                    open_.append([at, at + length, where + length, length])
                else:
                    lost = max(0, best[1] - at, best[2] - where)
                    best[1:] = [at + length, where + length, best[3] + length - lost]
                if len(open_) > 64:  # chains that no later match can continue have been judged
                    spans += self._covered(template, size, [c for c in open_ if at - c[1] > MAX_GAP])
                    open_ = [c for c in open_ if at - c[1] <= MAX_GAP]
            spans += self._covered(template, size, open_)
        return spans

    @staticmethod
    def _covered(template: int, size: int, chains) -> list[tuple[int, int, int, float]]:
        return [(c[0], c[1] - 1, template, min(1.0, c[3] / size)) for c in chains if c[3] >= MIN_COVER * size]


@lru_cache(maxsize=1)
def _scanner() -> LicenseScanner:
    return LicenseScanner()


REPORT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word:long,last_word:long,label:string,cover:double>>"


def _report(batches):
    scanner = _scanner()
    names = [x.split()[0] for x in REPORT[: REPORT.index(", spans")].split(", ")] + ["spans"]
    span_type = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("cover", pa.float64())]))
    for batch in batches:
        keys = batch.column(0)
        for a, b, raw, offsets in blocks(batch.column(1)):
            n_words, found = scanner.scan(raw, offsets)
            n = b - a
            n_base, score = np.zeros(n, np.int64), np.zeros(n)
            first, last = [None] * n, [None] * n
            base, labels, spans = [""] * n, [""] * n, [[] for _ in range(n)]
            for row, (places, own) in found.items():
                n_base[row] = len(places)
                mine = {scanner.phrases[p][0] for _, p in places}
                if places:
                    first[row], last[row] = min(x for x, _ in places), max(x for x, _ in places)
                    score[row] = 1.0
                spans[row] = [{"first_word": x, "last_word": y, "label": scanner.templates[t][0], "cover": c} for x, y, t, c in sorted(own)]
                score[row] = max([score[row], *(c for *_, c in own)])
                base[row] = ",".join(sorted(mine))
                labels[row] = ",".join(sorted(mine | {scanner.templates[t][0] for _, _, t, _ in own}))
            columns = [keys.slice(a, n), pa.array(n_words.astype(np.int64)), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score), pa.array(spans, span_type)]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def scan_licenses(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of `df`: see REPORT. Word places count from 0.

    Null and empty texts have no words, no labels ('') and score 0. The score is the best cover of
    a template, 1 if a phrase stands in the text. Repeated rows and rows with null ids are
    scanned each for itself; an empty table gives no rows.
    """
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(_report, REPORT)
