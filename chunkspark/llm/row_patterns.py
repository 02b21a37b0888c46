"""Matches of a regular expression over consecutive rows, without backtracking and without a task per key.

Rows are dealt by range over (key, order), so a key with many rows lies in many blocks. In a block
rows fall into chains: a chain ends before a row that no letter but a first one fits. Over each
chain a dynamic programme runs from right to left. For every automaton state (a letter's place in
the expression) and row it stores the largest measure of the first row with which a match can
still succeed. A walk from each first row then takes the most preferred letter that can, so it
never goes back, and it takes what a backtracking matcher would take.

Chains that touch a block's edge are few rows of it, as a rule. They go on by a carry: for each
of those pieces a (max, min) matrix says how its right edge's values become those of its left
edge. A fold over pieces, of which a block has two at most, so that they grow with the partitions
and not with the rows, gives every piece the values of its right neighbour. Walks that leave a
piece continue in the next one, a round later.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkspark.llm.shared import fresh, materialise, scratch

LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
ACCEPT = -1
#: Rows of a block that are looked at together, and first rows whose walks are kept together.
ROWS, STARTS = 1 << 16, 1 << 13


@dataclass(frozen=True)
class Letter:
    """`fits(now, before)` gets columns of rows and of the rows before them as arrays and gives a boolean array.

    Rows with a null measure fit no letter; a null flag counts as false. A letter that isn't first
    only meets rows whose row before is of the same key and has a measure. With `above_first`
    it also needs a measure of at least the first row's.
    """

    fits: Callable[[dict, dict], np.ndarray]
    above_first: bool = False


class Pattern:
    """Letters put together by `seq`, `plus`, `optional` and `either`; greedy, the first alternative preferred."""

    def __init__(self, node):
        self.letters: list[str] = []
        self.follow: list[list[int]] = []
        self.first = self._first(tree := self._number(node), [ACCEPT])
        if ACCEPT in self.first:
            raise ValueError("the pattern matches no rows at all")
        self._link(tree, [ACCEPT])
        later = {p for own in self.follow for p in own}
        if later & set(self.first):
            raise ValueError("a first letter's place can't come again")
        self.later = sorted(later - {ACCEPT})

    def _number(self, node):
        if isinstance(node, str):
            self.letters.append(node)
            self.follow.append([])
            return len(self.letters) - 1
        return (node[0], *map(self._number, node[1:]))

    def _first(self, node, then: list[int]) -> list[int]:
        """Places that can come first in `node` and what follows it, most preferred first."""
        if isinstance(node, int):
            return [node]
        kind, *parts = node
        if kind == "seq":
            for part in reversed(parts):
                then = self._first(part, then)
            return then
        if kind == "either":
            return list(dict.fromkeys(p for part in parts for p in self._first(part, then)))
        if kind == "optional":
            return list(dict.fromkeys([*self._first(parts[0], then), *then]))
        if ACCEPT in self._first(parts[0], [ACCEPT]):
            raise ValueError("what is repeated must not match no rows")
        return self._first(parts[0], then)

    def _link(self, node, then: list[int]) -> None:
        if isinstance(node, int):
            self.follow[node] = then
            return
        kind, *parts = node
        if kind == "seq":
            for part in reversed(parts):
                self._link(part, then)
                then = self._first(part, then)
        elif kind == "plus":
            self._link(parts[0], list(dict.fromkeys([*self._first(parts[0], then), *then])))
        else:
            for part in parts:
                self._link(part, then)


def seq(*parts):
    return ("seq", *parts)


def either(*parts):
    return ("either", *parts)


def plus(part):
    return ("plus", part)


def optional(part):
    return ("optional", part)


class Chains:
    """Consecutive rows of a block, cut into chains, with what fits where and the values of the dynamic programme."""

    def __init__(self, pattern: Pattern, letters: dict[str, Letter], columns: dict[str, np.ndarray], same: np.ndarray, first_fits: np.ndarray | None = None):
        """`same`: whether a row's key is that of the row before; `first_fits`: which places fit the first row, if not only first ones."""
        self.pattern, n = pattern, len(same)
        self.measure, has = columns["measure"], columns["has_measure"]
        self.fits = np.zeros((len(pattern.letters), n), bool)
        before = {k: np.concatenate([v[:1], v[:-1]]) for k, v in columns.items()}
        follows = same & before["has_measure"]
        if n:
            follows[0] = False
        for p, name in enumerate(pattern.letters):
            self.fits[p] = letters[name].fits(columns, before) & has
            if p not in pattern.first:
                self.fits[p] &= follows
        if first_fits is not None and n:
            self.fits[pattern.later, 0] = first_fits[pattern.later]
        self.bound = np.stack([self.measure if letters[name].above_first else np.full(n, HIGH) for name in pattern.letters]) if n else np.zeros((len(pattern.letters), 0), np.int64)
        self.breaks = ~self.fits[pattern.later].any(axis=0)
        self.n = n
        # where a row's successor stands: n for the open right edge, n + 1 for the end of a chain
        self.after = np.arange(1, n + 1)
        if n:
            self.after[:-1][self.breaks[1:]] = n + 1

    def _step(self, rows: np.ndarray, best: np.ndarray) -> None:
        nxt = self.after[rows]
        for p, follow in enumerate(self.pattern.follow):
            top = np.full((len(rows), *best.shape[2:]), LOW)
            for q in follow:
                top = np.maximum(top, HIGH if q == ACCEPT else best[q, nxt])
            bound = self.bound[p, rows]
            top = np.minimum(top, bound.reshape(-1, *[1] * (top.ndim - 1)))
            top[~self.fits[p, rows]] = LOW
            best[p, rows] = top

    def values(self, right: np.ndarray, accept: bool = True) -> np.ndarray:
        """Largest measure of the first row for (place, row), the row being the place's; `right` has those at the right edge.

        `right` may have further axes, for several edges at once.
        """
        n = self.n
        best = np.full((len(self.pattern.letters), n + 2, *right.shape[1:]), LOW)
        best[:, n] = right
        if n:
            starts = np.flatnonzero(self.breaks | (np.arange(n) == 0))
            lengths = np.diff(np.append(starts, n))
            to_end = np.repeat(starts + lengths - 1, lengths) - np.arange(n)
            order = np.argsort(to_end, kind="stable")
            upto = np.cumsum(np.bincount(to_end))
            for a, b in zip(np.concatenate([[0], upto[:-1]]).tolist(), upto.tolist(), strict=True):
                self._step(order[a:b], best)
        return best

    def edge_matrix(self) -> np.ndarray:
        """(max, min) matrix from values at the right edge, and acceptance in the last column, to those of the first row's places, the first row itself left out.

        Row p tells how a walk whose next row is the second can take it as place p; for one row alone it is the identity.
        """
        k = len(self.pattern.letters)
        if self.n == 1:
            out = np.full((k, k + 1), LOW)
            out[np.arange(k), np.arange(k)] = HIGH
            return out
        edges = np.full((k, k + 1), LOW)
        edges[np.arange(k), np.arange(k)] = HIGH
        # a further edge at which nothing goes on leaves what is accepted before it
        return self.values(edges)[:, 1]

    def walk(self, best: np.ndarray, rows: np.ndarray, places: np.ndarray, firsts: np.ndarray):
        """(rows consumed, letters of each walk joined, next place) of walks that are about to take `rows` as `places`.

        The next place is ACCEPT, or that of the row after the right edge. Every walk given can succeed.
        """
        m = len(rows)
        at, place = rows.copy(), places.copy()
        count, out = np.zeros(m, np.int64), np.full(m, ACCEPT)
        live = np.arange(m)
        walks, steps = [], []
        while len(live):
            walks.append(live)
            steps.append(place[live].astype(np.uint8))
            count[live] += 1
            nxt = self.after[at[live]]
            took = np.full(len(live), ACCEPT - 1)
            for p in np.unique(place[live]).tolist():
                own = np.flatnonzero(place[live] == p)
                for q in self.pattern.follow[p]:
                    free = own[took[own] < ACCEPT]
                    can = np.ones(len(free), bool) if q == ACCEPT else best[q, nxt[free]] >= firsts[live[free]]
                    took[free[can]] = q
            place[live] = took
            at[live] = nxt
            gone = (took == ACCEPT) | (nxt == self.n)
            out[live[gone]] = took[gone]
            live = live[~gone]
        names = np.frombuffer("".join(self.pattern.letters).encode(), np.uint8)
        walks, steps = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (walks, steps))
        order = np.argsort(walks, kind="stable")
        return count, names[steps[order].astype(np.int64)].tobytes(), out


def fold_edges(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Values at a piece's second row, given those at its right edge."""
    return np.minimum(matrix, np.append(right, HIGH)).max(axis=1)


def _columns(batch: pa.RecordBatch, flags: list[str]) -> dict[str, np.ndarray]:
    measure = batch.column("measure")
    out = {"measure": pc.fill_null(measure, 0).to_numpy(zero_copy_only=False), "has_measure": pc.is_valid(measure).to_numpy(zero_copy_only=False)}
    out["ts"] = batch.column("ts").cast(pa.int64()).to_numpy(zero_copy_only=False)
    return out | {c: pc.fill_null(batch.column(c), False).to_numpy(zero_copy_only=False) for c in flags}


def _same(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Whether a row equals the one before in all of `names`, nulls being equal."""
    same = np.ones(batch.num_rows, bool)
    same[:1] = False
    for c in names if batch.num_rows > 1 else ():
        a, b = batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)
        equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        same[1:] &= equal.to_numpy(zero_copy_only=False)
    return same


def _one(table: pa.Table | list[pa.RecordBatch]) -> pa.RecordBatch:
    """All rows as one batch."""
    table = pa.Table.from_batches(table) if isinstance(table, list) else table
    found = table.combine_chunks().to_batches()
    return found[0] if found else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], schema=table.schema)


#: A block's pieces: before its first break, between its breaks, from its last break on, and all of it where it has none.
HEAD, MIDDLE, TAIL, BRIDGE = range(4)


@dataclass
class Search:
    """What tasks do with rows that have key, ts, id, measure and flags."""

    pattern: Pattern
    letters: dict[str, Letter]
    flags: list[str]

    def chains(self, rows: pa.RecordBatch, first_fits: np.ndarray | None = None) -> Chains:
        return Chains(self.pattern, self.letters, _columns(rows, self.flags), _same(rows, ["key"]), first_fits)

    def starts(self, chains: Chains, best: np.ndarray, until: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows before `until` that a match can begin with, their places)."""
        place = np.full(until, ACCEPT)
        for p in reversed(self.pattern.first):
            place[chains.fits[p, :until] & (best[p, :until] >= chains.measure[:until])] = p
        rows = np.flatnonzero(place != ACCEPT)
        return rows, place[rows]

    def results(self, rows: pa.RecordBatch, chains: Chains, best: np.ndarray, begin: np.ndarray, places: np.ndarray, firsts: np.ndarray):
        """(walks, last_id, n_rows, sum_measure, labels, next place) of groups of walks."""
        upto = np.concatenate([[0], np.cumsum(chains.measure)])
        for a in range(0, len(begin), STARTS):
            own = slice(a, a + STARTS)
            count, letters, out = chains.walk(best, begin[own], places[own], firsts[own])
            ends = begin[own] + count
            bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
            labels = pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(bounds.tobytes()), pa.py_buffer(letters)).cast(pa.string())
            yield own, rows.column("id").take(pa.array(ends - 1)), count, upto[ends] - upto[begin[own]], labels, out

    def block(self, rest: bool):
        """The pass over sorted blocks: matches of MIDDLE pieces, and the rows of the others."""
        own = ["key", "ts", "id", "measure", *self.flags]
        alike = [*own, "rest"] if rest else own

        def made(rows, piece, at=None, last=None, n_rows=None, rank=None, labels=None):
            n = rows.num_rows
            numbers = [pa.nulls(n, pa.int64()) if x is None else pa.array(np.asarray(x, np.int64)) for x in (at, n_rows, rank)]
            columns = [pa.array(np.full(n, piece)), numbers[0], *(rows.column(c) for c in own), last if last is not None else pa.nulls(n, rows.schema.field("id").type), *numbers[1:], labels if labels is not None else pa.nulls(n, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["piece", "at", *own, "last_id", "n_rows", "rank", "labels"])

        def middle(rows, chains, a, b, block, counted):
            """Matches that begin in rows a to b, where b begins another chain. `counted` has the last key and its matches so far."""
            best = chains.values(np.full(len(self.pattern.letters), LOW))
            begin, places = self.starts(chains, best, b)
            begin, places = begin[begin >= a], places[begin >= a]
            if not len(begin):
                return
            starts = rows.take(pa.array(begin))
            new = ~_same(starts, ["key"])
            at = np.arange(len(begin))
            rank = at - np.maximum.accumulate(np.where(new, at, 0)) + 1
            if starts.column("key")[0].as_py() == counted[0]:
                later = np.flatnonzero(new[1:])
                rank[: later[0] + 1 if len(later) else None] += counted[1]
            counted[:] = starts.column("key")[-1].as_py(), int(rank[-1])
            for part, last, n_rows, total, labels, _ in self.results(rows, chains, best, begin, places, chains.measure[begin]):
                some = starts.slice(part.start, len(n_rows))
                some = some.set_column(some.schema.get_field_index("measure"), "measure", pa.array(total))
                yield made(some, 4 * block + MIDDLE, None, last, n_rows, rank[part], labels)

        def run(batches):
            held: list[pa.RecordBatch] = []
            n, most, block, headless = 0, ROWS, 0, True
            counted = [None, 0]
            for batch in batches:
                if not batch.num_rows:
                    continue
                block = batch.column("block")[0].as_py()
                held.append(batch)
                n += batch.num_rows
                if n < most:
                    continue
                rows = _one(held)
                rows = rows.filter(pa.array(~_same(rows, alike)))
                chains = self.chains(rows)
                cuts = np.flatnonzero(chains.breaks[1:]) + 1
                if not len(cuts):  # a single chain so far
                    held, n, most = [rows], rows.num_rows, max(most, 2 * rows.num_rows)
                    continue
                first, last = int(cuts[0]) if headless else 0, int(cuts[-1])
                if headless:
                    yield made(rows.slice(0, first), 4 * block + HEAD, np.arange(first))
                    headless = False
                yield from middle(rows, chains, first, last, block, counted)
                held, n, most = [rows.slice(last)], rows.num_rows - last, max(ROWS, 2 * (rows.num_rows - last))
            if not held:
                return
            rows = _one(held)
            rows = rows.filter(pa.array(~_same(rows, alike)))
            chains = self.chains(rows)
            cuts = np.flatnonzero(chains.breaks[1:]) + 1
            first, last = 0, 0
            if headless and not len(cuts):
                yield made(rows, 4 * block + BRIDGE, np.arange(rows.num_rows))
                return
            if headless:
                first = int(cuts[0])
                yield made(rows.slice(0, first), 4 * block + HEAD, np.arange(first))
            last = int(cuts[-1]) if len(cuts) else 0
            yield from middle(rows, chains, first, last, block, counted)
            yield made(rows.slice(last), 4 * block + TAIL, np.arange(rows.num_rows - last))

        return run

    def edges(self, table: pa.Table) -> pa.Table:
        """A piece's first and last row, each with its matrix."""
        rows = _one(table.sort_by("at"))
        matrix = self.chains(rows).edge_matrix().tobytes()
        ends = rows.take(pa.array([0, rows.num_rows - 1])).select(["piece", "at", "key", "ts", "id", "measure", *self.flags])
        return pa.table([*ends.columns, pa.array([matrix] * 2, pa.binary()), pa.array([0, 1])], names=[*ends.schema.names, "matrix", "end"])

    def fold(self, batches):
        """From the last piece to the first: the values at each one's right edge, and what fits its first row."""
        k = len(self.pattern.letters)
        closed, none = np.full(k, LOW), np.zeros(k, bool)
        later: tuple | None = None  # the nearest piece to the right that is open on its left: (piece, first row, values at its second row, right edge, next)
        out = []

        def tell(piece, nxt, fits, right):
            out.append((piece, nxt, fits.tobytes(), right.tobytes()))

        rows = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        for i in range(0, rows.num_rows if rows else 0, 2):
            one = _one(rows.slice(i, 2))
            piece, matrix = one.column("piece")[0].as_py(), np.frombuffer(one.column("matrix")[0].as_py(), np.int64).reshape(k, k + 1)
            first, last = one.slice(0, 1), one.slice(1, 1)
            right, nxt, open_left = closed, -1, piece % 4 in (HEAD, BRIDGE)
            if piece % 4 in (TAIL, BRIDGE) and later is not None:
                there, its_first, second, its_right, its_next = later
                pair = self.chains(_one([last, its_first]))
                fits = pair.fits[:, 1].copy()
                fits[self.pattern.first] = False
                right = np.full(k, LOW)
                for p in np.flatnonzero(fits).tolist():
                    right[p] = min(pair.bound[p, 1], max(HIGH if q == ACCEPT else second[q] for q in self.pattern.follow[p]))
                nxt = there
                tell(there, its_next, fits, its_right)
                later = None
            if open_left:
                later = (piece, first, fold_edges(matrix, right), right, nxt)
            else:
                tell(piece, nxt, none, right)
        if later is not None:
            tell(later[0], later[4], none, later[3])
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), *(pa.array([x[j] for x in out], pa.binary()) for j in (2, 3))], names=["piece", "next", "fits", "right"])

    def _piece(self, table: pa.Table):
        rows = _one(table.sort_by("at"))
        fits, right = (rows.column(c)[0].as_py() for c in ("fits", "right"))
        chains = self.chains(rows, np.frombuffer(fits, bool))
        return rows, chains, chains.values(np.frombuffer(right, np.int64)), rows.column("piece")[0].as_py(), rows.column("next")[0].as_py()

    def begin(self, table: pa.Table) -> pa.Table:
        """Walks from the rows of a piece, to their end or the piece's."""
        rows, chains, best, piece, nxt = self._piece(table)
        begin, places = self.starts(chains, best, rows.num_rows)
        firsts, rank = chains.measure[begin], np.arange(1, len(begin) + 1)
        parts = []
        for part, last, n_rows, total, labels, out in self.results(rows, chains, best, begin, places, firsts):
            starts = rows.take(pa.array(begin[part]))
            whole = [np.full(len(n_rows), piece), rank[part], np.full(len(n_rows), nxt), out, firsts[part]]
            parts.append(pa.record_batch([starts.column("key"), starts.column("id"), last, pa.array(n_rows), pa.array(total), labels, *map(pa.array, whole)], names=WALK))
        return pa.Table.from_batches(parts) if parts else self._no_walks(rows)

    def go_on(self, walks: pa.Table, table: pa.Table) -> pa.Table:
        """Walks that enter a piece, to their end or the piece's."""
        rows, chains, best, _, nxt = self._piece(table)
        old = _one(walks.select(WALK))
        places, firsts = old.column("as").to_numpy(), old.column("first").to_numpy()
        parts = []
        for part, last, n_rows, total, labels, out in self.results(rows, chains, best, np.zeros(len(places), np.int64), places, firsts):
            own = old.slice(part.start, len(n_rows))
            sums = [pc.add(own.column("n_rows"), pa.array(n_rows)), pc.add(own.column("measure"), pa.array(total)), pc.binary_join_element_wise(own.column("labels"), labels, "")]
            parts.append(pa.record_batch([own.column("key"), own.column("id"), last, *sums, own.column("piece"), own.column("rank"), pa.array(np.full(len(n_rows), nxt)), pa.array(out), own.column("first")], names=WALK))
        return pa.Table.from_batches(parts) if parts else self._no_walks(rows)

    def _no_walks(self, rows: pa.RecordBatch) -> pa.Table:
        key, ident = (rows.schema.field(c).type for c in ("key", "id"))
        kinds = [key, ident, ident, pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5]
        return pa.table([pa.array([], t) for t in kinds], names=WALK)


#: Columns of walks; `to` is the piece that one goes on in, `as` the place of its next row or ACCEPT, `first` its first row's measure.
WALK = ["key", "id", "last_id", "n_rows", "measure", "labels", "piece", "rank", "to", "as", "first"]


def match_rows(df: DataFrame, pattern: Pattern, letters: dict[str, Letter], key: str, order: tuple[str, str], measure: str, flags: list[str], blocks: int | None = None) -> DataFrame:
    """One row per match: key, match_no, first_id, last_id, n_rows, sum_measure, labels.

    Distinct rows of `df` are ordered within a key by `order`, a timestamp and an id, and then by
    the other columns. Every row is tried as a first row, so matches may overlap; they are numbered
    from 1 by their first rows. `measure` is a whole number, `flags` are boolean columns that letters
    may use besides `measure` and `ts` (microseconds). Rows without a key or a timestamp are left
    out, a null measure fits no letter, a null flag counts as false, null ids come first. Repeated
    rows count once; an empty table gives no rows. `blocks` defaults to the shuffle partitions.
    """
    spark = df.sparkSession
    search = Search(pattern, letters, flags)
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = [F.col(key).alias("key"), F.col(order[0]).alias("ts"), F.col(order[1]).alias("id"), F.col(measure).cast("long").alias("measure"), *(F.col(c).cast("boolean").alias(c) for c in flags)]
    rest = [c for c in df.columns if c not in (key, *order, measure, *flags)]
    digest = [F.unhex(F.md5(F.to_json(F.struct(*map(F.col, rest))))).alias("rest")] if rest else []
    slim = df.filter(F.col(key).isNotNull() & F.col(order[0]).isNotNull()).select(*named, *digest)
    dealt = slim.repartitionByRange(n, *slim.columns).sortWithinPartitions(*slim.columns).withColumn("block", F.spark_partition_id())
    kind = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    row = ", ".join(f"`{c}` {kind[c]}" for c in ("key", "ts", "id", "measure", *flags))
    walk = f"key {kind['key']}, id {kind['id']}, last_id {kind['id']}, n_rows long, measure long, labels string, piece long, rank long, `to` long, `as` long, first long"
    found = ["piece", "rank", "key", "id", "last_id", "n_rows", "measure", "labels"]
    with scratch(spark) as keep:
        passed = materialise(dealt.mapInArrow(search.block(bool(rest)), f"piece long, at long, {row}, last_id {kind['id']}, n_rows long, rank long, labels string"), "row_blocks")
        loose = passed.filter("at is not null").select("piece", "at", "key", "ts", "id", "measure", *flags)
        edges = loose.groupBy("piece").applyInArrow(lambda rows: search.edges(rows), f"piece long, at long, {row}, matrix binary, end long")
        carry = edges.repartition(1).sortWithinPartitions(F.col("piece").desc(), "end").mapInArrow(search.fold, "piece long, next long, fits binary, right binary")
        rows = loose.join(materialise(carry, "row_carry"), "piece")
        done = passed.filter("at is null").select(*found)
        walks = materialise(rows.groupBy("piece").applyInArrow(lambda rows: search.begin(rows), walk), "row_walks")
        while True:  # a round for each further piece that the longest match reaches
            done = done.unionByName(walks.filter("`as` = -1").select(*found))
            onward = walks.filter("`as` <> -1")
            if onward.isEmpty():
                break
            onward = onward.withColumn("there", F.col("to"))
            walks = materialise(onward.groupBy("there").cogroup(rows.groupBy("piece")).applyInArrow(lambda walks, rows: search.go_on(walks, rows), walk), "row_walks")
        done = keep(done, "row_matches")
    # matches of a key in earlier pieces: at most one key of each piece has any, so these rows number four a block at most
    counts = done.groupBy("key", "piece").agg(F.max("rank").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.withColumn("earlier", before).filter("earlier > 0").select("key", "piece", "earlier")
    numbered = done.join(F.broadcast(earlier), ["key", "piece"], "left")
    return numbered.select("key", (F.col("rank") + F.coalesce("earlier", F.lit(0))).alias("match_no"), F.col("id").alias("first_id"), "last_id", "n_rows", F.col("measure").alias("sum_measure"), "labels")


#: Longest time between rows of one match, in microseconds.
GAP = 30 * 60 * 1_000_000


def _near(now, before):
    return now["ts"] - before["ts"] <= GAP


#: Falls and rises of a client's values after a first row, and a click that is worth as much as the first at last.
SWINGS = Pattern(seq("A", plus(seq(plus("D"), plus("U"))), optional("P")))
LETTERS = {
    "A": Letter(lambda now, before: np.ones(len(now["ts"]), bool)),
    "D": Letter(lambda now, before: _near(now, before) & now["calm"] & (now["measure"] < before["measure"])),
    "U": Letter(lambda now, before: _near(now, before) & now["calm"] & (now["measure"] > before["measure"])),
    "P": Letter(lambda now, before: _near(now, before) & now["click"], above_first=True),
}


def cents(value: Column) -> Column:
    """floor(100 * value + 0.5); null for null and NaN."""
    return F.when(~F.isnan(value), F.floor(100 * value + F.lit(0.5))).cast("long")


def value_swings(clicks: DataFrame, blocks: int | None = None) -> DataFrame:
    """Matches of SWINGS in each client's clicks, see `match_rows`; value, kind, ts, click_id and client_id are the columns read.

    A null kind is neither calm nor a click.
    """
    own = [fresh(clicks, c) for c in ("cents", "calm", "click")]
    kind = F.col("kind")
    rows = clicks.withColumns({own[0]: cents(F.col("value")), own[1]: F.coalesce(kind != "error", F.lit(False)), own[2]: F.coalesce(kind == "click", F.lit(False))})
    letters = {k: Letter(lambda now, before, f=x.fits: f(now | {"calm": now[own[1]], "click": now[own[2]]}, before), x.above_first) for k, x in LETTERS.items()}
    return match_rows(rows, SWINGS, letters, "client_id", ("ts", "click_id"), own[0], own[1:], blocks)
