"""N-gram Jaccard join with a token-group matrix, and the components of its links.

A document is the set of its word n-grams (hashed to 64 bits); documents with one set are one
node. Sets link if their Jaccard similarity is at least `similarity`.

1. Grouping. Two linked sets of a and b tokens differ in at most D = (1-s)/(1+s) (a+b) tokens.
   Dealt by hash into parts, at most D parts differ, so a set with more than D filled parts has
   one in common with any set it links to. Each set is filed under the hashes of its filled
   parts, and the rare sets with fewer under one name for all of their size class. A set with F
   filled parts shares F - D of them with any set it links to; sets that share fewer with all
   others together link with none and are left out. Of each file the member with most shared
   parts leads; nodes that share a leader are a group. A node leaves the groups in which it has
   the fewest files, less than half of F - D in all, so linked nodes still share a group.
2. Members linked to their leader are settled by that link, and the links so far make components.
   Only groups with members of several components go on. There the others are queries. The
   token-group matrix holds, for each group and token beyond the leader's, how many members have
   it; with the leader's tokens that is the union of the group. Its blocks are a group's tokens of
   one hash range. A query's overlap with any other member is at most its tokens that the union
   has without it; groups below the needed overlap stay closed to it.
3. In opened groups a member is its difference to the leader, and |x ^ y| of two members is that
   of their differences. Linked members share one of the first tokens of their differences, by
   prefix lengths that hold for settled and unsettled members. Differences are in order of the
   matrix, rarest tokens first, so what only one member has fills most of a prefix and pairs
   nothing. Members that share a prefix token are first compared with one of them alone; then
   pairs that are still of different components are listed and compared.

Nodes that links connect already are never paired, and no group or list of members with one token
is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkspark.llm.shared import fresh, lookup_join, materialise, scratch, slices
from chunkspark.llm.text import LOWER, NOT_SPACE, U64, blocks, mix, span_hashes, word_bounds

_K = U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """n-grams of `words` words link at a similarity of `part` / `whole` or more."""

    words: int = 3
    part: int = 90
    whole: int = 100

    def differ(self, sizes):
        """Tokens in which two linked sets differ at most, from the sum of their sizes."""
        return (self.whole - self.part) * sizes // (self.whole + self.part)

    def largest(self, size):
        """Size of the largest set that can link to one of `size`."""
        return self.whole * size // self.part

    @lru_cache(maxsize=8)  # noqa: B019
    def classes(self) -> list[tuple[int, int, int]]:
        """(first size, D, parts) of the size classes. Steps of `largest` span a class: about 1.4 times its first size."""
        out, first = [], 1
        steps = max(1, round(np.log(1.4) / np.log(self.whole / self.part)))
        while first < 1 << 40:
            last = first
            for _ in range(steps):
                last = max(last, self.largest(last))
            differ = int(self.differ(2 * last))
            parts = differ + 1
            while parts < 8 * first:  # filled parts: mean less five deviations
                empty = parts * np.exp(-first / parts)
                if parts - empty - 5 * np.sqrt(empty) >= differ + 1:
                    break
                parts += 1 + parts // 50
            out.append((first, differ, parts))
            first = last + 1
        return out

    @lru_cache(maxsize=8)  # noqa: B019
    def firsts(self) -> np.ndarray:
        return np.array([c[0] for c in self.classes()], dtype=np.int64)


def columns_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def tokens_of(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of one text; fewer words are one n-gram."""
    n = len(words)
    if n == 0:
        return np.zeros(0, U64)
    if n < width:
        h = np.array([n], U64)
        for w in words:
            h = mix(h * _K + w)
        return h
    h = words[: n - width + 1]
    for k in range(1, width):
        h = mix(h) + words[k : n - width + 1 + k] * U64(2 * k + 1)
    h = np.sort(mix(h))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def node_of(tokens: np.ndarray) -> int:
    """64-bit name of a set. Distinct sets clash with a chance of about n^2 / 2^65 for n sets."""
    with np.errstate(over="ignore"):
        total = np.sum(mix(tokens + _K), dtype=U64) + mix(np.array([len(tokens)], U64))[0]
    return int(mix(np.array([total ^ np.bitwise_xor.reduce(tokens)], U64)).view(np.int64)[0])


#: Bits of a row's mark: salt, parts that a link needs in common, size class.
SALT_BITS, NEED_BITS = 10, 32


def parts_of(tokens: np.ndarray, rule: Rule) -> list[tuple[np.ndarray, int]]:
    """(names of the parts under which a set is filed, mark) for its size class and perhaps the next."""
    n, classes = len(tokens), rule.classes()
    own = int(np.searchsorted(rule.firsts(), n, "right")) - 1
    out = []
    upto = np.concatenate([np.zeros(1, U64), np.cumsum(mix(tokens ^ _K), dtype=U64)])
    for c in (own, own + 1):
        first, differ, k = classes[c]
        if c > own and rule.largest(n) < first:
            break
        if differ == 0:
            continue  # linked sets of this class are equal
        part = ((tokens >> U64(32)) * U64(k)) >> U64(32)
        filled, starts = np.unique(part, return_index=True)
        ends = np.append(starts[1:], n)
        salt = mix((filled + U64(c << 32)) * _K)
        names = mix((upto[ends] - upto[starts]) ^ salt)
        if len(filled) <= differ:
            names = np.append(names, mix(np.array([c], U64) ^ _K))
        out.append((names, (c << (SALT_BITS + NEED_BITS)) + (max(0, len(filled) - differ) << SALT_BITS)))
    return out


#: One in so many (part, node) rows is in the sample that finds hot parts; it only decides where rows go.
SAMPLED = 64
SETS = "doc_id long, row long, n_shingles long, node long, sample array<long>"


def _walk(batch: pa.RecordBatch, at: int, rule: Rule):
    """(rows, token sets) of each block of a batch."""
    for a, b, raw, offsets in blocks(batch.column(at)):
        raw = LOWER[raw]
        starts, ends, first = word_bounds(raw, offsets, NOT_SPACE)
        words = span_hashes(raw, starts, ends)
        yield slice(a, b), [tokens_of(words[first[i] : first[i + 1]], rule.words) for i in range(b - a)]


class _Seen:
    """Whether this task has met a node before; forgets when it has met many."""

    def __init__(self):
        self.nodes: set[int] = set()

    def __call__(self, node: int) -> bool:
        if node in self.nodes:
            return True
        if len(self.nodes) > 500_000:
            self.nodes.clear()
        self.nodes.add(node)
        return False


def listed(parts: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate([np.zeros(0, np.int64), *(p.view(np.int64) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(values))


def _sets(rule: Rule):
    def run(batches):
        seen = _Seen()
        for batch in batches:
            for own, sets in _walk(batch, 2, rule):
                nodes = [node_of(s) if len(s) else 0 for s in sets]
                sample = []
                for s, node in zip(sets, nodes, strict=True):
                    parts = np.concatenate([np.zeros(0, U64), *(p for p, _ in parts_of(s, rule))]) if len(s) and not seen(node) else np.zeros(0, U64)
                    sample.append(parts[mix(parts ^ np.array([node], np.int64).view(U64)) % U64(SAMPLED) == 0])
                n = own.stop - own.start
                columns = [batch.column(0).slice(own.start, n), batch.column(1).slice(own.start, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), listed(sample)]
                yield pa.RecordBatch.from_arrays(columns, names=columns_of(SETS))

    return run


def _filed(rule: Rule, hot: list[int]):
    """part, node and mark of each part of each node, once per task. The marks of hot parts are salted by node."""
    hottest = np.array(sorted(hot), np.int64)

    def run(batches):
        seen = _Seen()
        for batch in batches:
            for _, sets in _walk(batch, 0, rule):
                parts, nodes, marks = [], [], []
                for s in sets:
                    if len(s) and not seen(node := node_of(s)):
                        for p, mark in parts_of(s, rule):
                            parts.append(p.view(np.int64))
                            nodes.append(np.full(len(p), node, np.int64))
                            marks.append(np.full(len(p), mark, np.int64))
                if not parts:
                    continue
                part, node, mark = np.concatenate(parts), np.concatenate(nodes), np.concatenate(marks)
                if len(hottest):
                    is_hot = hottest[np.minimum(np.searchsorted(hottest, part), len(hottest) - 1)] == part
                    mark[is_hot] += 1 + (mix(node[is_hot].view(U64)) % U64(512)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(node), pa.array(mark)], names=["part", "node", "mark"])

    return run


#: Bits of an id filter: so many for each id, and 2 ** MOST_BITS at most.
ID_BITS, MOST_BITS = 16, 27


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each id in a filter of 2 ** bits."""
    x = ids.view(U64)
    return np.concatenate([mix(x + _K), mix(x ^ _K)]) >> U64(64 - bits)


def id_filter(ids: DataFrame) -> np.ndarray:
    """64-bit words of a filter that holds all `ids` (one column, long), and others by chance. Its size is bounded."""
    n = ids.count()
    bits = min(MOST_BITS, max(16, (ID_BITS * n).bit_length()))

    def run(batches):
        for batch in batches:
            at = _places(batch.column(0).drop_null().to_numpy(), bits)
            words, name = np.unique(at >> U64(6), return_inverse=True)
            held = np.zeros(len(words), U64)
            np.bitwise_or.at(held, name, U64(1) << (at & U64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(held.view(np.int64))], names=["word", "held"])

    found = ids.mapInArrow(run, "word long, held long").groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[found.column("word").to_numpy()] = found.column("held").to_numpy().view(U64)
    return out


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _places(ids, len(words).bit_length() + 5)
    held = (words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) == 1
    return held[: len(ids)] & held[len(ids) :]


def _tokens(rule: Rule, wanted):
    """Of doc_id and text: node and tokens, once per task, of rows that the filter lets through or that have no id."""

    def run(batches):
        seen, words = _Seen(), wanted.value
        for batch in batches:
            ids = batch.column(0)
            keep = pa.array(passes(words, ids.fill_null(0).to_numpy())) if len(ids) else pa.array([], pa.bool_())
            batch = batch.filter(pc.or_(keep, ids.is_null()))
            for _, sets in _walk(batch, 1, rule):
                own = [(n, s.tobytes()) for n, s in ((node_of(s), s) for s in sets if len(s)) if not seen(n)]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.int64()), pa.array([s for _, s in own], pa.binary())], names=["node", "tokens"])

    return run


def _shared_parts(batches):
    """Of rows sorted by part and node: those, once each, whose part several nodes have. Hot parts (salted) all have."""
    held = None  # last row: part, node, mark, whether it stays whatever comes next
    names = ["part", "node", "mark"]
    for batch in batches:
        part, node, mark = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if held is not None:
            part, node, mark = np.append(held[0], part), np.append(held[1], node), np.append(held[2], mark)
        if not len(part):
            continue
        near = part[1:] == part[:-1]
        new = np.append(True, ~near | (node[1:] != node[:-1]))
        stays = held is not None and held[3]
        part, node, mark = part[new], node[new], mark[new]
        near = part[1:] == part[:-1]
        keep = np.append(stays, near) | (mark % (1 << SALT_BITS) > 0)
        keep[:-1] |= near
        held = (part[-1], node[-1], mark[-1], bool(keep[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep[:-1]]) for x in (part, node, mark)], names=names)
    if held is not None and held[3]:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held[:3]], names=names)


def _able(shared: DataFrame) -> DataFrame:
    """Rows of the sets that share as many parts of a size class as a link needs; the others link with none."""
    counts = shared.groupBy("node", "size_class").agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need")
    return shared.join(counts.select("node", "size_class"), ["node", "size_class"], "left_semi")


#: A member against its leader: the tokens that it adds, and of those it lacks as many as its prefix may need.
DELTAS = "node long, leader long, n long, linked boolean, size long, short long, prefix long, added array<long>, lacks array<long>"


def _deltas(rule: Rule):
    """Rows of node, leader and their token sets become rows of DELTAS.

    Two queries share a token of the `short` prefixes of their differences, a query and a settled
    member one of the query's whole prefix and of the member's, which is short.
    """
    wide, narrow = rule.whole + rule.part, rule.whole - rule.part

    def run(batches):
        for batch in slices(batches):
            n, linked, size, short, prefix, added, lacks = [], [], [], [], [], [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = y[at] == x
                left = np.ones(len(y), bool)
                left[at[both]] = False
                own, other = x[~both], y[left]
                d, a, b = len(own) + len(other), len(x), len(y)
                is_linked = d <= rule.differ(a + b)
                # against a query the overlap is over half of the difference, but for the sizes; against a settled member it can be less
                half = max(1, -((-(d + 1 + (-narrow * (a - b) // wide))) // 2))
                first = d - half + 1
                n.append(a)
                linked.append(is_linked)
                size.append(d)
                short.append(first)
                if not is_linked:
                    farthest = rule.differ(a + rule.largest(a))
                    first = max(first, d - max(1, d - farthest) + 1)
                prefix.append(first)
                added.append(own)
                lacks.append(other[: max(0, first - len(own))])
            numbers = [pa.array(n, pa.int64()), pa.array(linked, pa.bool_()), *(pa.array(x, pa.int64()) for x in (size, short, prefix))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, listed(added), listed(lacks)], names=columns_of(DELTAS))

    return run


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each value) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), lengths)


def _grouped_lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), pa.array(values))


def _in_group(leader: np.ndarray, token: np.ndarray) -> np.ndarray:
    """One name for a token in a group."""
    return mix(mix(leader.view(U64) + _K) ^ token.view(U64))


BLOCKS = "leader long, way int, row long, tokens array<long>"


def _blocks(heavy: np.ndarray):
    """Of row, leader, ways and added: each row's tokens, but the heavy ones, by the hash ranges (ways) of its group."""

    def run(batches):
        for batch in batches:
            row, leader, ways = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            token, at = _flat(batch.column(3))
            light = ~np.isin(_in_group(leader[at], token), heavy)
            token, at = token[light], at[light]
            if not len(token):
                continue
            way = (((mix(token.view(U64) ^ _K) >> U64(32)) * ways[at].astype(U64)) >> U64(32)).astype(np.int64)
            order = np.lexsort((way, at))
            token, at, way = token[order], at[order], way[order]
            starts = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (way[1:] != way[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(leader[at[starts]]), pa.array(way[starts], pa.int32()), pa.array(row[at[starts]]), _grouped_lists(token, starts)], names=columns_of(BLOCKS))

    return run


UNION = "row long, tokens array<long>, members array<long>"


def _in_union(batches):
    """Of matrix blocks sorted by leader and way: the tokens of each row that several rows have, and how many."""

    def counted(parts):
        table = pa.Table.from_batches(parts)
        leader, way, row = (table.column(i).to_numpy() for i in range(3))
        token, at = _flat(table.column(3))
        block = np.cumsum(np.append(False, (leader[1:] != leader[:-1]) | (way[1:] != way[:-1])))[at]
        order = np.lexsort((token, block))
        starts = np.flatnonzero(np.append(True, (token[order][1:] != token[order][:-1]) | (block[order][1:] != block[order][:-1])))
        members = np.empty(len(token), np.int64)
        members[order] = np.repeat(np.diff(np.append(starts, len(token))), np.diff(np.append(starts, len(token))))
        several = members > 1
        token, at, members = token[several], at[several], members[several]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(row[at[starts]], pa.int64()), _grouped_lists(token, starts), _grouped_lists(members, starts)], names=columns_of(UNION))

    held, last = [], None  # the block that is not known to be complete
    for batch in batches:
        if not batch.num_rows:
            continue
        leader, way = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        new = np.flatnonzero((leader[1:] != leader[:-1]) | (way[1:] != way[:-1])) + 1
        cut = int(new[-1]) if len(new) else 0
        if cut or (leader[0], way[0]) != last:
            if done := held + [batch.slice(0, cut)] * (cut > 0):
                yield counted(done)
            held = []
        held.append(batch.slice(cut))
        last = (leader[-1], way[-1])
    if held:
        yield counted(held)


POSTINGS = "leader long, token long, node long, comp long, n long, size long, place long, query boolean, short long"


def _postings(rule: Rule, heavy: np.ndarray):
    """Of DELTAS rows with comp and what the union has of them: the first tokens of settled members and of queries that the group is open to.

    The order of a difference: added tokens by the number of members, heavy ones after them, then what it lacks; ties by token.
    """

    def run(batches):
        for batch in batches:
            c = {x: batch.column(x).to_numpy(zero_copy_only=False) for x in ("leader", "node", "comp", "n", "linked", "size", "short", "prefix")}
            token, at = _flat(batch.column("tokens"))
            members = _flat(batch.column("members"))[0]
            own, own_at = _flat(batch.column("added"))
            n_added = np.bincount(own_at, minlength=batch.num_rows)
            hot = np.isin(_in_group(c["leader"][own_at], own), heavy)
            lacks, lacks_at = _flat(batch.column("lacks"))
            at = np.concatenate([at, own_at[hot], lacks_at])
            level = np.concatenate([np.zeros(len(token), np.int8), np.ones(hot.sum(), np.int8), np.full(len(lacks), 2, np.int8)])
            members = np.concatenate([members, np.zeros(hot.sum() + len(lacks), np.int64)])
            token = np.concatenate([token, own[hot], lacks])
            in_union = np.bincount(at[level < 2], minlength=batch.num_rows)
            # what no other member has comes first, and is in no posting
            active = c["linked"] | (rule.whole * (c["n"] - n_added + in_union) >= rule.part * c["n"])
            order = np.lexsort((token, members, level, at))
            token, at = token[order], at[order]
            starts = np.searchsorted(at, np.arange(batch.num_rows))
            place = np.arange(len(at)) - starts[at] + (n_added - in_union)[at]
            keep = active[at] & (place < c["prefix"][at])
            token, at, place = token[keep], at[keep], place[keep]
            columns = [c["leader"][at], token, c["node"][at], c["comp"][at], c["n"][at], c["size"][at], place, ~c["linked"][at].astype(bool), c["short"][at]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=columns_of(POSTINGS))

    return run


def may_link(rule: Rule, x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Whether postings of two members with one token may link, by their columns; one of them is a query."""
    smaller, larger = F.least(x("n"), y("n")), F.greatest(x("n"), y("n"))
    both = x("query") & y("query")
    early = (x("place") < x("short")) & (y("place") < y("short"))
    need = x("size") + y("size") - F.floor((rule.whole - rule.part) * (x("n") + y("n")) / (rule.whole + rule.part))
    reach = 2 * F.least(x("size") - x("place"), y("size") - y("place"))
    return (x("comp") != y("comp")) & (x("query") | y("query")) & (rule.whole * smaller >= rule.part * larger) & (~both | early) & (reach >= need)


#: Members with one prefix token are paired in cells of two chunks of about so many.
CHUNK = 1024


def _pairs_of(rule: Rule):
    """Pairs (a, b) of different components from postings sorted by leader, token and cell, with each row's chunk."""
    names = ["a", "b"]

    def pairs(node, comp, n, size, place, query, short, chunk):
        q = np.flatnonzero(query)
        mixed = chunk.min() != chunk.max()
        step = max(1, (1 << 20) // len(node))
        for at in range(0, len(q), step):
            i = q[at : at + step, None]
            ok = (rule.whole * np.minimum(n[i], n) >= rule.part * np.maximum(n[i], n)) & (comp[i] != comp)
            if mixed:
                ok &= chunk[i] != chunk
            early = place < short
            ok &= ~query | (early[i] & early)
            need = size[i] + size - rule.differ(n[i] + n)
            ok &= 2 * np.minimum(size[i] - place[i], size - place) >= need
            x, y = np.nonzero(ok)
            x = q[at : at + step][x]
            yield np.minimum(node[x], node[y]), np.maximum(node[x], node[y])

    def grouped(table):
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in ("leader", "token", "cell"):
            new[1:] |= col[c][1:] != col[c][:-1]
        bounds = np.append(np.flatnonzero(new), table.num_rows).tolist()
        out = []
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - s > 1:
                for p in pairs(*(col[c][s:e] for c in ("node", "comp", "n", "size", "place", "query", "short", "chunk"))):
                    out.append(p)
                    if sum(len(x) for x, _ in out) > 1 << 18:
                        yield joined(out)
                        out = []
        if out:
            yield joined(out)

    def joined(out):
        both = np.unique(np.stack([np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=names)

    def run(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("leader", "token", "cell")]
            new = np.flatnonzero((key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1]) | (key[2][1:] != key[2][:-1])) + 1
            cut = int(new[-1]) if len(new) else 0
            if cut or tuple(k[0] for k in key) != last:
                if done := held + [batch.slice(0, cut)] * (cut > 0):
                    yield from grouped(pa.Table.from_batches(done))
                held = []
            held.append(batch.slice(cut))
            last = tuple(k[-1] for k in key)
        if held:
            yield from grouped(pa.Table.from_batches(held))

    return run


def _verified(rule: Rule):
    def run(batches):
        for batch in slices(batches):
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(rule.whole * both >= rule.part * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every vertex of `edges` (a, b) but the roots; the root is the smallest reachable.

    Large-star and small-star rounds until nothing changes. The smallest neighbour is found with
    partial aggregation, and goes back to the edges of hot vertices by broadcast.
    """
    def star(pairs: DataFrame) -> DataFrame:
        least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "stars")
        return lookup_join(pairs, least, ["u"], "n", pairs.count(), F.col("v"))

    def total(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e = materialise(e, "edges")
    before = total(e)
    while True:
        both = materialise(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = star(both).select(F.col("v").alias("u"), F.least("m", "u").alias("v"), F.col("u").alias("w")).filter("u > w and u != v").select("u", "v").distinct()
        large = materialise(large, "large")
        found = star(large)
        small = found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        e = materialise(small, "small")
        after = total(e)
        if after == before:
            return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = after


def rooted(rows: DataFrame, label: DataFrame, side: str, spread: str) -> DataFrame:
    """`rows` with the root of the node in `side`, however many rows one node has."""
    counts = rows.groupBy(side).agg(F.count("*").alias("_n")).join(label.select(F.col("node").alias(side), "root"), side, "left")
    found = lookup_join(rows, materialise(counts, "roots"), [side], "_n", rows.count(), F.col(spread))
    return found.withColumn(f"{side}_root", F.coalesce("root", side)).drop("root", "_n")


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """`label` (node, root; roots are not in it) after the components that `links` (a, b) connect became one."""
    with scratch(label.sparkSession) as keep:
        links = materialise(links, "links")
        ends = rooted(rooted(links, label, "a", "b"), label, "b", "a").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        now = materialise(components(ends), "now").select(F.col("v").alias("root"), F.col("root").alias("_now"))
        sizes = materialise(label.groupBy("root").agg(F.count("*").alias("_n")).join(now, "root", "left"), "sizes")
        moved = lookup_join(label, sizes, ["root"], "_n", label.count(), F.col("node"))
        moved = moved.select("node", F.coalesce("_now", "root").alias("root"))
        return keep(moved.unionByName(now.select(F.col("root").alias("node"), F.col("_now").alias("root"))), "label")


def salted_tokens(pairs: DataFrame, key: str, spread: str, tokens: DataFrame, name: str) -> DataFrame:
    """`pairs` with the token set of the node in `key`; nodes of many pairs are salted."""
    total = pairs.count()
    bar = max(500, total // 1000)
    counts = materialise(pairs.groupBy(key).agg(F.count("*").alias("_n")), "counts")
    hot = counts.filter(F.col("_n") > bar).select(key, F.ceil(F.col("_n") / bar).cast("int").alias("_ways"))  # under 1000 rows
    left = pairs.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_ways")).cast("int"), F.lit(0))).drop("_ways")
    ways = counts.select(F.col(key), F.explode(F.sequence(F.lit(0), F.when(F.col("_n") > bar, F.ceil(F.col("_n") / bar).cast("int")).otherwise(1) - 1)).alias("_salt"))
    right = tokens.select(F.col("node").alias(key), F.col("tokens").alias(name)).join(ways, key)
    return left.join(right, [key, "_salt"]).drop("_salt")


def linked_components(df: DataFrame, text: str = "text", doc_id: str = "doc_id", rule: Rule = Rule()) -> DataFrame:
    """One row per row of `df`: doc_id, n_shingles, component_id.

    The component is the smallest id reachable by links, the document's own included. Null and
    empty texts have no n-grams and link with nothing. Rows that share an id are one document,
    which links what either does. Rows without an id take part, and a component of such rows
    alone has a null id. An empty table gives no rows.
    """
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), F.col(text).alias("text"))
    return _linked(docs, rule).select("doc_id", "n_shingles", "component_id")


#: Blocks of the matrix hold about one in so many of all its tokens, so no group weighs on one task, and so many at least.
MATRIX_SHARE, BLOCK_TOKENS = 2048, 1000
#: Rows of the sample that have a heavy token, at least.
HEAVY = 20


def _grouped(tagged: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(node, leader) of every group that a node belongs to and does not lead."""
    spark = tagged.sparkSession
    with scratch(spark) as keep:
        sample = materialise(sets.select(F.explode("sample").alias("part")).groupBy("part").count(), "sample")
        bar = max(20, (sample.agg(F.sum("count")).first()[0] or 0) // 2000)  # under 2000 parts have more
        hot = [r[0] for r in sample.filter(F.col("count") > bar).select("part").collect()]
        filed = tagged.select("text").mapInArrow(_filed(rule, hot), "part long, node long, mark long")
        filed = filed.repartition("part", F.col("mark") % (1 << SALT_BITS)).sortWithinPartitions("part", "node")
        found = filed.mapInArrow(_shared_parts, "part long, node long, mark long")
        need = F.shiftright(F.col("mark"), SALT_BITS).bitwiseAND(F.lit((1 << NEED_BITS) - 1))
        shared = materialise(found.select("part", "node", need.alias("need"), F.shiftright("mark", SALT_BITS + NEED_BITS).alias("size_class")), "shared")
        for _ in range(2):  # what is left out may leave others alone with a part
            able = materialise(_able(shared), "able")
            several = able.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1")
            # a part that several lacks has one row
            shared = materialise(lookup_join(able, materialise(several, "several"), ["part"], "n", able.count(), F.col("node")).filter("n is not null").drop("n"), "shared")
        shared = materialise(_able(shared), "shared")
        weights = shared.groupBy("node").agg(F.count("*").alias("weight"))
        weighted = materialise(shared.join(weights, "node"), "weighted")
        leaders = weighted.groupBy("part").agg(F.max(F.struct("weight", F.col("node"))).alias("l"), F.count("*").alias("n")).select("part", F.col("l.node").alias("leader"), "n")
        led = lookup_join(weighted.select("part", "node", "size_class", "need"), materialise(leaders, "leaders"), ["part"], "n", weighted.count(), F.col("node"))
        files = led.filter("node != leader").groupBy("node", "size_class", "leader").agg(F.count("*").alias("n"), F.max("need").alias("need"))
        fewest = Window.partitionBy("node", "size_class").orderBy("n", "leader").rowsBetween(Window.unboundedPreceding, 0)
        kept = files.withColumn("upto", F.sum("n").over(fewest)).filter("2 * upto > need - 1")
        return keep(kept.select("node", "leader").distinct(), "grouped")


def _paired(deltas: DataFrame, label: DataFrame, rule: Rule) -> DataFrame:
    """Postings of members of opened groups: POSTINGS, and n_rows and rep of the members that share the token."""
    spark = deltas.sparkSession
    with scratch(spark) as keep:
        slim = deltas.select("row", "node", "leader", "linked", F.size("added").alias("n_added")).join(label, "node", "left")
        slim = materialise(slim.select("row", "leader", "linked", "n_added", F.coalesce("root", "node").alias("comp")), "slim")
        groups = slim.groupBy("leader").agg(F.count("*").alias("n_group"), F.sum("n_added").alias("n_tokens"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_if(~F.col("linked")).alias("n_queries"))
        groups = materialise(groups.withColumn("live", (F.col("lo") != F.col("hi")) & (F.col("n_queries") > 0)), "groups")
        bar = max(BLOCK_TOKENS, (groups.filter("live").agg(F.sum("n_tokens")).first()[0] or 0) // MATRIX_SHARE)
        ways = F.when(F.col("live"), F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / bar).cast("int"))).otherwise(0)
        found = lookup_join(slim, groups.select("leader", "n_group", ways.alias("ways")), ["leader"], "n_group", slim.count(), F.col("row"))
        live = materialise(deltas.join(found.filter("ways > 0").select("row", "comp", "ways"), "row"), "live")
        # tokens that about `bar` members of a group have are known without the matrix; under 2 * MATRIX_SHARE of them
        sample = live.filter((F.col("ways") > 1) & (F.pmod(F.xxhash64("row"), F.lit(SAMPLED)) == 0)).select("leader", F.explode("added").alias("token"))
        most = sample.groupBy("leader", "token").count().filter(F.col("count") > max(HEAVY, bar // SAMPLED)).select("leader", "token").collect()
        heavy = np.sort(_in_group(np.array([r[0] for r in most], np.int64), np.array([r[1] for r in most], np.int64)))
        blocks_ = live.select("row", "leader", "ways", "added").mapInArrow(_blocks(heavy), BLOCKS)
        union = blocks_.repartition("leader", "way").sortWithinPartitions("leader", "way").mapInArrow(_in_union, UNION)
        union = union.groupBy("row").agg(F.collect_list(F.struct("tokens", "members")).alias("u")).select("row", F.flatten("u.tokens").alias("tokens"), F.flatten("u.members").alias("members"))
        empty = F.array().cast("array<long>")
        facts = live.join(materialise(union, "union"), "row", "left").withColumns({c: F.coalesce(c, empty) for c in ("tokens", "members")})
        postings = materialise(facts.mapInArrow(_postings(rule, heavy), POSTINGS), "postings")
        head = F.when(F.col("query"), F.struct("place", "node", "comp", "n", "size", "short", "query"))
        stats = postings.groupBy("leader", "token").agg(F.count("*").alias("n_rows"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(head).alias("rep"))
        shared = lookup_join(postings, materialise(stats, "stats"), ["leader", "token"], "n_rows", postings.count(), F.col("node"))
        return keep(shared.filter("rep is not null and lo != hi").drop("lo", "hi"), "shared")


def _celled(postings: DataFrame) -> DataFrame:
    """Postings with their chunk, in each of the cells that pair it with a chunk of the same token."""
    k = F.ceil(F.col("n_rows") / CHUNK).cast("int")
    cut = postings.withColumn("k", k).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cell = F.least("chunk", "other").cast("long") * F.col("k") + F.greatest("chunk", "other")
    return cells.withColumn("cell", cell).select(*columns_of(POSTINGS), "chunk", "cell")


def _linked(tagged: DataFrame, rule: Rule) -> DataFrame:
    """Rows doc_id, row, text become doc_id, row, n_shingles, component_id, first_row.

    `row` tells rows without an id apart. component_id is the smallest id of the component, and
    first_row its smallest row.
    """
    spark = tagged.sparkSession
    sets = materialise(tagged.mapInArrow(_sets(rule), SETS), "sets")
    full = sets.filter("n_shingles > 0")
    nodes = materialise(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.count("*").alias("n_rows")), "nodes")
    same = full.filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b")  # one id, several sets
    again = full.join(same.select("doc_id", "a"), "doc_id").select("a", F.col("node").alias("b")).filter("a != b").distinct()

    with scratch(spark) as keep:
        pairs = _grouped(tagged, sets, rule)
        # token sets of the nodes in groups
        active = pairs.select("node").unionByName(pairs.select(F.col("leader").alias("node"))).distinct()
        wanted = spark.sparkContext.broadcast(id_filter(nodes.join(active, "node").select("doc_id")))
        found = tagged.select("doc_id", "text").mapInArrow(_tokens(rule, wanted), "node long, tokens binary").join(active, "node", "left_semi")
        tokens = materialise(found.dropDuplicates(["node"]), "tokens")

        def verified(some: DataFrame) -> DataFrame:
            sides = salted_tokens(salted_tokens(some, "a", "b", tokens, "x"), "b", "a", tokens, "y")
            return materialise(sides.select("a", "b", "x", "y").mapInArrow(_verified(rule), "a long, b long"), "links")

        # members against their leaders
        both = salted_tokens(salted_tokens(pairs, "node", "leader", tokens, "own"), "leader", "node", tokens, "lead")
        deltas = both.select("node", "leader", "own", "lead").mapInArrow(_deltas(rule), DELTAS)
        deltas = materialise(deltas.withColumn("row", F.monotonically_increasing_id()), "deltas")
        links = deltas.filter("linked").select(F.col("node").alias("a"), F.col("leader").alias("b")).unionByName(again)
        with scratch(spark) as own:
            label = own(components(links).withColumnRenamed("v", "node"), "label")

        # members that share a token, with one of them; then pairs that are not connected yet
        postings = _paired(deltas, label, rule)
        star = postings.filter(may_link(rule, lambda c: F.col(c), lambda c: F.col("rep")[c]))
        star = materialise(star.select(F.least("node", "rep.node").alias("a"), F.greatest("node", "rep.node").alias("b")).distinct(), "star")
        links = verified(star)
        if not links.isEmpty():
            label = merged(label, links)
            postings = postings.join(label, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        dealt = _celled(postings).repartition("leader", "token", "cell").sortWithinPartitions("leader", "token", "cell")
        near = dealt.mapInArrow(_pairs_of(rule), "a long, b long").distinct().join(star, ["a", "b"], "left_anti")
        links = verified(materialise(near, "near"))
        if not links.isEmpty():
            label = merged(label, links)
        label = keep(label, "label")

    # the smallest id of each component, back to its rows
    named = nodes.join(label, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialise(named, "named")
    of_root = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("row").alias("first_row"), F.count("*").alias("n_nodes"))
    final = lookup_join(named.select("node", "root", "n_rows"), materialise(of_root, "roots"), ["root"], "n_nodes", named.count(), F.col("node"))
    final = materialise(final.filter("n_nodes > 1 or n_rows > 1").select("node", "n_rows", "n_nodes", "component_id", "first_row"), "final")
    # a node that final lacks has one row
    out = lookup_join(full.select("doc_id", "row", "n_shingles", "node"), final, ["node"], "n_rows", full.count(), F.struct("doc_id", "row"))
    alone = F.col("n_nodes").isNull()
    out = out.select("doc_id", "row", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("row")).otherwise(F.col("first_row")).alias("first_row"))
    return out.unionByName(sets.filter("n_shingles = 0").select("doc_id", "row", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row").alias("first_row")))


def drop_near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", rule: Rule = Rule(5, 80, 100)) -> DataFrame:
    """The rows of `df` without those whose component has a smaller id.

    Rows without an id come after all others, so of a component of such rows alone one stays.
    Null and empty texts stay; rows that share an id stay or go together.
    """
    spark, own = df.sparkSession, fresh(df, "_row")
    numbered = df.filter(F.col(doc_id).isNull()).withColumn(own, F.monotonically_increasing_id())
    unnamed = materialise(numbered, "unnamed")  # the numbers must stay
    named = df.filter(F.col(doc_id).isNotNull())
    tagged = [rows.select(F.col(doc_id).cast("long").alias("doc_id"), row.cast("long").alias("row"), F.col(text).alias("text")) for rows, row in ((named, F.lit(None)), (unnamed, F.col(own)))]
    with scratch(spark) as keep:
        found = _linked(tagged[0].unionByName(tagged[1]), rule)
        loses = F.when(F.col("component_id").isNotNull(), F.col("doc_id").isNull() | (F.col("component_id") < F.col("doc_id"))).otherwise(F.col("first_row") < F.col("row"))
        losers = keep(found.filter(loses).select("doc_id", "row").distinct(), "losers")
    gone = losers.filter("doc_id is not null").select(F.col("doc_id").alias(own))
    kept = named.join(gone, named[doc_id] == gone[own], "left_anti").select(*df.columns)
    again = losers.filter("doc_id is null").select(F.col("row").alias(own))
    return kept.unionByName(unnamed.join(again, own, "left_anti").select(*df.columns))
