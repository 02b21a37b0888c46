import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest

from chunkspark.llm import row_patterns as rp

CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, value double, props string"


def cents(value):
    return None if value is None else int(np.floor(100 * value + 0.5))


def backtracked(rows):
    """Matches of one client's sorted rows by a plain recursive matcher in order of preference."""
    c = [cents(r[4]) for r in rows]

    def fits(letter, i, first):
        if i >= len(rows) or c[i] is None:
            return False
        if letter == "A":
            return True
        if c[i - 1] is None or rows[i][1] - rows[i - 1][1] > timedelta(minutes=30):
            return False
        if letter == "P":
            return rows[i][3] == "click" and c[i] >= c[first]
        return rows[i][3] not in (None, "error") and (c[i] < c[i - 1] if letter == "D" else c[i] > c[i - 1])

    def downs(i, first, so_far):
        if fits("D", i, first):
            yield from downs(i + 1, first, so_far + "D")
            yield from ups(i + 1, first, so_far + "D")

    def ups(i, first, so_far):
        if fits("U", i, first):
            yield from ups(i + 1, first, so_far + "U")
            yield from downs(i + 1, first, so_far + "U")
            yield from last(i + 1, first, so_far + "U")

    def last(i, first, so_far):
        if fits("P", i, first):
            yield so_far + "P"
        yield so_far

    out = []
    for i in range(len(rows)):
        if fits("A", i, i) and (labels := next(downs(i + 1, i, "A"), None)):
            end = i + len(labels)
            out.append((rows[i][0], rows[end - 1][0], len(labels), sum(c[i:end]), labels))
    return out


def expected(rows):
    groups = defaultdict(list)
    for r in set(rows):
        if r[2] is not None and r[1] is not None:
            groups[r[2]].append(r)
    out = []
    for client, own in groups.items():
        own.sort(key=lambda r: (r[1], r[0]))
        out += [(client, i, *m) for i, m in enumerate(backtracked(own), 1)]
    return sorted(out)


def got(df, blocks):
    return sorted(tuple(r) for r in rp.value_swings(df, blocks).collect())


def table(rng, n, clients, gap, kinds=("click", "view", "error", None)):
    at = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at += timedelta(seconds=rng.randrange(gap))
        value = None if rng.random() < 0.03 else rng.randrange(900) / 100
        rows.append((i, None if rng.random() < 0.01 else at, rng.choice(clients), rng.choice(kinds), value, rng.choice(["{}", None])))
    return rows + rows[:: 9]


@pytest.mark.parametrize("blocks", [1, 5, 40])
def test_matches_equal_backtracking(spark, blocks):
    rng = random.Random(5)
    rows = table(rng, 600, [1, 1, 1, 2, 3, None], 400, ("click", "view", "view", "view", "error", None))
    found, want = got(spark.createDataFrame(rows, CLICKS).repartition(3), blocks), expected(rows)
    assert found == want and any(m[-1].endswith("P") for m in want) and len(want) > 40


def test_one_chain_through_many_blocks(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(minutes=i), 7, "click", 5.0 + (i % 3) * (1 + i % 5), None) for i in range(120)]
    found = got(spark.createDataFrame(rows, CLICKS), 30)
    assert found == expected(rows) and max(m[4] for m in found) > 60


def test_small_chunks_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(rp, "ROWS", 16)
    monkeypatch.setattr(rp, "STARTS", 3)
    rows = table(random.Random(3), 300, [1, 1, 2, 3, 4], 300)
    search = rp.Search(rp.SWINGS, rp.LETTERS, ["calm", "click"])
    df = spark.createDataFrame(rows, CLICKS)
    import pyarrow as pa
    from pyspark.sql import functions as F

    slim = df.filter("client_id is not null and ts is not null").select(F.col("client_id").alias("key"), "ts", F.col("click_id").alias("id"), rp.cents(F.col("value")).alias("measure"), F.coalesce(F.col("kind") != "error", F.lit(False)).alias("calm"), F.coalesce(F.col("kind") == "click", F.lit(False)).alias("click"), F.lit(b"").alias("rest"), F.lit(0).alias("block"))
    sorted_rows = slim.orderBy("key", "ts", "id").toArrow()
    made = pa.Table.from_batches(search.block(True)(iter(sorted_rows.to_batches(max_chunksize=7)))).to_pylist()
    matches = {(m["key"], m["id"]): (m["rank"], m["last_id"], m["n_rows"], m["measure"], m["labels"]) for m in made if m["at"] is None}
    want = {(m[0], m[2]): (m[1], *m[3:]) for m in expected(rows)}
    assert len(matches) >= len(want) - 4 and all(want[k][1:] == v[1:] for k, v in matches.items())


def naive(pattern, letters, rows):
    """First rows' matches by trying every path in order of preference."""
    now = {k: np.array([r[k] for r in rows]) for k in rows[0]}
    before = {k: np.concatenate([v[:1], v[:-1]]) for k, v in now.items()}
    fits = {k: x.fits(now, before) for k, x in letters.items()}
    measure = now["measure"]

    def paths(place, i, first, so_far):
        name = pattern.letters[place]
        if i >= len(rows) or not fits[name][i] or letters[name].above_first and measure[i] < measure[first] or i == 0 and place not in pattern.first:
            return
        for q in pattern.follow[place]:
            if q == rp.ACCEPT:
                yield so_far + name
            else:
                yield from paths(q, i + 1, first, so_far + name)

    return {i: m for i in range(len(rows)) if (m := next((m for p in pattern.first for m in paths(p, i, i, "")), None))}


def test_patterns_in_which_a_greedy_step_must_give_way():
    letters = {"A": rp.Letter(lambda n, b: n["measure"] % 2 == 0), "B": rp.Letter(lambda n, b: n["measure"] > 2), "C": rp.Letter(lambda n, b: n["measure"] % 3 == 0, above_first=True), "E": rp.Letter(lambda n, b: n["measure"] % 3 != 1)}
    patterns = [rp.seq("A", rp.plus("B"), "C"), rp.seq("A", rp.plus(rp.either("B", rp.seq("E", "C"))), "C"), rp.seq("A", rp.optional("B"), rp.plus(rp.seq("E", rp.optional("C"))), "C", rp.optional("C")), rp.either(rp.seq("A", "C", "B"), rp.seq("E", "B", "C"))]
    rng = random.Random(8)
    for node in patterns:
        pattern = rp.Pattern(node)
        for _ in range(25):
            rows = [{"measure": rng.randrange(10), "has_measure": True, "ts": i} for i in range(rng.randrange(1, 24))]
            columns = {k: np.array([r[k] for r in rows]) for k in rows[0]}
            chains = rp.Chains(pattern, letters, columns, np.arange(len(rows)) > 0)
            best = chains.values(np.full(len(pattern.letters), rp.LOW))
            search = rp.Search(pattern, letters, [])
            begin, places = search.starts(chains, best, len(rows))
            count, labels, out = chains.walk(best, begin, places, chains.measure[begin])
            ends = np.cumsum(count)
            assert (out == rp.ACCEPT).all()
            assert {int(i): labels[e - n : e].decode() for i, n, e in zip(begin, count, ends, strict=True)} == naive(pattern, letters, rows)


def test_expression_agrees_with_re():
    rng = random.Random(4)
    pattern = rp.SWINGS
    letters = {k: rp.Letter(lambda n, b, k=k: np.array([k in x for x in n["fits"]])) for k in "ADUP"}
    for _ in range(60):
        words = [rng.choice(["A", "AD", "AU", "AD", "AU", "AP", ""]) for _ in range(30)]
        columns = {"measure": np.zeros(30, np.int64), "has_measure": np.ones(30, bool), "ts": np.arange(30), "fits": np.array(words, object)}
        chains = rp.Chains(pattern, letters, columns, np.arange(30) > 0)
        best = chains.values(np.full(4, rp.LOW))
        begin, places = rp.Search(pattern, letters, []).starts(chains, best, 30)
        count, labels, _ = chains.walk(best, begin, places, chains.measure[begin])
        text = "".join(w[-1] if len(w) > 1 else w or "-" for w in words)
        want = {i: m[0] for i in range(30) if words[i] and (m := re.compile(r"(D+U+)+P?").match(text, i + 1))}
        ends = np.cumsum(count)
        assert {int(i): labels[e - n + 1 : e].decode() for i, n, e in zip(begin, count, ends, strict=True)} == want


def test_odd_rows_and_empty_tables(spark):
    assert got(spark.createDataFrame([], CLICKS), 3) == []
    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(seconds=i), 1, "view", v, "x") for i, v in enumerate([3.0, 2.0, float("nan"), 3.0, 1.0, 2.0, None, 1.0])]
    rows += [(None, at + timedelta(seconds=20), 1, "view", 0.5, None), (9, at + timedelta(seconds=20), 1, "click", 9.0, None), (1, None, 1, "view", 1.0, ""), (1, at, None, "view", 1.0, "")]
    df = spark.createDataFrame(rows, CLICKS).selectExpr("*", "1 as cents", "true as calm", "'k' as key", "0 as piece", "2 as block")
    assert got(df.union(df), 3) == [(1, 1, 3, 5, 3, 600, "ADU"), (1, 2, 7, 9, 3, 1050, "ADU")]
    with pytest.raises(ValueError, match="matches no rows"):
        rp.Pattern(rp.optional("A"))
