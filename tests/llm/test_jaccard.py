import re
from itertools import combinations

import numpy as np
import pytest

from chunkspark.llm import jaccard
from chunkspark.llm.jaccard import Rule, components, drop_near_duplicates, linked_components

from .conftest import sentence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, part):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w)} if 0 < len(w) < width else set(zip(*(w[k:] for k in range(width)), strict=False))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= part * len(sets[a] | sets[b]):
            links += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}, links


def families(rng):
    """Originals, copies, and near copies with one to many words changed, dropped or added."""
    rows = []
    for n in (4, 9, 14, 25, 60, 150, 400):
        base = sentence(rng, n).split()
        for _ in range(45):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(own))
                kind = rng.randrange(3)
                own[at : at + 1] = [[f"new{rng.randrange(9)}"], [], [own[at], f"more{rng.randrange(9)}"]][kind]
                own = own or ["x"]
            rows.append(" ".join(own))
    rows += [sentence(rng, rng.randrange(1, 80)) for _ in range(60)] + [None, "", "  ", "a b", "A  B", "a", "a"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "part"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, rng, width, part):
    rows = families(rng)
    want, links = brute(rows, width, part)
    found = linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rule=Rule(width, part)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert links > 500 and len({c for _, c in want.values()}) > 60


def test_hot_groups_tokens_and_lists_are_split(spark, rng, monkeypatch):
    """With small bounds every group has several blocks, common tokens are heavy, and lists of members have several cells."""
    for name, value in (("BLOCK_TOKENS", 5), ("HEAVY", 3), ("SAMPLED", 1), ("CHUNK", 3)):
        monkeypatch.setattr(jaccard, name, value)
    rows = families(rng)
    want, _ = brute(rows, 5, 80)
    found = linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rule=Rule(5, 80)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_a_large_family_whose_members_mostly_do_not_link(spark, rng):
    """Members change some words of one text; two copies of the same variant link, members of different ones mostly don't."""
    base = sentence(rng, 120).split()
    rows = []
    for v in range(500):
        own = list(base)
        for _ in range(rng.randrange(2, 14)):
            own[rng.randrange(len(own))] = f"v{v}x{rng.randrange(99)}" if rng.random() < 0.7 else f"all{rng.randrange(3)}"
        rows.append(" ".join(own))
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(own)
            near[rng.randrange(len(near))] = f"w{rng.randrange(999)}"
            rows.append(" ".join(near))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want, links = brute(rows, 5, 80)
    found = linked_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), rule=Rule(5, 80)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert len({c for _, c in want.values()}) > 100 and links > 500


def test_id_filter(spark):
    ids = spark.range(0, 30_000, 3)
    words = jaccard.id_filter(ids)
    asked = np.arange(30_000)
    hit = jaccard.passes(words, asked)
    assert hit[::3].all() and hit.mean() < 0.4


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)]
    found = dict(components(spark.createDataFrame(chain + star, "a long, b long")).collect())
    assert found == {**{i: 100 for i in range(101, 161)}, **{i: 5 for i in range(200, 260)}}


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    found = linked_components(odd_docs).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == 15 and got[0].n_shingles == got[1].n_shingles == got[2].n_shingles == 0
    assert got[8].component_id == got[9].component_id == got[10].component_id == 8
    assert got[11].n_shingles == 1 and got[None].component_id is None and got[12].component_id == 12
    kept = drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 12, None]))
    assert linked_components(no_docs).collect() == [] and drop_near_duplicates(no_docs).collect() == []
