import random
import re
from itertools import permutations

import numpy as np
import pytest

from chunkspark.llm import filter_audit as fa


def fails(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text))]


def expected(docs, labels):
    """docs: (doc_id, text, source); every order applied filter by filter."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, s in docs}:
        own = []
        for i, text, s in docs:
            if (s or "") == part:
                again = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
                own.append((i, [*fails(text), again]))
        gone_by = [0] * 5
        rows = []
        for order in permutations(range(5)):
            left = own
            for k, x in enumerate(order, 1):
                gone = [r for r in left if r[1][x]]
                left = [r for r in left if not r[1][x]]
                gone_by[x] += len(gone)
                failing, alone = (sum(r[1][x] for r in own), sum(r[1][x] and sum(r[1]) == 1 for r in own))
                rows.append((x, ("".join("ABCDE"[y] for y in order), k, len(left), len(gone), failing - len(gone), alone, sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone))))
        for x, (order, k, *n) in rows:
            out[part, order, k] = (*n, gone_by[x])
    return out


def found(docs, labels):
    rows = fa.audit(fa.document_masks(docs, labels)).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_equals_applying_every_order(spark):
    rng = random.Random(2)
    parts = ["plain words of a text", "MANY CAPITALS HERE", "a # sign", "the the the the the", " ".join(f"w{i}" for i in range(60)), "x" * 300, "é" * 20 + " Ä\x0b\x1cb\x85c"]
    docs = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(14))), rng.choice(["s", "t", None, ""])) for i in range(150)]
    docs += [(200 + i, docs[rng.randrange(150)][1], "s") for i in range(60)] + [(None, docs[3][1], "t"), (None, None, "t"), (-5, None, None), (7, None, "s"), (7, None, "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 220, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = found(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == expected(docs, labels)


def test_audit_on_odd_rows_and_empty_tables(spark, odd_docs, no_docs, no_labels):
    docs = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    assert found(odd_docs, no_labels) == expected(docs, [])
    assert found(no_docs, no_labels) == {}
    clash = odd_docs.selectExpr("*", "1 as part", "2 as mask", "3 as good", "4 as digest")
    assert found(clash, no_labels) == expected(docs, [])


@pytest.mark.parametrize("k", range(1, 8))
def test_polynomial_against_sets_and_orders(k):
    rng = np.random.default_rng(k)
    counts = rng.integers(0, 9, (2, 1 << k))
    removed, shapley = fa.interactions(counts)
    for r in range(2):
        direct = [sum(int(n) for m, n in enumerate(counts[r]) if m & s) for s in range(1 << k)]
        assert removed[r].tolist() == direct
        if k < 6:
            want = [0] * k
            for order in permutations(range(k)):
                upto = 0
                for i in order:
                    want[i] += direct[upto | 1 << i] - direct[upto]
                    upto |= 1 << i
            assert shapley[r].tolist() == want
    assert (shapley.sum(axis=1) == removed[:, -1] * np.prod(np.arange(1, k + 1))).all()
