"""Texts whose spans clash under polynomial hashes, and hashes that are made to clash."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from chunkspark.llm import quality_rules, text, tokens
from chunkspark.llm.jaccard import Rule, linked_components
from chunkspark.llm.licenses import scan_licenses
from chunkspark.llm.packing import pack
from chunkspark.llm.token_counts import token_counts
from chunkspark.llm.tokens import tokenizer_path

from .test_quality import expected


def thue_morse(n: int, zero: str = "a", one: str = "b") -> str:
    return "".join(one if i.bit_count() % 2 else zero for i in range(n))


#: Pairs of a Thue-Morse word and its complement: equal under any polynomial modulo a power of two.
PAIRS = [(thue_morse(1 << k), thue_morse(1 << k, "b", "a")) for k in (5, 6, 10, 11, 12)]


def test_span_hashes_tell_them_apart():
    for a, b in PAIRS:
        raw = np.frombuffer((a + b).encode(), np.uint8)
        h = text.span_hashes(raw, np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
        assert h[0] != h[1]
        assert text.equal_spans(raw, np.array([0, 0]), np.array([len(a)] * 2), raw, np.array([0, len(a)])).tolist() == [True, False]


def test_ids_are_the_tokenizer_s(spark):
    path = tokenizer_path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(i, f"{a} {b}") for i, (a, b) in enumerate(PAIRS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {r.doc_id: r.doc_tokens - 1 for r in pack(df, path).collect()} == want
    assert {r.doc_id: r.n_tokens for r in token_counts(df, path).collect()} == want


def test_no_false_links(spark):
    rows = [(2 * i + k, f"{p[k]} b c d") for i, p in enumerate(PAIRS) for k in (0, 1)]
    found = linked_components(spark.createDataFrame(rows, "doc_id long, text string"), rule=Rule(3, 50, 100)).collect()
    assert all(r.component_id == r.doc_id and r.n_shingles == 2 for r in found)


def counts(texts):
    for _, _, raw, offsets in text.blocks(pa.array(texts, pa.string())):
        return [tuple(x.tolist()) for x in quality_rules.scan(raw, offsets, None)[0][3:]]


def test_lines_and_windows():
    a, b = PAIRS[-1]
    assert counts([f"{a}\n{b}", f"{a} x y {b} x y"]) == [(0, 0), (0, 0)]
    assert counts([f"{a}\n{a}"]) == [(1,), (0,)]


@pytest.fixture
def clashing(monkeypatch):
    """Every span of a length has one hash."""
    for module in (text, tokens, quality_rules):
        monkeypatch.setattr(module, "span_hashes", lambda raw, starts, ends: text.mix((ends - starts).astype(np.uint64)))


def test_equal_hashes_are_compared_by_bytes(clashing):
    a = "one two six ten\nred\none two six ten\nred\nbig bag\ntwo one six"
    texts = [a, "one two six\none ten six\none two six"]
    assert counts(texts) == list(zip(*(expected(t)[3:] for t in texts), strict=True))
    path = tokenizer_path("word_bpe_49k.json")
    code, plain = tokens.WordEncoder(path), Tokenizer.from_file(path)
    for _ in range(2):
        texts = ["the cat and dog", "two cats ate 12 figs, the cat"]
        for _, _, raw, offsets in text.blocks(pa.array(texts)):
            ids, bounds = code.encode(raw, offsets)
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_licence_words(spark):
    a, b = PAIRS[0]
    found = scan_licenses(spark.createDataFrame([(1, f"under the mit license {a} {b}")], "doc_id long, text string")).first()
    assert found.n_base == 1 and found.base_labels == "mit"


def test_extreme_ids(spark):
    ids = [2**63 - 1, 2**62, 2**62 + 5, -(2**63), -5, None]
    rows = [(i, "the same words in a row here") for i in ids] + [(2**62 + 9, "some other words that stand alone")]
    found = linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {*((i, -(2**63)) for i in ids), (2**62 + 9, 2**62 + 9)}
