import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkspark.llm.packing import pack, plan_packs
from chunkspark.llm.text import blocks
from chunkspark.llm.tokens import HashTable, WordEncoder, tokenizer_path

from .conftest import ODD, sentence

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(found, texts, tokenizer, capacity=4096):
    """Every id once, pieces as they say, sequences gapless and within capacity."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for key, own in pieces.items():
        ids = np.array([*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert sorted(sequences) == list(range(len(sequences)))


def test_packs_are_whole_and_full(spark, rng, tokenizer):
    texts = {i: sentence(rng, rng.choice([3, 30, 300, 900])) + " ABC-def's 12" for i in range(400)}
    found = pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7), PATH).collect()
    assert set(texts) == {r.doc_id for r in found}
    check(found, texts, tokenizer)
    n = max(r.sequence_id for r in found) + 1
    assert sum(r.length for r in found) >= 0.97 * 4096 * (n - 1)


def test_odd_rows_and_empty_tables(spark, no_docs, tokenizer):
    texts = dict(enumerate(ODD))
    found = pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH).collect()
    check(found, texts, tokenizer)
    assert {r.doc_id for r in found} == set(texts) and sum(r.doc_id == 11 for r in found) > 5
    assert pack(no_docs, PATH).collect() == []


def test_null_ids_and_repeated_rows_are_packed_each(odd_docs):
    found = pack(odd_docs, PATH).collect()
    assert sum(r.doc_id == 12 for r in found) == 2 and sum(r.doc_id is None for r in found) == 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_plan_places_each_rank_once(histogram):
    slots = plan_packs(histogram, 64)
    seen, load = defaultdict(set), defaultdict(list)
    for length, a, b, packs, first, offset in slots.tolist():
        for r in range(a, b):
            assert r not in seen[length]
            seen[length].add(r)
            load[first + (r - a) % packs].append((offset + length * ((r - a) // packs), length))
    assert {k: len(v) for k, v in seen.items()} == histogram
    for own in load.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aAbZz'st09 .,!<|>\n\t\r\x0b\x1c\x85", *"éÉſKİΣς\u0301\u0338\u3000\u00a0中\U0001f600", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]), max_size=25).map("".join), max_size=6))
def test_ids_by_piece_equal_ids_of_texts(texts):
    code = _encoder()
    for a, b, raw, offsets in blocks(pa.array(texts, pa.string())):
        ids, bounds = code.encode(raw, offsets)
        for i in range(b - a):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == code.tokenizer.encode(texts[a + i], add_special_tokens=False).ids


_CODE = []


def _encoder():
    if not _CODE:
        _CODE.append(WordEncoder(PATH, bits=12))  # a small table, so that it is forgotten now and then
    return _CODE[0]


def test_table_grows():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64) << np.uint64(6))  # all alike in their last bits
    found = HashTable(2)
    for part in np.array_split(keys, 7):
        assert (found.find(part) == -1).all()
        found.add(part)
    assert found.n == len(keys) and found.find(keys).tolist() == list(range(len(keys))) and (found.find(keys + np.uint64(1)) == -1).all()


def test_one_text_of_more_pieces_than_slots(tokenizer):
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    n = np.arange(40_000)
    words = np.stack([letters[n // 26**k % 26] for k in range(4)] + [np.full(len(n), 32, np.uint8)], axis=1)
    texts = ["few words", words.tobytes().decode(), "few words again"]
    code = WordEncoder(PATH, bits=10)
    for a, b, raw, offsets in blocks(pa.array(texts, pa.string()), most=40):
        ids, bounds = code.encode(raw, offsets)
        for i in range(b - a):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(texts[a + i], add_special_tokens=False).ids
