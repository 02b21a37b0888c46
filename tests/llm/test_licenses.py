import re

from chunkspark.llm.license_text import PHRASES, TEMPLATES
from chunkspark.llm.licenses import LicenseScanner, SuffixAutomaton, scan_licenses

from .conftest import sentence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def places(text):
    w = words(text)
    return sorted((i, label) for label, phrase in PHRASES for q in [phrase.split()] for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q)


def test_matching_statistics_equal_brute_force(rng):
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(6)]
    automaton = SuffixAutomaton(sequences)
    every = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    text = [rng.randrange(4) for _ in range(300)]
    state = length = 0
    for i, word in enumerate(text):
        state, length = automaton.step(state, length, word)
        assert length == max((k for k in range(1, i + 2) if tuple(text[i + 1 - k : i + 1]) in every), default=0)
        for t, end in automaton.states[state].ends:
            assert sequences[t][end - length + 1 : end + 1] == text[i + 1 - length : i + 1]


def test_places_equal_brute_force(spark, rng):
    parts = ["under the mit license", "the mit license", "under", "Apache-License, version 2.0", "CC BY-NC", "the the MIT", "license", "cc by", "nc", "version 2", "été", "the"]
    rows = [(i, " ".join(rng.choice(parts) if rng.random() < 0.7 else sentence(rng, 3) for _ in range(rng.randrange(40)))) for i in range(300)]
    found = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i, text in rows:
        r, want = found[i], places(text)
        assert (r.n_words, r.n_base) == (len(words(text)), len(want))
        assert (r.first_word, r.last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in want})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_templates_are_found_with_words_changed(spark):
    label, text = TEMPLATES[5]
    own = words(text)
    own[10] = "changed"
    rows = [(1, "before it " + " ".join(own) + " after it"), (2, "nothing of the kind, and a license of sorts")]
    found = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert label in found[1].labels.split(",") and found[1].score > 0.9 and found[1].n_base == 0
    span = next(s for s in found[1].spans if s.label == label and s.cover > 0.9)
    assert (span.first_word, span.last_word) == (2, 1 + len(own))
    assert found[2].labels == "" and found[2].score == 0


def test_a_long_text_of_many_notices(spark):
    text = " ".join(t for _, t in TEMPLATES) * 40
    r = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_base == len(places(text)) and set(r.labels.split(",")) >= {label for label, _ in TEMPLATES} - {"lgpl"}


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    found = scan_licenses(odd_docs).collect()
    assert len(found) == 15 and {r.n_base for r in found} == {0}
    assert scan_licenses(no_docs).collect() == []


def test_rows_don_t_join_at_their_edges():
    import numpy as np

    rows = [b"under the mit", b"license", b"under the mit license", b"under the mit"]
    n, found = LicenseScanner().scan(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))
    assert n.tolist() == [3, 1, 4, 3] and {r: p for r, (p, _) in found.items() if p} == {2: [(0, 0)]}
