"""What the stages keep, held against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from chunkspark.llm.jaccard import Rule, drop_near_duplicates
from chunkspark.llm.tokens import tokenizer_path

from .conftest import sentence
from .test_jaccard import LOW, brute
from .test_mixing import size, water


def test_near_copies_without_an_id_go(spark, rng):
    """Of each group one row stays, the one with the smallest id if any has one."""
    base = [sentence(rng, 60).split() for _ in range(4)]

    def near(k, at):
        return " ".join(base[k][:at] + ["changed"] + base[k][at + 1 :])

    rows = [(7, near(0, 5)), (None, near(0, 50)), (None, " ".join(base[0]))]
    rows += [(None, near(1, 9)), (None, " ".join(base[1])), (None, " ".join(base[1]))]
    rows += [(None, " ".join(base[2])), (None, None), (None, ""), (3, " ".join(base[3])), (2, near(3, 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = drop_near_duplicates(df, rule=Rule(5, 80, 100))
    assert kept.columns == df.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    second = [x for x in found if x in rows[3:6]]
    assert len(second) == 1
    found.remove(second[0])
    assert sorted(found, key=str) == sorted([rows[0], *rows[6:9], rows[10]], key=str)


def test_run_equals_the_stages_by_brute_force(spark, sf_dir):
    """The model's verdicts and the draw among documents of a source are taken as given, within its target."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    passed = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).collect()]
    keep = {}
    for i, text, _ in sorted(passed):
        keep[text.translate(LOW)] = i
    unique = {i: (text, source) for i, text, source in passed if keep[text.translate(LOW)] == i}
    roots, links = brute([(i, t) for i, (t, _) in unique.items()], 5, 80)
    left = {i: x for i, x in unique.items() if roots[i][1] == i}
    assert len(passed) > len(unique) > len(left) and links

    found, pieces = corpus_pipeline.run(spark, sf_dir).collect(), defaultdict(Counter)
    sequences = defaultdict(list)
    for r in found:
        pieces[r.doc_id][r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) <= set(left)

    # mixing: every source at its target, to within one document
    sizes, taken, longest = Counter(), Counter(), Counter()
    for i, (text, source) in left.items():
        copies = sum(n for (start, *_), n in pieces[i].items() if start == 0)
        assert 0 <= copies <= 3
        sizes[source] += size(text)
        taken[source] += copies * size(text)
        longest[source] = max(longest[source], size(text))
    for source, target in water(sizes).items():
        assert abs(taken[source] - target) <= longest[source]

    # packing: every copy is whole, sequences have no gaps
    encoder = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for i, own in pieces.items():
        if not own:
            continue
        ids = np.array([*encoder.encode(left[i][0], add_special_tokens=False).ids, 2], "<u4")
        spans = sorted(own)
        assert len(set(own.values())) == 1 and sum(n for _, n, *_ in spans) == len(ids)
        at = 0
        for start, length, crc, total in spans:
            assert start == at and total == len(ids) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(sequences) == list(range(len(sequences)))
