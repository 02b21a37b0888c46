import numpy as np
import pytest

from chunkspark.llm.token_counts import SEPARATOR, count_documents, id_width, token_counts
from chunkspark.llm.tokens import tokenizer_path

from .conftest import sentence


@pytest.mark.parametrize("block", [2, 4, 6, 26, 100])
def test_blocks_are_stitched(spark, tmp_path, block):
    np.array([5, 5, 9, 9, 5, 5, 5, 5, 5, 5, 5, 9, 5], "<u2").tofile(tmp_path / "a")
    np.array([9, 9], "<u2").tofile(tmp_path / "b")
    np.array([5] * 20, "<u2").tofile(tmp_path / "c")
    (tmp_path / "empty").touch()
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a", "b", "c", "empty")], "file string")
    found = sorted((r.file[-1], r.place, r.n_tokens, r.ended) for r in count_documents(files, 9, 2, block).collect())
    assert found == [("a", 0, 2, True), ("a", 1, 0, True), ("a", 2, 7, True), ("a", 3, 1, False), ("b", 0, 0, True), ("b", 1, 0, True), ("c", 0, 20, False)]


def test_counts_equal_the_tokenizer(spark, rng, odd_docs, no_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = {i: sentence(rng, rng.randrange(400)) for i in range(200)} | {200: "ends <|endoftext|> not here"}
    found = dict(token_counts(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), tokenizer_path()).collect())
    t.encode_special_tokens = True
    assert found == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}
    odd = token_counts(odd_docs, tokenizer_path()).collect()
    assert len(odd) == 15 and {r.doc_id: r.n_tokens for r in odd}[0] == 0
    assert token_counts(no_docs, tokenizer_path()).collect() == []


def test_wider_ids(spark, rng):
    path = tokenizer_path()
    assert id_width(path, SEPARATOR) == 2 and id_width(path, 70_000) == 4
    texts = {i: sentence(rng, 40) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = dict(token_counts(df, path).collect())
    assert dict(token_counts(df, path, separator=(1 << 31) + 5).collect()) == want
    with pytest.raises(Exception, match="does not fit"):
        token_counts(df, path, separator=70_000, width=2).collect()
