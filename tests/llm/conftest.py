import random

import pytest

WORDS = ["the", "of", "and", "tion", "er", "ing", "Größe", "été", "ñu", "data", "mill", "stone", "river", "cloud", "paper", "light"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(5)


#: Rows that every operator must stand: null, empty, blank, long, repeated and odd texts.
ODD = [None, "", " \n\t ", "x", "One two", "A b 　c", "é İI \U0001f600 z", "\x00\x01 a", "same text here", "same text here", "SAME text here", "word " * 30_000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """doc_id, text and columns with clashing names; rows 12 and 13 are one row twice, 14 has no id."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 1, "t") for i, t in enumerate(ODD)]
    rows += [(12, "twice the same row", "en", "s0", 1, "t")] * 2 + [(None, "no id at all", None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_words long, tag string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
