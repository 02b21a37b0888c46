"""From raw documents to packed sequences: the stages of a training corpus.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns
the columns of `documents`, the last one its pieces. `run` writes each stage's result to the
shared folder and reads it again, so a stage never repeats the work before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkspark.llm.exact_dedup import drop_duplicates
from chunkspark.llm.jaccard import Rule, drop_near_duplicates
from chunkspark.llm.mixing import mix
from chunkspark.llm.packing import pack
from chunkspark.llm.quality_rules import drop_low_quality
from chunkspark.llm.shared import materialise
from chunkspark.llm.tokens import tokenizer_path

#: Near duplicates: word 5-grams, similarity of 0.8 or more.
NEAR = Rule(words=5, part=80, whole=100)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or the trained model's threshold go. Null texts fail.

    Where labels are too few for a model the base rules alone decide.
    """
    return drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), without_model=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id stays."""
    return drop_duplicates(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links connect the one with the smallest doc_id stays.

    Null and empty texts link with nothing. Rows without an id come after all others.
    """
    return drop_near_duplicates(docs, rule=NEAR)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents 0 to 3 times each, so that sources come to their target weights.

    The null source is a source, last in order. Null and empty texts have no words to take.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most 4096."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: A trained model decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
