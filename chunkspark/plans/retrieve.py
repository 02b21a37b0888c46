"""Questions to contexts: embed, search every domain, assemble prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkspark.config import EmbeddingConfig
from chunkspark.operators.chat import with_prompt
from chunkspark.operators.embed import embed_texts, embedding
from chunkspark.operators.search import batch_nearest, over_domains, search, vector_literal


def retrieve(questions: DataFrame, stores: dict[str, DataFrame], k: int = 10, metric: str = "l2", config: EmbeddingConfig | None = None) -> DataFrame:
    """qid, domain, id, document, score, rk: the k nearest rows of every domain to each question (qid, question).

    Questions are embedded once and asked of all stores in one batch.
    """
    rows = reduce(DataFrame.unionByName, (store.select("id", "embedding", F.col("content").alias("document"), F.lit(name).alias("domain")) for name, store in stores.items()))
    found = retrieve_within(questions, rows, "domain", k, metric, config)
    return found.join(rows.select("domain", "id", "document"), ["domain", "id"]).select("qid", "domain", "id", "document", (1 - F.col("dist")).alias("score"), "rk")


def retrieve_within(questions: DataFrame, store: DataFrame, domain: str = "domain", k: int = 10, metric: str = "l2", config: EmbeddingConfig | None = None, digits: int | None = None) -> DataFrame:
    """qid, domain, id, dist, rk: as `retrieve`, for one store whose rows name their domain, in one batch over all domains."""
    asked = questions.select("qid", embedding(F.col("question"), config, "query").alias("qv"))
    return batch_nearest(store, asked, k, metric, within=domain, digits=digits).withColumnRenamed(domain, "domain")


def prompts(questions: DataFrame, stores: dict[str, DataFrame], k: int = 10, config: EmbeddingConfig | None = None) -> DataFrame:
    """Questions with retrieved_context and prompt, domain after domain."""
    found = retrieve(questions, stores, k, config=config)
    return with_prompt(questions, found.withColumn("place", F.struct("domain", "rk")), rank="place")


def tool_results(stores: dict[str, DataFrame], vector: Column, k: int = 10, digits: int | None = None) -> DataFrame:
    """result: a JSON object of id, document, metadata and score for each of the k nearest rows of every domain."""
    def rows(store: DataFrame) -> DataFrame:
        score = F.col("score") if digits is None else F.col("score").cast(f"decimal(18,{digits})")
        return search(store, vector, k).select("id", F.col("content").alias("document"), F.col("doc_metadata").alias("metadata"), score.alias("score"))

    found = over_domains({n: rows(s) for n, s in stores.items()})
    return found.select("domain", F.to_json(F.struct("id", "document", "metadata", "score")).alias("result"))


def search_tool(stores: dict[str, DataFrame], query: str, k: int = 10, config: EmbeddingConfig | None = None) -> list[str]:
    """Results for one query as JSON strings, for tool servers; at most k for each domain."""
    return [r["result"] for r in tool_results(stores, vector_literal(embed_texts(query, config, "query")), k).collect()]
