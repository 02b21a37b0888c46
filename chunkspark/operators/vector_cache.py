"""Vectors by content: a text is embedded once for each space, whatever row, file or run it is met in.

A space is what a vector depends on besides its text: provider, model, dimension, mode, prompt and server.
The cache is a table of segments, so a run adds the texts that it lacks and rewrites nothing.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkspark.config import EmbeddingConfig
from chunkspark.operators.embed import embedding, prompted
from chunkspark.operators.segments import Table
from chunkspark.schema import T, fields

CACHED = fields(space=T.StringType(), hash=T.StringType(), embedding=T.ArrayType(T.FloatType()))


def space_of(config: EmbeddingConfig, mode: str) -> str:
    prompt = config.query_prompt if mode == "query" else ""
    server = [config.url] if config.url else []
    return hashlib.sha256(json.dumps([config.provider, config.model, config.dimension, mode, prompt, *server]).encode()).hexdigest()[:32]


class VectorCache:
    def __init__(self, spark: SparkSession, path: str):
        self.table = Table(spark, path, CACHED, ["space", "hash"])

    def _known(self, space: str) -> DataFrame:
        return self.table.read().filter(F.col("space") == space).select(F.col("hash").alias("_hash"), F.col("embedding").alias("_vector"))

    def embed(self, rows: DataFrame, text: str, config: EmbeddingConfig | None = None, mode: str = "document", out: str = "embedding") -> DataFrame:
        """`rows` with the vectors of `text`. Texts that the cache lacks are embedded, once each, and entered first.

        Null texts count as empty. Two runs that embed one text at a time enter it twice, alike; the
        later entry takes the earlier one back. `rows` is read twice.
        """
        config = config or EmbeddingConfig()
        prompted([], config, mode)
        space = space_of(config, mode)
        keyed = rows.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_hash", F.sha2("_text", 256))
        unseen = keyed.select("_hash", "_text").join(self._known(space).select("_hash"), "_hash", "left_anti")
        unseen = unseen.groupBy("_hash").agg(F.first("_text").alias("_text")).persist()
        try:
            if unseen.take(1):
                self.table.upsert(unseen.select(F.lit(space).alias("space"), F.col("_hash").alias("hash"), embedding(F.col("_text"), config, mode).alias("embedding")))
        finally:
            unseen.unpersist()
        found = keyed.drop("_text", *([out] if out in rows.columns else [])).join(self._known(space), "_hash", "left")
        return found.select(*[c for c in rows.columns if c != out], F.col("_vector").alias(out))
