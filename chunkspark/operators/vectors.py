"""Vector stores behind one interface: versioned Parquet, memory, and SQL databases through JDBC."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkspark import schema
from chunkspark.config import SearchQuery, StoreConfig
from chunkspark.functions.json import content_of
from chunkspark.functions.vectors import metric_of
from chunkspark.operators import search, store
from chunkspark.operators.segments import Table
from chunkspark.sources.domains import Registry

STORES = Registry("vector store")
#: What a search method needs a store to be able to do.
METHODS = {"vector": {"vector"}}


def with_ids(rows: DataFrame, style: str = "uuid", id_col: str = "id") -> DataFrame:
    """`rows` with an id: random, to be materialised before it is used twice, or "0", "1", ... in scan order."""
    if style == "uuid":
        return rows.withColumn(id_col, F.uuid())
    numbered = rows.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbered.groupBy(part.alias("_part")).count()  # one row per partition
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = numbered.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(id_col, (F.col("_before") + place).cast("string")).drop("_at", "_part", "_before")


class MemoryStore:
    """Rows cached in the session; fails on the operations named in `fail_on`, for tests of what depends on it."""

    def __init__(self, spark: SparkSession, fail_on: set[str] | None = None):
        self.spark, self.fail_on = spark, fail_on or set()
        self.rows = spark.createDataFrame([], schema.VECTOR)

    def _try(self, operation: str) -> None:
        if operation in self.fail_on:
            raise RuntimeError(f"{operation} failed")

    def read(self) -> DataFrame:
        self._try("read")
        return self.rows

    def _set(self, rows: DataFrame) -> None:
        new = rows.select(*schema.VECTOR.names).persist()
        new.count()
        self.rows.unpersist()
        self.rows = new

    def insert(self, new: DataFrame) -> None:
        self._try("insert")
        self._set(store.insert(self.rows, new, ["id"]))

    def upsert(self, new: DataFrame) -> None:
        self._try("upsert")
        self._set(store.upsert(self.rows, new, ["id"]))

    def update(self, new: DataFrame) -> None:
        self._try("update")
        self._set(store.update(self.rows, new, ["id"]))

    def delete(self, keys: DataFrame) -> None:
        self._try("delete")
        self._set(store.delete(self.rows, keys, ["id"]))

    def close(self) -> None:
        self.rows.unpersist()
        self.rows = self.spark.createDataFrame([], schema.VECTOR)


class JdbcStore:
    """A table of a SQL database. Changes are staged in a table of their own and applied in one transaction.

    Vectors travel as JSON text, which is also how pgvector reads and prints them; `vector_type` is
    their type in the table.
    """

    def __init__(self, spark: SparkSession, url: str, table: str, vector_type: str = "vector", text_type: str = "text", id_type: str = "varchar(256)", options: dict | None = None):
        self.spark, self.url, self.table, self.options = spark, url, table, options or {}
        self.types = {"id": f"{id_type} NOT NULL PRIMARY KEY", "embedding": vector_type, "content": text_type, "doc_metadata": text_type}
        self.staged = {"id": id_type, "embedding": text_type, "content": text_type, "doc_metadata": text_type}

    def run(self, *statements: str) -> None:
        """Run statements in one transaction."""
        jvm = self.spark._jvm
        if driver := self.options.get("driver"):
            jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(driver)
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, str(v))
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            connection.setAutoCommit(False)
            for sql in statements:
                connection.createStatement().execute(sql)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def create_sql(self) -> str:
        return f"CREATE TABLE {self.table} ({', '.join(f'{c} {t}' for c, t in self.types.items())})"

    def index_sql(self, metric: str = "cosine", replace: bool = False) -> list[str]:
        """Statements that make a pgvector index for a metric."""
        kind = {"cosine": "cosine", "l1": "l1", "l2": "l2", "max_inner_product": "ip"}[metric_of(metric)]
        name = f"{self.table}_{kind}_index"
        drop = [f"DROP INDEX IF EXISTS {name}"] if replace else []
        return [*drop, f"CREATE INDEX IF NOT EXISTS {name} ON {self.table} USING hnsw (embedding vector_{kind}_ops)"]

    def read(self) -> DataFrame:
        cast = "embedding" if self.types["embedding"] == self.staged["embedding"] else f"CAST(embedding AS {self.staged['embedding']}) AS embedding"
        query = f"(SELECT id, {cast}, content, doc_metadata FROM {self.table}) q"
        rows = self.spark.read.format("jdbc").options(url=self.url, dbtable=query, **self.options).load()
        rows = rows.toDF(*(c.lower() for c in rows.columns))
        return rows.select("id", F.from_json("embedding", "array<float>").alias("embedding"), "content", "doc_metadata")

    def _apply(self, new: DataFrame, columns: list[str], statements: Callable[[str], list[str]], all_there: bool = False) -> None:
        staging = f"{self.table}_{uuid.uuid4().hex[:12]}"
        rows = new.select(*(F.to_json(c).alias(c) if c == "embedding" else F.col(c) for c in columns))
        kinds = ", ".join(f"{c} {self.staged[c]}" for c in columns)
        self.run(f"CREATE TABLE {staging} ({kinds})")
        try:
            rows.write.format("jdbc").options(url=self.url, dbtable=staging, **self.options).mode("append").save()
            if all_there:  # asked of the database, which answers with a number
                missing = f"(SELECT count(*) AS n FROM {staging} s WHERE NOT EXISTS (SELECT 1 FROM {self.table} t WHERE t.id = s.id)) q"
                if self.spark.read.format("jdbc").options(url=self.url, dbtable=missing, **self.options).load().first()[0]:
                    raise KeyError("a row to update isn't there")
            self.run(*statements(staging))
        finally:
            self.run(f"DROP TABLE {staging}")

    def _insert_sql(self, staging: str) -> str:
        vector = "embedding" if self.types["embedding"] == self.staged["embedding"] else f"CAST(embedding AS {self.types['embedding']})"
        return f"INSERT INTO {self.table} (id, embedding, content, doc_metadata) SELECT id, {vector}, content, doc_metadata FROM {staging}"

    def insert(self, new: DataFrame) -> None:
        self._apply(new, schema.VECTOR.names, lambda s: [self._insert_sql(s)])

    def upsert(self, new: DataFrame, all_there: bool = False) -> None:
        self._apply(new, schema.VECTOR.names, lambda s: [f"DELETE FROM {self.table} WHERE id IN (SELECT id FROM {s})", self._insert_sql(s)], all_there)

    def update(self, new: DataFrame) -> None:
        """Like `upsert`, but every id must be there."""
        self.upsert(new, all_there=True)

    def delete(self, keys: DataFrame) -> None:
        self._apply(keys, ["id"], lambda s: [f"DELETE FROM {self.table} WHERE id IN (SELECT id FROM {s})"])

    def close(self) -> None:
        """Connections end with each operation."""


class VectorStore:
    """Documents with vectors in a backend, and searches over them.

    `prefilter` and `thresholds` say what a backend's searches do: filter before the cut at k or
    after it, and heed score thresholds or not. `add` inserts, or upserts if `overwrites`.
    """

    def __init__(self, backend, metric: str = "l2", prefilter: bool = False, thresholds: bool = False, overwrites: bool = False, ids: str = "uuid", get_score: float = 0.0, content_field: str | None = None, abilities: set[str] | None = None):
        self.backend, self.metric, self.prefilter, self.thresholds, self.overwrites = backend, metric, prefilter, thresholds, overwrites
        self.ids, self.get_score, self.content_field = ids, get_score, content_field
        self.abilities = {"vector"} if abilities is None else abilities

    def can(self, method: str) -> bool:
        """Whether the store is able to do all that a search method needs."""
        if method not in METHODS:
            raise ValueError(f"no search method {method!r}; known: {', '.join(METHODS)}")
        return METHODS[method] <= self.abilities

    def add(self, rows: DataFrame) -> None:
        """Rows of content, embedding, doc_metadata, and id if they have one."""
        rows = rows if "id" in rows.columns else with_ids(rows, self.ids)
        rows = rows.select(*schema.VECTOR.names).persist()
        try:
            (self.backend.upsert if self.overwrites else self.backend.insert)(rows)
        finally:
            rows.unpersist()

    def update(self, rows: DataFrame) -> None:
        self.backend.update(rows.select(*schema.VECTOR.names))

    def delete(self, ids: DataFrame) -> None:
        self.backend.delete(ids.select("id"))

    def _results(self, rows: DataFrame) -> DataFrame:
        document = content_of(F.col("doc_metadata"), F.col("content"), self.content_field) if self.content_field else F.col("content")
        return rows.select("id", document.alias("document"), F.col("doc_metadata").alias("metadata"), "score")

    def get(self, ids: DataFrame) -> DataFrame:
        return self._results(store.get(self.backend.read(), ids, ["id"]).withColumn("score", F.lit(self.get_score)))

    def all(self) -> DataFrame:
        return self._results(self.backend.read().withColumn("score", F.lit(0.0)))

    def query(self, vector, k: int = 5, where: Column | None = None, threshold: float | None = None) -> DataFrame:
        v = vector if isinstance(vector, Column) else search.vector_literal(vector)
        return self._results(search.search(self.backend.read(), v, k, self.metric, where, self.prefilter, threshold if self.thresholds else None))

    def search(self, asked: SearchQuery, method: str = "vector") -> DataFrame:
        if not self.can(method):
            raise ValueError(f"the store can't search by {method}")
        return self.query(asked.embedding, asked.top_k, threshold=asked.score_threshold)

    def close(self) -> None:
        if hasattr(self.backend, "close"):
            self.backend.close()


def _parquet(spark: SparkSession, c: StoreConfig) -> store.Table:
    return Table(spark, f"{c.location.rstrip('/')}/{c.table}", schema.VECTOR, ["id"])


@STORES.register("parquet")
def parquet_store(spark: SparkSession, c: StoreConfig) -> VectorStore:
    return VectorStore(_parquet(spark, c), c.metric, c.prefilter, content_field=c.content_field)


@STORES.register("chroma")
def cosine_store(spark: SparkSession, c: StoreConfig) -> VectorStore:
    """Like a local collection: cosine distance, thresholds, ids by number."""
    return VectorStore(_parquet(spark, c), "cosine", True, True, True, "ordinal", 1.0, c.content_field)


@STORES.register("postgres")
def postgres_store(spark: SparkSession, c: StoreConfig) -> VectorStore:
    return VectorStore(JdbcStore(spark, c.location, c.table, options=c.options), c.metric, True, True, True, "ordinal", content_field=c.content_field)


@STORES.register("testing")
def memory_store(spark: SparkSession, c: StoreConfig) -> VectorStore:
    return VectorStore(MemoryStore(spark, set(c.options.get("fail_on", ()))), "cosine", thresholds=True, overwrites=True, ids="ordinal", get_score=1.0)


_OPEN: dict[tuple, VectorStore] = {}


def open_store(spark: SparkSession, config: StoreConfig | None = None) -> VectorStore:
    """The store of a config; one for each provider, location and table of a session."""
    c = config or StoreConfig()
    key = (spark.sparkContext.applicationId, c.provider, c.location, c.table)
    if key not in _OPEN:
        _OPEN[key] = STORES.get(c.provider)(spark, c)
    return _OPEN[key]
