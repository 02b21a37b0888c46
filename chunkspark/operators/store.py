"""Changes of keyed rows, and the log that makes them visible.

Plain Parquet has no MERGE. A change writes new files beside the old ones (see `segments`) and then
adds an entry to a log of versions. Entries are numbered and written once, so readers see one state
or the other, and of two writers that began from one state the second fails and starts over.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new`, and those of `current` whose key it lacks."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*current.columns))


def insert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both; a key in both is an error."""
    if _any(current.join(new.select(*keys), keys, "left_semi")):
        raise KeyError("a key is there already")
    return current.unionByName(new.select(*current.columns))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below `spark.checkpoint.dir`, which driver and executors share; a temporary one in a session of one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='chunkspark-')}"
    return f"{root.rstrip('/')}/chunkspark-core/{name}-{uuid.uuid4().hex}"


def _any(df: DataFrame) -> bool:
    return bool(df.take(1))


def delete(current: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't among `keys`; missing keys and no keys at all change nothing."""
    return current.join(keys.select(*on).distinct(), on, "left_anti")


def get(current: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows by key, with score 0."""
    return current.join(keys.select(*on).distinct(), on, "left_semi").withColumn("score", F.lit(0.0))


def update(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Like `upsert`, but every key must be there."""
    if _any(new.join(current, keys, "left_anti")):
        raise KeyError("a row to update isn't there")
    return upsert(current, new, keys)


def cascade_delete(domains: DataFrame, assets: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three levels without the domains in `gone` (id) and all that belongs to them."""
    ids = gone.select(F.col("id").alias("domain_id")).distinct()
    return domains.join(gone.select("id").distinct(), "id", "left_anti"), assets.join(ids, "domain_id", "left_anti"), chunks.join(ids, "domain_id", "left_anti")


class Conflict(RuntimeError):
    """Another commit came first."""


class Versions:
    """A log in a folder of any Hadoop file system with an atomic rename: entry n says what state n is made of."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def names(self, folder: str = "") -> list[str]:
        system, where = self._at(folder) if folder else self._at(".")
        return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []

    def exists(self, name: str) -> bool:
        system, where = self._at(name)
        return system.exists(where)

    def _entry(self, name: str) -> dict:
        system, where = self._at(f"log/{name}")
        stream = system.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _numbers(self) -> list[str]:
        return [n for n in self.names("log") if n.isdigit()]

    def last(self) -> tuple[int, dict]:
        """(number, content) of the last entry; (0, {}) before the first."""
        numbers = self._numbers()
        return (int(numbers[-1]), self._entry(numbers[-1])) if numbers else (0, {})

    def newest(self, n: int) -> list[dict]:
        """Contents of the last `n` entries."""
        return [self._entry(x) for x in self._numbers()[-n:]]

    def entries(self, after: int = 0) -> list[tuple[int, dict]]:
        """(number, content) of the entries that follow number `after`."""
        return [(int(x), self._entry(x)) for x in self._numbers() if int(x) > after]

    def commit(self, after: int, content: dict) -> int:
        """Add the entry that follows number `after`; Conflict if there is one already."""
        jvm = self.spark._jvm
        system, staged = self._at(f"staged-{uuid.uuid4().hex}")
        out = system.create(staged)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        _, entry = self._at(f"log/{after + 1:020d}")
        system.mkdirs(entry.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(entry.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(staged, entry, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            system.delete(staged, False)
            if "FileAlreadyExists" in str(e.java_exception.getClass()):
                raise Conflict(f"{self.path}: version {after + 1} is there already") from e
            raise
        return after + 1

    def remove(self, name: str) -> None:
        system, where = self._at(name)
        system.delete(where, True)
