"""The shared folder, materialised tables and joins that stand hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
_LOCAL: dict[str, str] = {}
#: Spark's setting that removes the shuffle files of a query as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of the innermost `scratch` of this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: `spark.checkpoint.dir`.

    Only a single-process session without that setting (tests) gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="chunkspark-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends or by `release`."""
    path = f"{shared_root(spark)}/chunkspark/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    if (scope := _SCOPE.get()) is not None:
        scope.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write go as it ends: nothing else reads them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scratch(spark: SparkSession):
    """Delete the tables written within, but for those that go through the function it gives.

    That function materialises a frame, so what it returns reads none of the deleted ones.
    """
    own: list[str] = []
    outer = _SCOPE.get()
    token = _SCOPE.set(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        kept = own.pop()
        if outer is not None:
            outer.append(kept)
        return out

    try:
        yield keep
    finally:
        _SCOPE.reset(token)
        for path in own:
            delete_folder(spark, path)
            _WRITTEN.remove((spark, path))


@atexit.register
def release() -> None:
    """Delete every table written to the shared folder. Frames that read them end with it."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            if spark._jsc.sc().isStopped():
                continue
            delete_folder(spark, path)
        except Exception:  # the JVM may be gone at exit  # noqa: BLE001
            return


def spread(few: DataFrame, *by: str, most: int = 50_000) -> DataFrame:
    """`few`, a written table whose rows each stand for much work, with a task for each row, or `most` tasks.

    Spark sizes the partitions of a shuffle without a number by bytes, and would give such rows to one task.
    """
    return few.repartitionByRange(max(1, min(few.count(), most)), *by)


def slices(batches, rows: int = 256):
    """Arrow batches cut to a few rows each, for work that copies what it reads."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Copies of a hot key's values where they are too wide to broadcast.
SALTS = 64


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, spread: Column, ways: int = 512, wide: bool = False) -> DataFrame:
    """Left join to a table that is unique in `keys`, whatever the skew of the left side.

    `rows` of `right` counts the left rows of its key and `total` all of them; `right` must have
    every key of many left rows, be it without values. Keys with over
    `total / ways` rows are fewer than `ways`, so they are broadcast; their left rows leave the
    key's partition by `spread`, and the others meet by an ordinary shuffle. Values of no bound
    (`wide`) are not broadcast: hot keys have them in SALTS copies, each for a share of the rows.
    """
    bar = max(total // ways, 1)
    hot_col, cold_col, salt = (fresh(left, c) for c in ("_hot", "_cold", "_salt"))
    # the salt of cold keys is 0, but not a literal: the optimizer would take that out of the join's keys
    values = [c for c in right.columns if c not in keys]
    hot = right.filter(F.col(rows) > bar).select(*keys, (F.lit(1) if wide else F.struct(*values)).alias(hot_col))
    copies = F.sequence(F.lit(1), F.lit(SALTS)) if wide else F.array().cast("array<int>")
    own_salt = F.explode(F.when(F.col(rows) > bar, copies).otherwise(F.array(F.lit(0)))) if wide else (F.col(rows) > bar).cast("int")
    cold = (right if wide else right.filter(F.col(rows) <= bar)).select(*keys, F.struct(*values).alias(cold_col), own_salt.alias(salt))
    marked = left.join(F.broadcast(hot), keys, "left")
    marked = marked.withColumn(salt, F.when(F.col(hot_col).isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(SALTS if wide else 4096)).cast("int")))
    joined = marked.join(cold, [*keys, salt], "left")
    found = F.col(cold_col) if wide else F.coalesce(hot_col, cold_col)
    return joined.select(*left.columns, *[found[c].alias(c) for c in values])


#: Bytes of a build side that a task holds for a hash join, and of a row in it.
BUILD_BYTES, BUILD_ROW = 32 << 20, 200


def hashed_side(right: DataFrame, rows: int) -> DataFrame:
    """`right`, unique in the join's keys, with a hint to build hash tables of it if its share of a task is small.

    Few rows get no hint: a shuffled hash join would shuffle the other side, which Spark spares by a
    broadcast below its own threshold.
    """
    threshold = int(right.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    if rows * BUILD_ROW <= threshold:
        return right
    tasks = int(right.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return right.hint("shuffle_hash") if rows * BUILD_ROW <= BUILD_BYTES * tasks else right
