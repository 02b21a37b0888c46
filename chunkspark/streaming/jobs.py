"""Streams that keep an index or a sink up to date."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chunkspark.operators.chat import progress
from chunkspark.operators.segments import Segments


def watch_files(spark: SparkSession, root: str, handle: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 200, suffixes: str = "*") -> StreamingQuery:
    """Hand new files below `root` to `handle` in batches, each once; ends when none is left.

    Changed and deleted files are for `Index.sync`: a file source sees each path once.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).load(root)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, table, checkpoint: str, order: str | None = None) -> StreamingQuery:
    """Keep a `segments.Table` at the last row of each key; a batch is one commit.

    The last row is that with the largest `order`. Without an order column a batch must have one row
    for each key; two are an error, as which one is the last can't be told. Rows of a later batch
    come after all of an earlier one.
    """

    def commit(batch: DataFrame, epoch: int) -> None:
        rows = batch
        if order is not None:
            rows = batch.groupBy(*table.keys).agg(F.max_by(F.struct(*batch.columns), order).alias("_last"))
            rows = rows.select(*(F.col("_last")[c].alias(c) for c in batch.columns))
        elif batch.groupBy(*table.keys).count().filter("count > 1").take(1):
            raise ValueError("several rows of a key in a batch need an order column")
        table.upsert(rows)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def change_stream(segments: Segments, handle: Callable[[DataFrame, int], None], checkpoint: str, commits_per_batch: int = 200) -> StreamingQuery:
    """Hand the keys that commits of a table or a domain changed to `handle`, each commit once, in batches of commits.

    Rows are those of `Segments.changes`. The log's entries are the stream's source: each is a file
    that is written once, so the checkpoint knows which ones were handed over, and a restart goes on
    after them. Ends when none is left.
    """
    spark = segments.spark
    log = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", commits_per_batch).load(f"{segments.path}/log")
    entries = log.select(F.element_at(F.split(F.input_file_name(), "/"), -1).cast("long").alias("number"), "value")

    def deliver(batch: DataFrame, epoch: int) -> None:
        found = sorted((r["number"], json.loads(r["value"])) for r in batch.toLocalIterator())  # a line for each commit
        handle(segments.changes(found), epoch)

    return entries.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_stream(requests: DataFrame, key: str = "qid") -> DataFrame:
    """Status rows of a stream of requests."""
    return progress(requests, key)


def track(stream: DataFrame, enabled: bool, folder: str, checkpoint: str, ip: str = "ip") -> StreamingQuery | None:
    """Append events with hashed user ids to Parquet; nothing runs unless enabled."""
    if not enabled:
        return None
    rows = stream.withColumn("user_hash", F.sha2(F.col(ip), 256)).drop(ip)
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_text(row: dict) -> str:
    """A server-sent event."""
    return f"event: {row.get('status', 'message').lower()}\ndata: {json.dumps(row, default=str, ensure_ascii=False)}\n\n"


def send_events(stream: DataFrame, send: Callable[[str], None], checkpoint: str, order: list[str] | None = None) -> StreamingQuery:
    """Hand each row of a stream to `send` as a server-sent event, in order within a micro-batch; rows pass the driver one by one."""

    def deliver(batch: DataFrame, epoch: int) -> None:
        for row in batch.orderBy(*(order or ["qid", "step"])).toLocalIterator():
            send(event_text(row.asDict(recursive=True)))

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
