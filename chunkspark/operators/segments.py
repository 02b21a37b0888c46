"""Tables of append-only segments: a change writes what it changes and not the table.

A segment holds the rows that a change brings and the keys that it takes back, deleted or replaced.
Entries of a log list the segments of a state in order; a row is live if no later segment takes
its key back. Several levels (assets, chunks, vectors) share a segment and a commit. Segments of
like size are merged now and then, the newest first, so that a row is rewritten about as often as the
logarithm of the table's size says, and a small change never rewrites the large ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkspark.operators.store import Conflict, Versions

#: Segments that are merged at once, at least.
FEWEST = 4
#: Folders that no entry of the last two names stay for so long: others may be about to commit theirs.
GRACE_MS = 24 * 3600 * 1000


@dataclass(frozen=True)
class LevelOf:
    """A level's schema, and its columns that the keys taken back are compared with, in their order."""

    schema: T.StructType
    on: tuple[str, ...]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Segments:
    """`keys` names the columns of keys taken back; each level says which of its own they are."""

    def __init__(self, versions: Versions, levels: dict[str, LevelOf], keys: tuple[str, ...]):
        self.versions, self.levels, self.keys = versions, levels, keys
        self.spark, self.path = versions.spark, versions.path
        self.options: dict[str, str] = {}  # of the files of rows

    def last(self) -> tuple[int, list[dict]]:
        """(number, segments) of the last entry."""
        number, entry = self.versions.last()
        return number, entry.get("segments", [])

    def key_schema(self) -> T.StructType:
        name, level = next(iter(self.levels.items()))
        return T.StructType([T.StructField(k, level.schema[c].dataType) for k, c in zip(self.keys, level.on, strict=True)])

    def stage(self, new: dict[str, DataFrame], gone: DataFrame | Callable[[DataFrame], DataFrame] | None = None) -> dict:
        """Write a segment, which counts once an entry lists it. Files are as many as the rows' bytes ask for.

        `gone` has the keys taken back, or makes them from the first level's rows as written.
        """
        name = f"s-{uuid.uuid4().hex}"
        for level, rows in new.items():
            columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.levels[level].schema.fields]
            rows.select(*columns).hint("rebalance").write.options(**self.options).parquet(f"{self.path}/{name}/{level}")
        if callable(gone):
            level = next(iter(new))
            gone = gone(self.spark.read.schema(self.levels[level].schema).parquet(f"{self.path}/{name}/{level}"))
        if gone is not None:
            gone.select(*self.keys).distinct().write.parquet(f"{self.path}/{name}/gone")
        system, where = self.versions._at(name)
        return {"name": name, "levels": list(new), "gone": gone is not None, "bytes": system.getContentSummary(where).getLength()}

    def drop(self, segment: dict) -> None:
        self.versions.remove(segment["name"])

    def commit(self, after: int, segments: list[dict], added: dict | None) -> int:
        """Add the entry after number `after`: the segments of the new state, and the one that holds what changed, if any."""
        number = self.versions.commit(after, {"segments": segments, "added": added})
        self._sweep()
        return number

    def append(self, segment: dict, tries: int) -> None:
        """Commit a segment that stands for itself whatever the state is; another commit in between comes first."""
        for left in reversed(range(tries)):
            number, segments = self.last()
            try:
                self.commit(number, [*segments, segment], segment)
                break
            except Conflict:
                if not left:
                    self.drop(segment)
                    raise
        self.compact()

    def read_gone(self, segment: dict) -> DataFrame:
        return self.spark.read.schema(self.key_schema()).parquet(f"{self.path}/{segment['name']}/gone")

    def read(self, level: str, segments: list[dict], pick: Callable[[dict], Column | None] | None = None) -> DataFrame:
        """Live rows of a level. Without keys taken back this is a plain scan, else an anti join with those keys alone.

        `pick` gives the condition on a segment's rows, or None if none of them is wanted; its files aren't opened then.
        """
        own = self.levels[level]
        wanted = [(i, s, F.lit(True) if pick is None else pick(s)) for i, s in enumerate(segments) if level in s["levels"]]
        parts = [self.spark.read.schema(own.schema).parquet(f"{self.path}/{s['name']}/{level}").filter(c).withColumn("_segment", F.lit(i)) for i, s, c in wanted if c is not None]
        if not parts:
            return self.spark.createDataFrame([], own.schema)
        rows = _union(parts)
        gone = [self.read_gone(s).withColumn("_gone", F.lit(i)) for i, s in enumerate(segments) if s["gone"] and i]
        if gone:
            back = _union(gone).groupBy(*self.keys).agg(F.max("_gone").alias("_gone")).select(*(F.col(k).alias(f"_key{j}") for j, k in enumerate(self.keys)), "_gone")
            same = [F.col(c) == F.col(f"_key{j}") for j, c in enumerate(own.on)]
            rows = rows.join(back, [*same, F.col("_segment") < F.col("_gone")], "left_anti")
        return rows.select(*own.schema.names)

    def _due(self, segments: list[dict]) -> int:
        """Place of the first segment to merge: those after it together are no smaller than each before them."""
        at, size = len(segments), 0
        while at and segments[at - 1]["bytes"] <= max(size, 2 * segments[-1]["bytes"]):
            at -= 1
            size += segments[at]["bytes"]
        return at if len(segments) - at >= FEWEST else len(segments)

    def compact(self) -> bool:
        """Merge the newest segments of like size, if they are enough. Commits of others in between stay after them."""
        number, segments = self.last()
        at = self._due(segments)
        if at == len(segments):
            return False
        old = segments[at:]
        new = {level: self.read(level, old) for level in self.levels if any(level in s["levels"] for s in old)}
        gone = [self.read_gone(s) for s in old if s["gone"]] if at else []
        merged = self.stage(new, _union(gone) if gone else None)
        for _ in range(5):
            try:
                self.commit(number, [*segments[:at], merged, *segments[at + len(old) :]], None)
                return True
            except Conflict:
                number, segments = self.last()
                if segments[at : at + len(old)] != old:  # rewritten by another
                    break
        self.drop(merged)
        return False

    def _sweep(self) -> None:
        """Delete old folders that no entry of the last two names."""
        live = {s["name"] for entry in self.versions.newest(2) for s in entry.get("segments", [])}
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        for name in self.versions.names():
            if name.startswith("s-") and name not in live:
                system, where = self.versions._at(name)
                if now - system.getFileStatus(where).getModificationTime() > GRACE_MS:
                    self.versions.remove(name)

    def sweep(self) -> None:
        """Delete folders that the current state doesn't name. For times without readers or writers."""
        live = {s["name"] for s in self.last()[1]}
        for name in self.versions.names():
            if name.startswith("s-") and name not in live:
                self.versions.remove(name)

    def changes(self, entries: Iterable[tuple[int, dict]]) -> DataFrame:
        """Keys that the given log entries changed: the keys, change (upsert or delete), and commit, the entry's number.

        A key taken back and brought again by one entry is an upsert. Merges of segments change nothing.
        """
        parts = []
        name, level = next(iter(self.levels.items()))
        for number, entry in entries:
            if not (s := entry.get("added")):
                continue
            keys = self.spark.createDataFrame([], self.key_schema())
            if name in s["levels"]:
                keys = self.spark.read.schema(level.schema).parquet(f"{self.path}/{s['name']}/{name}").select(*(F.col(c).alias(k) for k, c in zip(self.keys, level.on, strict=True))).distinct()
            gone = self.read_gone(s).join(keys, list(self.keys), "left_anti") if s["gone"] else None
            both = keys.withColumn("change", F.lit("upsert"))
            both = both if gone is None else both.unionByName(gone.withColumn("change", F.lit("delete")))
            parts.append(both.withColumn("commit", F.lit(number).cast("long")))
        empty = T.StructType([*self.key_schema().fields, T.StructField("change", T.StringType()), T.StructField("commit", T.LongType())])
        return _union(parts) if parts else self.spark.createDataFrame([], empty)


class Table:
    """A table with a key, of segments, at a path of any Hadoop file system with an atomic rename."""

    #: How often a change starts over when another commit comes first.
    TRIES = 5

    def __init__(self, spark, path: str, schema: T.StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, list(keys)
        self.versions = Versions(spark, self.path)
        self.segments = Segments(self.versions, {"rows": LevelOf(schema, tuple(keys))}, tuple(keys))

    def read(self) -> DataFrame:
        """The current state, empty before the first commit."""
        return self.segments.read("rows", self.segments.last()[1])

    def change(self, make: Callable[[DataFrame], DataFrame]) -> None:
        """Commit what `make` derives from the current state, as one segment; starts over if another commit comes first."""
        for left in reversed(range(self.TRIES)):
            number, segments = self.segments.last()
            now = self.segments.read("rows", segments)
            staged = self.segments.stage({"rows": make(now)}, lambda new: now.select(*self.keys).join(new, self.keys, "left_anti"))
            try:
                self.segments.commit(number, [staged], staged)
                return
            except Conflict:
                self.segments.drop(staged)
                if not left:
                    raise

    def replace(self, df: DataFrame) -> None:
        """Commit a new state whatever the current one is."""
        self.change(lambda _: df)

    def upsert(self, new: DataFrame) -> None:
        """Rows of `new` and those of the table whose key it lacks. Writes `new` and its keys."""
        self.segments.append(self.segments.stage({"rows": new}, lambda rows: rows), self.TRIES)

    def delete(self, keys: DataFrame) -> None:
        """Missing keys and no keys at all change nothing. Writes the keys."""
        self.segments.append(self.segments.stage({}, keys), self.TRIES)

    def insert(self, new: DataFrame) -> None:
        """A key that is there already is an error. Writes `new`."""
        self._checked(new, lambda now: now.select(*self.keys).join(new.select(*self.keys), self.keys, "left_semi"), "a key is there already", False)

    def update(self, new: DataFrame) -> None:
        """Like `upsert`, but every key must be there."""
        self._checked(new, lambda now: new.select(*self.keys).join(now.select(*self.keys), self.keys, "left_anti"), "a row to update isn't there", True)

    def _checked(self, new: DataFrame, wrong: Callable[[DataFrame], DataFrame], says: str, replaces: bool) -> None:
        """Append `new` unless the state that it follows has wrong keys; checked anew when another commit comes first."""
        staged = None
        for left in reversed(range(self.TRIES)):
            number, segments = self.segments.last()
            if wrong(self.segments.read("rows", segments)).take(1):
                if staged:
                    self.segments.drop(staged)
                raise KeyError(says)
            staged = staged or self.segments.stage({"rows": new}, (lambda rows: rows) if replaces else None)
            try:
                self.segments.commit(number, [*segments, staged], staged)
                break
            except Conflict:
                if not left:
                    self.segments.drop(staged)
                    raise
        self.segments.compact()

    def get(self, keys: DataFrame) -> DataFrame:
        """Rows by key, with score 0."""
        return self.read().join(keys.select(*self.keys).distinct(), self.keys, "left_semi").withColumn("score", F.lit(0.0))

    def changes(self, after: int = 0) -> DataFrame:
        """Keys changed since entry number `after`, see `Segments.changes`."""
        return self.segments.changes(self.versions.entries(after))

