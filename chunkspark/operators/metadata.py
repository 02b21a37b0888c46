"""Vector tables with indexed metadata: equality filters before the cut read only files that may hold a match.

Chosen keys of the JSON in `doc_metadata` are written as columns of their own beside it, whole numbers as such, with
Parquet's bloom filters. The log says of each segment which values its rows have of a key, if these are LISTED or fewer,
and otherwise the least and largest. A filter opens only segments that may match, pushes itself to their scans, and
drops replaced and deleted rows by the keys of all segments.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkspark import schema
from chunkspark.operators import search
from chunkspark.operators.segments import LevelOf, Segments, Table

#: Values of a key that the log lists for a segment, and their characters at most; with more it has their ends alone.
LISTED, LISTED_CHARS = 1000, 200
KINDS = {"long": T.LongType(), "string": T.StringType()}
Values = str | int | bool | list


def _column(key: str) -> str:
    return f"meta_{key}"


def _text(key: str) -> Column:
    """A key's value as text, null where it is missing or null."""
    return F.get_json_object("doc_metadata", f"$.{key}")


def _as_text(value: str | int | bool) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def _whole(text: Column) -> Column:
    """Text as a whole number where it is written as Spark would write that number, else null."""
    n = text.try_cast("long")
    return F.when(n.cast("string") == text, n)


def frequent_keys(rows: DataFrame, most: int = 16, share: float = 0.05) -> dict[str, str]:
    """Keys that at least `share` of the rows have, `most` at most, the more frequent first, with the kind that all their values are of.

    Keys that aren't names (letters, digits, underscores) are left to the JSON.
    """
    keyed = rows.select("doc_metadata", F.explode(F.array_distinct(F.json_object_keys("doc_metadata"))).alias("key")).filter(F.col("key").rlike(r"^[A-Za-z_]\w*$"))
    value = F.expr("get_json_object(doc_metadata, concat('$.', key))")
    counts = keyed.select("key", value.alias("value")).filter("value is not null").groupBy("key").agg(F.count("*").alias("n"), F.count(_whole(F.col("value"))).alias("whole"))
    top = counts.filter(F.col("n") >= share * rows.count()).orderBy(F.desc("n"), "key").limit(most)
    seen: dict[str, str] = {}
    for r in top.collect():  # `most` rows
        if r["key"].lower() not in map(str.lower, seen):  # columns that differ by case alone would clash
            seen[r["key"]] = "long" if r["n"] == r["whole"] else "string"
    return seen


class _Indexed(Segments):
    """Segments whose rows have columns of the keys in `kinds`, and whose entries say what values are in them."""

    def __init__(self, versions, kinds: dict[str, str]):
        shape = T.StructType([*schema.VECTOR.fields, *(T.StructField(_column(k), KINDS[v]) for k, v in kinds.items())])
        super().__init__(versions, {"rows": LevelOf(shape, ("id",))}, ("id",))
        self.kinds = kinds
        self.options = {f"parquet.bloom.filter.enabled#{_column(k)}": "true" for k in kinds}

    def stage(self, new, gone=None) -> dict:
        made = {}
        for level, rows in new.items():
            cells = {_column(k): _whole(_text(k)) if v == "long" else _text(k) for k, v in self.kinds.items()}
            made[level] = rows.select(*schema.VECTOR.names).withColumns(cells) if cells else rows.select(*schema.VECTOR.names)
        segment = super().stage(made, gone)
        if "rows" in segment["levels"]:
            segment["index"] = self._index(self.spark.read.schema(self.levels["rows"].schema).parquet(f"{self.path}/{segment['name']}/rows"))
        return segment

    def _index(self, rows: DataFrame) -> dict[str, dict]:
        """What a segment's rows have of each key: kind, listed values or None, ends, and whether texts stayed out of a column of numbers."""
        figures = []
        for k, kind in self.kinds.items():
            c = F.col(_column(k))
            odd = F.count(F.when(c.isNull() & _text(k).isNotNull(), 1)) > 0 if kind == "long" else F.lit(False)
            figures += [F.struct(F.min(c), F.max(c), F.coalesce(F.max(F.length(c.cast("string"))), F.lit(0)), odd).alias(_column(k))]
        ends = rows.agg(*figures).first() if figures else ()
        out = {}
        for (k, kind), (low, high, longest, odd) in zip(self.kinds.items(), ends, strict=True):
            short = longest <= LISTED_CHARS
            few = [r[0] for r in rows.select(_column(k)).filter(F.col(_column(k)).isNotNull()).distinct().limit(LISTED + 1).collect()] if short else []
            listed = sorted(few) if short and len(few) <= LISTED else None
            out[k] = {"kind": kind, "values": listed, "low": low if short else None, "high": high if short else None, "odd": odd}
        return out

    def pick(self, segment: dict, equal: dict[str, list[str]]) -> Column | None:
        """The condition on a segment's rows, None if its entry rules all of them out."""
        condition = F.lit(True)
        for key, texts in equal.items():
            about = segment["index"].get(key)
            if about is None or about["odd"]:
                condition &= _text(key).isin(texts) if re.fullmatch(r"[A-Za-z_]\w*", key) else F.get_json_object("doc_metadata", f"$['{key}']").isin(texts)
                continue
            values = texts if about["kind"] == "string" else [int(t) for t in texts if re.fullmatch(r"0|-?[1-9]\d{0,18}", t) and -(1 << 63) <= int(t) < 1 << 63]
            if about["values"] is not None:
                there = set(about["values"])
                values = [v for v in values if v in there]
            elif about["low"] is not None and about["kind"] == "long":  # texts compare by bytes in Spark: their bloom filters serve
                values = [v for v in values if about["low"] <= v <= about["high"]]
            if not values:
                return None
            condition &= F.col(_column(key)).isin(values)
        return condition


class MetadataTable(Table):
    """A table of vectors (see `schema.VECTOR`) with `shred`, keys of doc_metadata and their kinds, as columns.

    The keys are fixed by the first commit; a table that is there keeps its own. A filter on another key reads the JSON
    of all rows. Values are equal where their texts in the JSON are: 7 and "7" alike, true, and "007" not 7. Rows without
    the key match nothing.
    """

    def __init__(self, spark: SparkSession, path: str, shred: dict[str, str] | None = None):
        super().__init__(spark, path, schema.VECTOR, ["id"])
        for key, kind in (shred or {}).items():
            if kind not in KINDS or not re.fullmatch(r"[A-Za-z_]\w*", key):
                raise ValueError(f"can't keep {key!r} as a column of {kind!r}")
        there = next((s["index"] for s in self.segments.last()[1] if "index" in s), None)
        kinds = shred or {} if there is None else {k: v["kind"] for k, v in there.items()}
        self.segments = _Indexed(self.versions, dict(kinds))

    def read(self) -> DataFrame:
        return super().read().select(*schema.VECTOR.names)

    def where(self, equal: dict[str, Values]) -> DataFrame:
        """Live rows of which every key in `equal` has the value given, or one of a list of them."""
        texts = {k: [_as_text(x) for x in (v if isinstance(v, list) else [v])] for k, v in equal.items()}
        if any("'" in k for k in texts):
            raise ValueError("a key to filter by can't have a quotation mark")
        now = self.segments.last()[1]
        return self.segments.read("rows", now, lambda s: self.segments.pick(s, texts)).select(*schema.VECTOR.names)

    def search(self, query: Column | Iterable[float], k: int = 10, metric: str = "l2", equal: dict[str, Values] | None = None) -> DataFrame:
        """The k nearest of the rows that match, with dist and score."""
        vector = query if isinstance(query, Column) else search.vector_literal(query)
        return search.nearest(self.where(equal) if equal else self.read(), vector, k, metric)
