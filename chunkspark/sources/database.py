"""Tables of a SQL database as a Spark data source, over any driver that follows Python's database interface (PEP 249).

    spark.dataSource.register(DatabaseSource)
    spark.read.format("database").options(module="sqlite3", connect='{"database": "/shared/x.db"}', table="items", key="id", partitions=32)

Options: `module` is the driver's module and `connect` its connect() arguments as JSON; `table`; `schema` or the
reader's own schema; `key`, a whole-number column that partitions cut into ranges of equal width, or `cuts`, a JSON
list of key values where ranges begin. Executors open connections of their own, so the database must be reachable from
all of them. Filters that the database can answer alike are part of each range's statement; Spark tests the others. Only
wanted columns travel when `columns` names them. A write goes to a staging table for each attempt of a task;
the driver then moves the rows of the attempts that count in one transaction. An aborted write drops them.
"""

from __future__ import annotations

import importlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import datasource as D
from pyspark.sql import types as T

#: Rows that travel at a time.
FETCH = 2000
#: Types of staging columns.
TYPES = {"byte": "smallint", "short": "smallint", "integer": "integer", "long": "bigint", "float": "real", "double": "double precision", "string": "text", "boolean": "boolean"}
#: Markers of parameters for each style of a driver's.
MARKERS = {"qmark": "?", "format": "%s", "pyformat": "%s"}


def _name(text: str) -> str:
    """A table's or column's name, dotted or not; others don't become part of a statement."""
    if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*", text):
        raise ValueError(f"not a name of a table or column: {text!r}")
    return text


@dataclass(frozen=True)
class Database:
    """How to reach a database, and its markers of parameters."""

    module: str
    arguments: str

    @classmethod
    def of(cls, options) -> Database:
        for option in ("module", "connect", "table"):
            if option not in options:
                raise ValueError(f"the database source needs the option {option!r}")
        _name(options["table"])
        return cls(options["module"], options["connect"])

    def connect(self):
        return importlib.import_module(self.module).connect(**json.loads(self.arguments))

    @property
    def marker(self) -> str:
        style = importlib.import_module(self.module).paramstyle
        if style not in MARKERS:
            raise ValueError(f"drivers with parameters of style {style!r} aren't supported")
        return MARKERS[style]

    def run(self, *statements: str) -> None:
        """Run statements in one transaction."""
        connection = self.connect()
        try:
            cursor = connection.cursor()
            for sql in statements:
                cursor.execute(sql)
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def rows(self, sql: str, values: list) -> Iterator[list[tuple]]:
        connection = self.connect()
        try:
            cursor = connection.cursor()
            cursor.execute(sql, values)
            while got := cursor.fetchmany(FETCH):
                yield got
        finally:
            connection.close()


@dataclass
class KeyRange(D.InputPartition):
    """Rows with low <= key < high; a null key belongs to the first range."""

    low: int | None
    high: int | None

    def __init__(self, low, high):
        self.low, self.high = low, high


def _condition(f: D.Filter, names: dict[str, T.DataType], marker: str) -> tuple[str, list] | None:
    """A filter as SQL and its values, where the database surely answers as Spark does."""
    attribute = getattr(f, "attribute", None)
    if isinstance(f, D.Not):
        child = f.child  # of these alone: what is null is false here as there
        inner = _condition(child, names, marker) if isinstance(child, (D.EqualTo, D.In, D.IsNull)) else None
        return inner and (f"NOT ({inner[0]})", inner[1])
    if attribute is None or len(attribute) != 1 or attribute[0] not in names:
        return None
    column, kind = _name(attribute[0]), names[attribute[0]]
    if isinstance(f, D.IsNull):
        return f"{column} IS NULL", []
    if isinstance(f, D.IsNotNull):
        return f"{column} IS NOT NULL", []
    values = list(f.value) if isinstance(f, D.In) else [getattr(f, "value", None)]
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if not values or not all(isinstance(v, int) and not isinstance(v, bool) if whole else isinstance(v, str) and isinstance(kind, T.StringType) for v in values):
        return None
    if isinstance(f, D.In):
        return f"{column} IN ({', '.join([marker] * len(values))})", values
    sign = {D.EqualTo: "="} | ({D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="} if whole else {})  # order of texts is the database's own
    return (f"{column} {sign[type(f)]} {marker}", values) if type(f) in sign else None


class DatabaseReader(D.DataSourceReader):
    """Reads ranges of the key, each by a statement with the pushed filters."""

    def __init__(self, schema: T.StructType, options):
        self.database, self.schema = Database.of(options), schema
        self.table, self.key = options["table"], options.get("key")
        self.n, self.given = int(options.get("partitions", 8)), json.loads(options["cuts"]) if "cuts" in options else None
        if self.n < 1:
            raise ValueError("partitions must be 1 or more")
        if self.key:
            _name(self.key)
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        names, marker = {f.name: f.dataType for f in self.schema.fields}, self.database.marker
        for f in filters:
            found = _condition(f, names, marker)
            if found is None:
                yield f
            else:
                self.where.append(found[0])
                self.values += found[1]

    def _sql(self, columns: str, where: list[str]) -> str:
        return f"SELECT {columns} FROM {self.table}" + (f" WHERE {' AND '.join(where)}" if where else "")

    def partitions(self) -> list[KeyRange]:
        if not self.key:
            return [KeyRange(None, None)]
        cuts = self.given
        if cuts is None:
            (ends,) = next(self.database.rows(self._sql(f"min({self.key}), max({self.key})", self.where), self.values))
            low, high = ends
            if low is None:
                return [KeyRange(None, None)]
            n = min(self.n, high - low + 1)
            cuts = [low + (high - low + 1) * i // n for i in range(1, n)]
        cuts = sorted(set(cuts))
        return [KeyRange(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        where, values, mark = list(self.where), list(self.values), self.database.marker
        if partition.low is not None:
            where.append(f"{self.key} >= {mark}")
            values.append(partition.low)
        if partition.high is not None:
            where.append(f"{self.key} < {mark}" if partition.low is not None else f"({self.key} < {mark} OR {self.key} IS NULL)")
            values.append(partition.high)
        to = to_arrow_schema(self.schema)
        columns = ", ".join(_name(f.name) for f in self.schema.fields)
        for rows in self.database.rows(self._sql(columns, where), values):
            arrays = [pa.array([None if v is None else bool(v) for v in c] if pa.types.is_boolean(t) else c, t) for c, t in zip(zip(*rows, strict=True), to.types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=to)


@dataclass
class Staged(D.WriterCommitMessage):
    table: str
    rows: int


class DatabaseWriter(D.DataSourceWriter):
    """Stages each attempt's rows by itself; a commit moves those that count, in one transaction."""

    def __init__(self, schema: T.StructType, options, overwrite: bool):
        self.database, self.schema, self.overwrite = Database.of(options), schema, overwrite
        self.table, self.job = options["table"], uuid.uuid4().hex[:12]
        self.upsert_on = [_name(c) for c in options["upsert"].split(",")] if "upsert" in options else []
        for f in schema.fields:
            _name(f.name)
            if f.dataType.typeName() not in TYPES:
                raise ValueError(f"column {f.name} of type {f.dataType.simpleString()} can't be written; cast it to text or a number")
        self.columns = ", ".join(f.name for f in schema.fields)
        self.kinds = ", ".join(f"{f.name} {TYPES[f.dataType.typeName()]}" for f in schema.fields)
        self.database.run(f"CREATE TABLE {self._log()} (name varchar(200))")

    def _log(self) -> str:
        """A table of the staging tables that a write has made."""
        return f"{self.table}_{self.job}_log"

    def write(self, iterator: Iterator) -> Staged:
        staging = f"{self.table}_{self.job}_{uuid.uuid4().hex[:12]}"
        marker = self.database.marker
        # the log comes first, so that no staging table is unknown to the end of the write
        self.database.run(f"INSERT INTO {self._log()} VALUES ('{staging}')", f"CREATE TABLE {staging} ({self.kinds})")
        connection, n, rows = self.database.connect(), 0, []
        sql = f"INSERT INTO {staging} VALUES ({', '.join([marker] * len(self.schema.fields))})"
        try:
            cursor = connection.cursor()
            for row in iterator:
                rows.append(tuple(row))
                if len(rows) == FETCH:
                    cursor.executemany(sql, rows)
                    n, rows = n + len(rows), []
            if rows:
                cursor.executemany(sql, rows)
            connection.commit()
        finally:
            connection.close()
        return Staged(staging, n + len(rows))

    def _clean(self) -> None:
        made = [r[0] for rows in self.database.rows(f"SELECT name FROM {self._log()}", []) for r in rows]
        self.database.run(*(f"DROP TABLE IF EXISTS {_name(t)}" for t in made), f"DROP TABLE {self._log()}")

    def commit(self, messages: list[Staged | None]) -> None:
        full = [m.table for m in messages if m is not None and m.rows]
        same = [f"{self.table}.{c} = s.{c}" for c in self.upsert_on]
        clear = [f"DELETE FROM {self.table} WHERE EXISTS (SELECT 1 FROM {t} s WHERE {' AND '.join(same)})" for t in full] if same else []
        if self.overwrite:
            clear = [f"DELETE FROM {self.table}"]
        try:
            self.database.run(*clear, *(f"INSERT INTO {self.table} ({self.columns}) SELECT {self.columns} FROM {t}" for t in full))
        finally:
            self._clean()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clean()


class DatabaseSource(D.DataSource):
    """See the module. Null keys are read once; `upsert` names columns by which written rows replace those there."""

    @classmethod
    def name(cls) -> str:
        return "database"

    def schema(self) -> T.StructType:
        if "schema" not in self.options:
            raise ValueError("give the database source a schema, by the reader or as an option")
        return T.StructType.fromDDL(self.options["schema"])

    def reader(self, schema: T.StructType) -> DatabaseReader:
        return DatabaseReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DatabaseWriter:
        return DatabaseWriter(schema, self.options, overwrite)
