"""Tables of a SQLite file as a Spark data source (Python Data Source API), by ranges of a key.

Each partition reads its own range of the key with the columns that are asked for; filters that SQLite can decide the
same way are handed to it, all others stay with Spark. Writing tasks fill staging tables, which the driver moves into the
target in one transaction when all have succeeded, so a task that runs twice adds nothing. (A task that ends just after
its job was given up can leave its staging table, which nothing reads.) The file must be on a file
system that driver and executors share; a server's table is read the same way by `spark.read.jdbc` and its own
partition column where a driver is installed.
"""

from __future__ import annotations

import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Column types: Spark's name, SQLite's.
KINDS = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "binary": "BLOB"}
SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def local(path: str) -> str:
    """The path of a mounted file system, without its scheme."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"not a path of a mounted file system: {path}")
    return path.removeprefix("file://").removeprefix("file:")


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(local(path), timeout=120, isolation_level=None)


@dataclass
class Range(InputPartition):
    """Keys from low to below high; nulls go with the first range. None: without an end."""

    low: int | None
    high: int | None
    nulls: bool


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.key, self.count = options["path"], options["table"], options.get("key"), int(options.get("partitions", 8))
        self.schema, self.where, self.values = schema, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of numbers and texts; what it doesn't take is given back."""
        kinds = {f.name: f.dataType.simpleString() for f in self.schema}
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            plain = lambda v: isinstance(v, (int, str)) and not isinstance(v, bool)
            if kinds.get(name) not in ("bigint", "int", "smallint", "tinyint", "string"):
                yield f
            elif type(f) in SIGNS and plain(f.value):
                self.where.append(f"{quoted(name)} {SIGNS[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In) and f.value and all(map(plain, f.value)) and len(f.value) < 500:
                self.where.append(f"{quoted(name)} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{quoted(name)} IS {'' if isinstance(f, IsNull) else 'NOT '}NULL")
            else:
                yield f

    def partitions(self) -> list[Range]:
        if not self.key:
            return [Range(None, None, True)]
        with opened(self.path) as db:
            low, high = db.execute(f"SELECT min({quoted(self.key)}), max({quoted(self.key)}) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [Range(None, None, True)]
        step = max(1, -(-(high - low + 1) // self.count))
        edges = list(range(low, high + 1, step))
        return [Range(None if i == 0 else e, edges[i + 1] if i + 1 < len(edges) else None, i == 0) for i, e in enumerate(edges)]

    def read(self, partition: Range) -> Iterator[tuple]:
        where, values = list(self.where), list(self.values)
        own = []
        if partition.low is not None:
            own.append(f"{quoted(self.key)} >= {int(partition.low)}")
        if partition.high is not None:
            own.append(f"{quoted(self.key)} < {int(partition.high)}")
        if own:
            where.append("(" + " AND ".join(own) + (f" OR {quoted(self.key)} IS NULL" if partition.nulls else "") + ")")
        columns = ", ".join(quoted(f.name) for f in self.schema) or "1"
        truth = [i for i, f in enumerate(self.schema) if f.dataType.simpleString() == "boolean"]
        with opened(self.path) as db:
            for row in db.execute(f"SELECT {columns} FROM {quoted(self.table)}{' WHERE ' + ' AND '.join(where) if where else ''}", values):
                if truth:
                    row = tuple(bool(v) if i in truth and v is not None else v for i, v in enumerate(row))
                yield row


@dataclass
class _Staged(WriterCommitMessage):
    table: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.table, self.schema, self.overwrite = options["path"], options["table"], schema, overwrite
        self.columns = ", ".join(f"{quoted(f.name)} {KINDS[f.dataType.simpleString()]}" for f in schema)
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> _Staged:
        name = f"staged_{self.job}_{uuid.uuid4().hex}"
        with opened(self.path) as db:
            db.execute("BEGIN IMMEDIATE")
            db.execute(f"CREATE TABLE {quoted(name)} ({self.columns})")
            db.executemany(f"INSERT INTO {quoted(name)} VALUES ({', '.join('?' * len(self.schema))})", (tuple(r) for r in iterator))
            db.execute("COMMIT")
        return _Staged(name)

    def commit(self, messages: list[_Staged | None]) -> None:
        with opened(self.path) as db:
            db.execute("BEGIN IMMEDIATE")
            if self.overwrite:
                db.execute(f"DROP TABLE IF EXISTS {quoted(self.table)}")
            db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(self.table)} ({self.columns})")
            names = ", ".join(quoted(f.name) for f in self.schema)
            for m in messages:
                if m:
                    db.execute(f"INSERT INTO {quoted(self.table)} ({names}) SELECT {names} FROM {quoted(m.table)}")
            self._clear(db)
            db.execute("COMMIT")

    def abort(self, messages: list[_Staged | None]) -> None:
        with opened(self.path) as db:
            self._clear(db)

    def _clear(self, db: sqlite3.Connection) -> None:
        for (name,) in db.execute("SELECT name FROM sqlite_master WHERE name GLOB ?", (f"staged_{self.job}_*",)).fetchall():
            db.execute(f"DROP TABLE {quoted(name)}")


class SqliteSource(DataSource):
    """Options: path, table, key (an integer column to partition by), partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with opened(self.options["path"]) as db:
            columns = db.execute("SELECT name, upper(type) FROM pragma_table_info(?)", (self.options["table"],)).fetchall()
        kinds = {"INTEGER": "bigint", "REAL": "double", "BLOB": "binary"}
        return ", ".join(f"`{n}` {kinds.get(k, 'string')}" for n, k in columns)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


def _ready(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)


def read_database(spark: SparkSession, path: str, table: str, schema: str, key: str | None = None, partitions: int = 8) -> DataFrame:
    """The columns of `schema` only; they are all that SQLite is asked for."""
    _ready(spark)
    out = spark.read.format("sqlite_table").schema(schema).option("path", path).option("table", table).option("partitions", partitions)
    return (out.option("key", key) if key else out).load()


def write_database(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    _ready(df.sparkSession)
    if bad := [c for c, k in df.dtypes if k not in KINDS]:
        raise ValueError(f"no SQLite type for {bad}")
    df.write.format("sqlite_table").option("path", path).option("table", table).mode(mode).save()
