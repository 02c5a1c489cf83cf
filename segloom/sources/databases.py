"""SQLite tables as a data source: files scanned side by side in ranges of rowid, filters pushed down, one file a task written.

A folder of files with one table each is one table. Files must be on a file system that all executors mount. A value
that doesn't fit its column's type, which SQLite allows, is null; filters are looked at again by Spark, so pushing them
only spares rows.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shipping import ship_package

END = ".sqlite"
FETCH = 5000
OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
PYTHON = {T.LongType(): int, T.DoubleType(): float, T.StringType(): str, T.BinaryType(): bytes}
SQLITE = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "binary": "BLOB"}


def local_path(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        raise ValueError(f"SQLite files must be on a mounted file system, not at {path}")
    return path


def files_of(path: str) -> list[str]:
    return sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith(END)) if os.path.isdir(path) else [path]


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(file)}?mode=ro", uri=True)


def column_type(declared: str) -> T.DataType:
    """By SQLite's rules for a column's affinity."""
    kind = declared.upper()
    if "INT" in kind:
        return T.LongType()
    if any(x in kind for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    return T.BinaryType() if "BLOB" in kind or not kind else T.DoubleType()


@dataclass
class Rows(InputPartition):
    """A file's rows from ``first`` to before ``stop``; all of them where a table has no rowid."""

    file: str
    first: int | None = None
    stop: int | None = None


class SqliteSource(DataSource):
    """Options: path, table; partitions (1), columns (all, else names with commas between)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        (file, *_) = files_of(local_path(self.options["path"]))
        con = opened(file)
        found = {name: column_type(kind) for _, name, kind, *_ in con.execute(f"PRAGMA table_info({quoted(self.options['table'])})")}
        con.close()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {file}")
        names = self.options["columns"].split(",") if self.options.get("columns") else found
        return T.StructType([T.StructField(n, found[n]) for n in names])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(local_path(self.options["path"]), self.options["table"], int(self.options.get("partitions", 1)), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(local_path(self.options["path"]), self.options["table"], schema, overwrite)


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, partitions: int, schema: T.StructType):
        self.path, self.table, self.n, self.schema = path, table, partitions, schema
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if column and type(f) in OPERATORS and isinstance(f.value, int | float | str):
                self.where.append(f"{column} {OPERATORS[type(f)]} ?")
                self.values.append(f.value)
            elif column and isinstance(f, In) and all(isinstance(v, int | float | str) for v in f.value):
                self.where.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif column and isinstance(f, IsNull | IsNotNull):
                # a value of another type will be null for Spark, so only real nulls tell
                if isinstance(f, IsNotNull):
                    self.where.append(f"{column} IS NOT NULL")
            yield f

    def partitions(self) -> Sequence[Rows]:
        files, out = files_of(self.path), []
        for file in files:
            con = opened(file)
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            except sqlite3.OperationalError:  # WITHOUT ROWID
                out.append(Rows(file))
                continue
            finally:
                con.close()
            if low is None:
                continue
            parts = max(1, -(-self.n // len(files)))
            step = -(-(high - low + 1) // parts)
            out += [Rows(file, first, min(first + step, high + 1)) for first in range(low, high + 1, step)]
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there was none to read
            return
        types = to_arrow_schema(self.schema)
        made = [PYTHON[f.dataType] for f in self.schema]
        wanted = [*self.where, *(["rowid >= ? AND rowid < ?"] if partition.first is not None else [])]
        values = [*self.values, *([partition.first, partition.stop] if partition.first is not None else [])]
        con = opened(partition.file)
        rows = con.execute(f"SELECT {', '.join(quoted(n) for n in self.schema.names)} FROM {quoted(self.table)}" + (" WHERE " + " AND ".join(wanted) if wanted else ""), values)
        while batch := rows.fetchmany(FETCH):
            columns = []
            for column, kind, to in zip(zip(*batch, strict=True), types, made, strict=True):
                fits = [float(v) if to is float and isinstance(v, int) else v if isinstance(v, to) else None for v in column]
                columns.append(pa.array(fits, kind.type))
            yield pa.RecordBatch.from_arrays(columns, schema=types)
        con.close()


@dataclass
class Written(WriterCommitMessage):
    file: str


class SqliteWriter(DataSourceWriter):
    """Each task fills a hidden file; the commit gives all of them their names, or an abort removes them."""

    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool):
        self.path, self.table, self.schema, self.overwrite, self.job = path, table, schema, overwrite, uuid.uuid4().hex
        unknown = [f.name for f in schema if f.dataType.simpleString() not in SQLITE]
        if unknown:
            raise ValueError(f"SQLite has no type for {', '.join(unknown)}")

    def write(self, iterator: Iterator[T.Row]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        file = f"{self.path}/.{self.job}-{uuid.uuid4().hex}"
        con = sqlite3.connect(file)
        con.execute(f"CREATE TABLE {quoted(self.table)} ({', '.join(f'{quoted(f.name)} {SQLITE[f.dataType.simpleString()]}' for f in self.schema)})")
        con.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(self.schema))})", (tuple(row) for row in iterator))
        con.commit()
        con.close()
        return Written(file)

    def commit(self, messages: list[Written | None]) -> None:
        before = [f for f in files_of(self.path)] if self.overwrite else []
        for k, m in enumerate(m for m in messages if m):
            os.replace(m.file, f"{self.path}/part-{k:05d}-{self.job}{END}")
        for file in before:
            os.remove(file)
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        """What is left of this job, of lost attempts too."""
        for f in os.listdir(self.path) if os.path.isdir(self.path) else []:
            if f.startswith(f".{self.job}"):
                os.remove(f"{self.path}/{f}")


def _registered(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 1, columns: list[str] | None = None) -> DataFrame:
    """A table of the SQLite file, or the files, at ``path``, in about so many partitions; only ``columns``, if given."""
    _registered(spark)
    reader = spark.read.format("sqlite").option("path", path).option("table", table).option("partitions", partitions)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()


def write_sqlite(rows: DataFrame, path: str, table: str, append: bool = False) -> None:
    """``rows`` as files below ``path``, one for each partition, in place of those that are there unless ``append``."""
    _registered(rows.sparkSession)
    rows.write.format("sqlite").option("path", path).option("table", table).mode("append" if append else "overwrite").save()
