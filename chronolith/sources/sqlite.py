"""A reader of SQLite captures: ranges of row ids are partitions, columns and times are chosen in the database.

Executors open the file read-only by its path, so on a cluster it lies in a shared folder.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a partition, about.
ROWS = 200_000


def connect(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(Path(path).resolve().as_uri() + "?mode=ro", uri=True, timeout=3.0)
    db.execute("PRAGMA query_only = ON")
    return db


def columns_of(path: str, table: str) -> list[str]:
    """The columns of a table, none if there is no such table."""
    with connect(path) as db:
        return [r[1] for r in db.execute(f'PRAGMA table_info("{table}")')]


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


def _plain(kind: T.DataType, value):
    """A value in the type of its column; what has another type is null."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
        return bool(value) if isinstance(kind, T.BooleanType) else float(value) if isinstance(kind, T.DoubleType) else int(value)
    except (TypeError, ValueError):
        return None


class SqliteReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.window = (options["from"], options["to"]) if "from" in options else None

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as db:
            lo, hi = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        return [Range(i, i + ROWS) for i in range(lo, hi + 1, ROWS)] if lo is not None else []

    def read(self, partition) -> Iterator[tuple]:
        if partition is None:
            return
        names = ", ".join(f'"{f.name}"' for f in self.schema)
        sql, args = f'SELECT {names} FROM "{self.table}" WHERE rowid >= ? AND rowid < ?', [partition.lo, partition.hi]
        if self.window:
            sql, args = sql + " AND timestamp >= ? AND timestamp < ?", [*args, *self.window]
        with connect(self.path) as db:
            for row in db.execute(sql, args):
                yield tuple(_plain(f.dataType, v) for f, v in zip(self.schema, row))


class SqliteCapture(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chronolith_sqlite"

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(self.options, schema)


def read_table(spark: SparkSession, path: str, table: str, schema: T.StructType, window: tuple[str, str] | None = None) -> DataFrame:
    """The columns of schema that a table has; empty without the table."""
    have = {c.lower() for c in columns_of(path, table)}
    own = T.StructType([f for f in schema if f.name in have])
    if not len(own):
        return spark.createDataFrame([], schema)
    spark.dataSource.register(SqliteCapture)
    reader = spark.read.format("chronolith_sqlite").schema(own).option("path", path).option("table", table)
    if window and "timestamp" in have:
        reader = reader.option("from", window[0]).option("to", window[1])
    return reader.load()
