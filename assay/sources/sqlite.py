"""An SQLite data source over the standard library, read in ranges of row ids: spark.read.format("assay_sqlite").

Options: path, table, and partitions (4). The file must be visible to the executors. ``write_tables`` is the sink."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TYPES = {"INTEGER": "long", "INT": "long", "REAL": "double", "TEXT": "string", "": "string"}


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "assay_sqlite"

    def schema(self) -> str:
        with _open(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({_name(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{c[1]}` {TYPES.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, [f.name for f in schema])


class _Reader(DataSourceReader):
    def __init__(self, options, columns: list[str]):
        self.path, self.table, self.columns = options["path"], options["table"], columns
        self.parts = int(options.get("partitions", 4))

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_name(self.table)}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition) -> Iterator[tuple]:
        with _open(self.path) as db:
            yield from db.execute(f"SELECT {', '.join(map(_name, self.columns))} FROM {_name(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))


def read_table(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("assay_sqlite").options(path=path, table=table, partitions=partitions).load()


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A small release as one file, rows streamed through the driver a partition at a time. Large ones are Parquet tables."""
    back = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "boolean": "INTEGER"}
    with sqlite3.connect(path) as db:
        for name, df in tables.items():
            db.execute(f"CREATE TABLE {_name(name)} (" + ", ".join(f"{_name(f.name)} {back.get(f.dataType.simpleString(), 'TEXT')}" for f in df.schema) + ")")
            marks = ", ".join("?" * len(df.columns))
            db.executemany(f"INSERT INTO {_name(name)} VALUES ({marks})", (tuple(r) for r in df.toLocalIterator()))
    with sqlite3.connect(path) as db:
        db.execute("VACUUM")
