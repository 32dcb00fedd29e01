"""Tables of SQLite files, such as older bundles hold, as a batch source.

Register with ``spark.dataSource.register(SqliteSource)`` or use ``read_sqlite``. A table is read in ranges of its row numbers, one
task each; the file must lie where all executors can open it. Files are opened read-only and immutable.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Column types by what their declared type contains, in SQLite's order.
AFFINITY = (("INT", "long"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"))
ROWS_AT_ONCE = 100_000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def columns_of(path: str, table: str) -> list[tuple[str, str]]:
    """(name, Spark type) of a table's columns; ValueError where there is no such table."""
    with _open(path) as db:
        rows = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    if not rows:
        raise ValueError(f"no table {table!r}")
    return [(r[1], next((t for mark, t in AFFINITY if mark in (r[2] or "BLOB").upper()), "string")) for r in rows]


class Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


def _as(value: object, kind: str) -> object:
    """A stored value, whatever its own type, as one of the column's type; NULL where it can't be."""
    if value is None:
        return None
    try:
        if kind == "long":
            return int(value)
        if kind == "double":
            return float(value)
        if kind == "binary":
            return value if isinstance(value, bytes) else str(value).encode()
        return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    except (TypeError, ValueError):
        return None


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str) -> None:
        self.path, self.table, self.columns = path, table, columns_of(path, table)

    def partitions(self) -> list[Rows]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        return [Rows(0, -1)] if low is None else [Rows(a, min(a + ROWS_AT_ONCE - 1, high)) for a in range(low, high + 1, ROWS_AT_ONCE)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        names = ", ".join(_quoted(c) for c, _ in self.columns)
        with _open(self.path) as db:
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high)):
                yield tuple(_as(v, t) for v, (_, t) in zip(row, self.columns))


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return ", ".join(f"`{c}` {t}" for c, t in columns_of(self.options["path"], self.options["table"]))

    def reader(self, schema) -> SqliteReader:  # noqa: ANN001
        return SqliteReader(self.options["path"], self.options["table"])


def read_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of an SQLite file; NULLs and values of another type than their column's stay what they can be."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_table").option("path", path).option("table", table).load()
