"""A Spark data source over SQLite tables, split by rowid ranges. Register with ``spark.dataSource.register(SqliteSource)``."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_TYPES = (("INT", "long"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BLOB", "binary"))


class SqliteSource(DataSource):
    """Options: path, table, partitions (1), and where: a condition in SQLite's SQL that the database itself applies.

    Columns and types come from the table's declaration; anything else is a string. A schema given to the reader prunes the columns.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as c:
            cols = c.execute(f"PRAGMA table_info({_quote(self.options['table'])})").fetchall()
        if not cols:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{name}` {next((t for k, t in _TYPES if k in (kind or '').upper()), 'string')}" for _, name, kind, *_ in cols)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        n = max(1, int(self.options.get("partitions", "1")))
        with self._connect() as c:
            lo, hi = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quote(self.options['table'])}").fetchone()
        if lo is None:
            return [_Range(0, -1)]
        step = -(-(hi - lo + 1) // n)
        return [_Range(a, min(a + step - 1, hi)) for a in range(lo, hi + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        cols = ", ".join(_quote(f.name) for f in self.schema.fields)
        where = f" AND ({self.options['where']})" if self.options.get("where") else ""
        with self._connect() as c:
            yield from c.execute(f"SELECT {cols} FROM {_quote(self.options['table'])} WHERE rowid BETWEEN ? AND ?{where}", (partition.lo, partition.hi))


def _quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def write_upsert(rows: Iterator, path: str, table: str, key: str, columns: list[str]) -> int:
    """Insert or replace rows (dicts) by ``key`` into a table that is made if it is missing; the last write wins. For small results on one machine."""
    cols = ", ".join(_quote(c) for c in columns)
    with sqlite3.connect(path) as c:
        c.execute(f"CREATE TABLE IF NOT EXISTS {_quote(table)} ({', '.join(_quote(x) + (' PRIMARY KEY' if x == key else '') for x in columns)})")
        cur = c.executemany(f"INSERT OR REPLACE INTO {_quote(table)} ({cols}) VALUES ({', '.join('?' * len(columns))})", ([r[x] for x in columns] for r in rows))
        return cur.rowcount
