"""SQLite files as a Spark source: `spark.read.format("sqlite")`, one partition a file and range of rowids.

Options: path (one file or several, comma-separated), table, columns (comma-separated), where (an SQL condition that the file
itself applies), keys (names for the files, comma-separated, given as column `db`), rows (rowids a partition).
The files must be readable where executors run.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

_KINDS = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Part(InputPartition):
    path: str
    db: str
    first: int
    last: int


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = [f.name for f in schema.fields if f.name != "db"]
        self.options = options

    def partitions(self) -> list[Part]:
        paths = self.options["path"].split(",")
        keys = self.options.get("keys", self.options["path"]).split(",")
        step = int(self.options.get("rows", "100000"))
        found = []
        for path, db in zip(paths, keys, strict=True):
            with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
                low, high = con.execute(f"select min(rowid), max(rowid) from {_quoted(self.options['table'])}").fetchone()
            found += [Part(path, db, at, min(at + step - 1, high)) for at in range(low, high + 1, step)] if low is not None else []
        return found or [Part(paths[0], keys[0], 1, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        where = f" and ({self.options['where']})" if self.options.get("where") else ""
        names = ", ".join(map(_quoted, self.columns))
        with closing(sqlite3.connect(f"file:{partition.path}?mode=ro", uri=True)) as con:
            for row in con.execute(f"select {names} from {_quoted(self.options['table'])} where rowid between ? and ?{where} order by rowid", (partition.first, partition.last)):
                yield (partition.db, *row)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        path = self.options["path"].split(",")[0]
        with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as con:
            rows = con.execute(f"pragma table_info({_quoted(self.options['table'])})").fetchall()
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or [r[1] for r in rows]
        kinds = {r[1]: _KINDS.get(r[2].upper(), "string") for r in rows}
        return ", ".join(["db string", *(f"`{c}` {kinds[c]}" for c in wanted)])

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, dict(self.options))


def read_sqlite(spark: SparkSession, paths: dict[str, str], table: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Rows of one table in several files (key to path), with the key as column db."""
    spark.dataSource.register(SqliteSource)
    reader = spark.read.format("sqlite").option("path", ",".join(paths.values())).option("keys", ",".join(paths)).option("table", table)
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return (reader.option("where", where) if where else reader).load()
