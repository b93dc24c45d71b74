"""Tables in relational files (SQLite) as a Spark data source: key ranges are partitions, filters and columns reach their SQL.

A store is one file or a folder of files that each hold the table. Files are opened by path in the driver and in tasks, so
they lie in a folder that all of them share. Each partition reads one range of keys of one file, in order of the key, a
bounded number of rows at a time; a task that is run again reads the same rows.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Callable, Iterable, Iterator
from contextlib import closing, contextmanager
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .sink import insert_rows

#: Rows that are fetched or inserted at a time, and key ranges of a file unless an option says otherwise.
BATCH, RANGES = 10_000, 8
NAME = "quillmill_relational"
#: What a pushed filter is in SQL.
COMPARED = {D.EqualTo: "=", D.EqualNullSafe: "IS", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
KINDS = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "REAL", "float": "REAL", "string": "TEXT", "binary": "BLOB"}


def local(path: str) -> str:
    """The path of a file: URL, or a plain path; other stores cannot hold files that are opened by path."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"relational files need a folder that is mounted, not {path}")
    return unquote(found.path) if found.scheme else path


def named(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def condition(f: D.Filter) -> tuple[str, list] | None:
    """SQL and its values for a filter on one column; None if it stays with Spark."""
    if isinstance(f, D.Not):
        inner = condition(f.child)
        return inner and (f"NOT ({inner[0]})", inner[1])
    if len(f.attribute) != 1:
        return None
    column = named(f.attribute[0])
    if isinstance(f, D.IsNull | D.IsNotNull):
        return f"{column} IS {'NOT ' * isinstance(f, D.IsNotNull)}NULL", []
    if isinstance(f, D.In):
        return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if type(f) in COMPARED and isinstance(f.value, int | float | str | None):
        return f"{column} {COMPARED[type(f)]} ?", [f.value]
    return None


@dataclass
class Range(D.InputPartition):
    """Rows of a file with keys from lo to hi; both are None for the rows without a key."""

    path: str
    lo: int | None
    hi: int | None


class RelationalReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.table, self.key = schema, options["table"], options["key"]
        self.ranges = int(options.get("ranges", RANGES))
        path = local(options["path"])
        self.files = sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".db")) if os.path.isdir(path) else [path]
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for f in filters:
            found = condition(f)
            if found is None:
                yield f
            else:
                self.where.append(found[0])
                self.values += found[1]

    def partitions(self) -> list[Range]:
        """Ranges of even width between a file's least and greatest key, which its index gives without a scan."""
        out = []
        for path in self.files:
            with closing(opened(path)) as db:
                key = named(self.key)
                lo, hi = db.execute(f"SELECT min({key}), max({key}) FROM {named(self.table)}").fetchone()
                if lo is not None:
                    width = -(-(hi - lo + 1) // self.ranges)
                    out += [Range(path, a, min(a + width - 1, hi)) for a in range(lo, hi + 1, width)]
                if db.execute(f"SELECT 1 FROM {named(self.table)} WHERE {key} IS NULL LIMIT 1").fetchone():
                    out.append(Range(path, None, None))
        return out

    def statement(self, part: Range) -> tuple[str, list]:
        key = named(self.key)
        own = f"{key} IS NULL" if part.lo is None else f"{key} BETWEEN ? AND ?"
        where = " AND ".join([own, *(f"({w})" for w in self.where)])
        columns = ", ".join(named(f.name) for f in self.schema) or "1"
        return f"SELECT {columns} FROM {named(self.table)} WHERE {where} ORDER BY {key}", ([] if part.lo is None else [part.lo, part.hi]) + self.values

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a store without rows has no partitions
            return
        kind = to_arrow_schema(self.schema)
        with closing(opened(partition.path)) as db:
            rows = db.execute(*self.statement(partition))
            while got := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), kind, strict=True)], schema=kind)


class Relational(D.DataSource):
    """Options: path, table, key (a column of integers), ranges (of a file). The schema's columns are those that are read."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("state the schema: its columns are those that are read")

    def reader(self, schema: StructType) -> RelationalReader:
        return RelationalReader(schema, self.options)


def read_relational(spark: SparkSession, path: str, table: str, key: str, schema: str, ranges: int = RANGES) -> DataFrame:
    """Columns of a table by their schema (DDL), as a DataFrame whose simple filters are run by the files' own SQL."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Relational)
    return spark.read.format(NAME).schema(schema).options(path=path, table=table, key=key, ranges=str(ranges)).load()


@contextmanager
def relational_sink(path: str, table: str, columns: str, key: str, partition: int, attempt: int) -> Iterator[Callable[[pa.RecordBatch], None]]:
    """Inserts batches into a file of its own, each whole or not at all; columns: what stands between the parentheses of CREATE TABLE.

    The file is written under a name of its attempt and renamed at the end, so that a task that runs again leaves one file.
    """
    folder = local(path)
    os.makedirs(folder, exist_ok=True)
    done = os.path.join(folder, f"part-{partition:05d}.db")
    own = f"{done}.{attempt}"
    # the file counts only once it is renamed: until then a batch is a savepoint of one transaction, and nothing waits for the disk
    with closing(sqlite3.connect(own, isolation_level=None)) as db:
        db.execute("PRAGMA journal_mode = MEMORY")
        db.execute("PRAGMA synchronous = OFF")
        db.execute("BEGIN")
        db.execute(f"CREATE TABLE {named(table)} ({columns})")

        def insert(batch: pa.RecordBatch) -> None:
            marks = ", ".join("?" * batch.num_columns)
            db.execute("SAVEPOINT batch")
            try:
                db.executemany(f"INSERT INTO {named(table)} VALUES ({marks})", zip(*(c.to_pylist() for c in batch.columns), strict=True))
            except BaseException:
                db.execute("ROLLBACK TO batch")
                raise
            finally:
                db.execute("RELEASE batch")

        yield insert
        db.execute(f"CREATE INDEX {named(f'{table}_{key}')} ON {named(table)} ({named(key)})")
        db.execute("COMMIT")
    with open(own, "rb") as f:
        os.fsync(f.fileno())
    os.replace(own, done)


def columns_of(rows: DataFrame) -> str:
    return ", ".join(f"{named(n)} {KINDS[t]}" for n, t in rows.dtypes)


def write_relational(rows: DataFrame, path: str, table: str, key: str) -> int:
    """Write rows as a table of relational files, one a task, with an index on the key. Rows written."""
    columns = columns_of(rows)
    inserted, _, rejected = insert_rows(rows, lambda partition, attempt: relational_sink(path, table, columns, key, partition, attempt), BATCH)
    wrong = rejected.first()
    if wrong:
        raise ValueError(f"a row could not be written: {wrong['error']}")
    return inserted
