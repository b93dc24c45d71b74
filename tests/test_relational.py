"""Relational files as a data source: rows, partitions, filters and columns in their SQL, retries and odd tables."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import datasource as D
from pyspark.sql.types import IntegerType, StructField, StructType

from quillmill.sources import relational as R

KIND = "id long, doc string, n int, text string"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "blocks")
    rows = [(i if i % 50 else None, f"d{i % 7}", i % 90, f'"quoted" ünï {i}' if i % 5 else None) for i in range(3000)]
    assert R.write_relational(spark.createDataFrame(rows, KIND).repartition(3), path, 'blocks "x"', "id") == 3000
    return path, rows


def read(spark, store, schema=KIND, ranges=4):
    return R.read_relational(spark, store[0], 'blocks "x"', "id", schema, ranges)


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_all_rows_in_ranges(spark, store):
    found = read(spark, store)
    assert order(found.collect()) == order(store[1])
    # three files of four ranges and one of rows without a key
    assert found.rdd.getNumPartitions() == 15


@pytest.mark.parametrize("where", ["n BETWEEN 20 AND 40 AND doc = 'd3'", "text IS NULL AND n > 80", "doc IN ('d1', 'd2') AND NOT n = 3", "doc LIKE 'd%' AND n <= 1", "id IS NULL", "text = '\"quoted\" ünï 7'", "id > 2990 OR n = 1"])
def test_filters(spark, store, where):
    want = spark.createDataFrame(store[1], KIND).where(where)
    assert order(read(spark, store).where(where).collect()) == order(want.collect()) and want.count()


def test_filters_and_columns_reach_the_files(spark, tmp_path):
    """A row that the filter excludes, and a column that is not asked for, cannot be read without an error."""
    with sqlite3.connect(tmp_path / "one.db") as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, doc TEXT, n INTEGER, bad INTEGER)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(1, "a", 60, "no number"), (2, "b", "no number", 1), (3, "a", 70, 1)])
    found = R.read_relational(spark, str(tmp_path / "one.db"), "t", "id", "id long, doc string, n int")
    assert order(found.where("doc = 'a' AND n BETWEEN 50 AND 65").collect()) == [(1, "a", 60)]
    with pytest.raises(Exception, match="no number|integer"):
        found.where("doc = 'b'").collect()


def test_statement():
    reader = R.RelationalReader(StructType([StructField("n", IntegerType())]), {"path": "x.db", "table": "t", "key": "id"})
    left = list(reader.pushFilters([D.GreaterThan(("n",), 50), D.StringStartsWith(("doc",), "d"), D.In(("doc",), ("a", "b"))]))
    assert [type(f) for f in left] == [D.StringStartsWith]
    assert reader.statement(R.Range("x.db", 1, 9)) == ('SELECT "n" FROM "t" WHERE "id" BETWEEN ? AND ? AND ("n" > ?) AND ("doc" IN (?, ?)) ORDER BY "id"', [1, 9, 50, "a", "b"])


def test_odd_stores(spark, tmp_path):
    path = str(tmp_path / "none")
    assert R.write_relational(spark.createDataFrame([(1, "a", 1, "x")], KIND).where("id > 1"), path, "t", "id") == 0
    assert R.read_relational(spark, path, "t", "id", KIND).collect() == []
    for _ in range(2):  # a second run replaces the files of the first
        assert R.write_relational(spark.createDataFrame([(1, "a", 1, "x" * 3_000_000)], KIND).coalesce(1), path, "t", "id") == 1
    assert [len(r.text) for r in R.read_relational(spark, path, "t", "id", KIND).collect()] == [3_000_000]
    with pytest.raises(ValueError, match="mounted"):
        R.local("s3a://bucket/x")


def test_sink_commits_once(tmp_path, monkeypatch):
    """Batches, also refused ones, wait for no commit of their own; a file holds what was accepted."""
    import sqlite3

    import pyarrow as pa

    from quillmill.sources import relational, sink

    said, connect = [], sqlite3.connect

    def traced(*a, **k):
        db = connect(*a, **k)
        db.set_trace_callback(said.append)
        return db

    monkeypatch.setattr(relational.sqlite3, "connect", traced)
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([None if i % 9 == 0 else "x" for i in range(200)])], ["k", "t"])
    with relational.relational_sink(str(tmp_path), "rows", '"k" INTEGER, "t" TEXT NOT NULL', "k", 0, 1) as insert:
        failed, _ = sink.bisected(batch, insert)
    monkeypatch.undo()
    assert [a for a, _ in sorted(failed)] == [i for i in range(200) if i % 9 == 0]
    assert sum(x.strip().upper() == "COMMIT" for x in said) == 1
    with sqlite3.connect(tmp_path / "part-00000.db") as db:
        assert [r[0] for r in db.execute("SELECT k FROM rows ORDER BY k")] == [i for i in range(200) if i % 9]
