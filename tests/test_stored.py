"""Stored tables changed by key, and sinks that refuse batches."""

from __future__ import annotations

import glob
import math
import os
import sqlite3
from functools import partial

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmill.sources import relational
from quillmill.sources.sink import bisected, insert_rows
from quillmill.sources.stored import StoredTable

KIND = "id long, name string, n long"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def rows(stored, spark):
    return sorted(map(tuple, stored.read(spark).collect()))


@pytest.fixture
def stored(spark, tmp_path):
    out = StoredTable(str(tmp_path / "t"), "id", KIND, 16)
    out.create(spark.createDataFrame([(i, f"n{i}", 0) for i in range(200)], KIND))
    return out


def test_changes_touch_their_buckets_alone(spark, stored):
    want = {i: (i, f"n{i}", 0) for i in range(200)}
    before = files(stored.path)
    changes = spark.createDataFrame([(7, "seven", 1), (900, "new", 2), (None, "lost", 3)], KIND)
    for _ in range(2):  # a repeat gives the same table
        stored.upsert(changes)
        want |= {7: (7, "seven", 1), 900: (900, "new", 2)}
        assert rows(stored, spark) == sorted(want.values())
    after = files(stored.path)
    touched = {f"_bucket={r[0]}" for r in changes.where("id IS NOT NULL").select(stored.bucket()).collect()}
    assert {f for f in before if before[f] != after.get(f)} == {f for f in before if f.split("/")[-2] in touched}
    stored.update(spark.createDataFrame([(8, "x"), (9, "y"), (10_000, "z")], "id long, to string"), {"name": F.concat("old.name", "new.to"), "n": F.lit(5)})
    want |= {8: (8, "n8x", 5), 9: (9, "n9y", 5)}
    assert rows(stored, spark) == sorted(want.values())
    stored.delete(spark.createDataFrame([(3,), (900,), (5_000,)], "id long"))
    assert rows(stored, spark) == sorted(v for k, v in want.items() if k not in (3, 900))


def test_emptied_buckets_and_nothing_to_do(spark, stored):
    before = files(stored.path)
    stored.upsert(spark.createDataFrame([], KIND))
    stored.delete(spark.createDataFrame([(None,)], "id long"))
    assert files(stored.path) == before
    stored.delete(spark.range(500))
    assert rows(stored, spark) == [] and not files(stored.path)
    stored.upsert(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 2)], KIND))
    assert len(rows(stored, spark)) == 1


@pytest.mark.parametrize("bad", [set(), {0}, {99}, {3, 4, 50}, set(range(0, 1000, 97)), set(range(1000))])
def test_bisection(bad):
    there = []

    def insert(batch):
        ids = batch.column(0).to_pylist()
        if bad & set(ids):
            raise ValueError(f"{len(bad & set(ids))} bad")
        there.extend(ids)

    failed, calls = bisected(pa.RecordBatch.from_arrays([pa.array(range(1000))], ["id"]), insert)
    assert {i for i, _ in failed} == bad and sorted(there) == [i for i in range(1000) if i not in bad]
    k = len(bad)
    assert calls <= (1 + 2 * k * (math.log2(1000 / k) + 1) if k else 1)


def test_a_sink_that_raises_loses_just_its_rows(spark, tmp_path):
    """Rows the sink alone knows to be bad, by a length and by a repeated id."""
    path, mark = str(tmp_path / "db"), str(tmp_path / "failed once")
    own = partial(relational.relational_sink, path, "t", '"id" INTEGER UNIQUE, "name" TEXT CHECK (length(name) < 9)', "id")
    data = [(i, "long name indeed" if i % 83 == 0 else f"n{i}", 0) for i in range(2000)] + [(5, "again", 0), (None, None, 0)]
    inserted, calls, rejected = insert_rows(spark.createDataFrame(data, KIND).select("id", "name").coalesce(1), own, 256)
    want = [(i, n) for i, n, _ in data if n and len(n) >= 9] + [(5, "again")]
    assert sorted((r.id, r.name) for r in rejected.collect()) == sorted(want)
    assert inserted == len(data) - len(want) and calls < 40 * len(want)
    with sqlite3.connect(glob.glob(f"{path}/*.db")[0]) as db:
        assert db.execute("SELECT count(*), count(DISTINCT id) FROM t").fetchone() == (inserted, inserted - 1)
    assert len(os.listdir(path)) == 1
    none = insert_rows(spark.createDataFrame(data, KIND).where("id > 10000"), own)
    assert none[:2] == (0, 0) and none[2].collect() == []
