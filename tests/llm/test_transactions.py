"""The transaction log against a plain fold, on the given table, on planted logs and on odd ones."""

from __future__ import annotations

import collections
import random
import zlib

import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillmill.llm import registry, transactions


def plain(records: list[tuple], commits: int) -> tuple[list[tuple], list[dict]]:
    """Undone changes, and the store after every epoch, record by record; records are in order."""
    undone, stores, store, done = [], [], {}, 0
    live, marks = collections.defaultdict(list), collections.defaultdict(list)
    for seq, stream, op, key, value in records:
        mine, points = live[stream], marks[stream]
        if op == "commit":
            for _, k, v in mine:
                store.pop(k, None)
                if v is not None:
                    store[k] = v
            done += 1
            if done % commits == 0:
                stores.append(dict(store))
        elif op == "abort":
            undone += [("abort", s, seq, k) for s, k, _ in mine]
        elif op == "savepoint":
            points.append(len(mine))
        elif op == "rollback":
            mark = points.pop() if points else 0
            undone += [("rollback", s, seq, k) for s, k, _ in mine[mark:]]
            del mine[mark:]
        else:
            mine.append((seq, key, value))
        if op in ("commit", "abort"):
            live[stream], marks[stream] = [], []
    undone += [("abort", s, None, k) for mine in live.values() for s, k, _ in mine]
    if done % commits:
        stores.append(dict(store))
    return undone, stores


def held(done: transactions.Reassembled) -> list[dict]:
    rows = done.versions.collect()
    return [{r.key: r.value for r in rows if r.since <= e and (r.until is None or r.until > e)} for e in range(1, done.epochs + 1)]


SCHEMA = "seq long, stream string, op string, key string, value string, at string, part int"


def frame(spark, records):
    return spark.createDataFrame([(*r, "x", 1) for r in records], SCHEMA)


def order(rows):
    return sorted(rows, key=repr)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").orderBy("doc_id").collect()
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    records = []
    for d in docs:
        h = zlib.crc32(str(d.doc_id).encode())
        op = {0: "commit", 1: "commit", 2: "abort", 3: "savepoint", 4: "savepoint", 5: "rollback", 6: "rollback"}.get(h % 23, "change")
        key = h // 100 % 300
        records.append((d.doc_id, d.source, op, key, None if d.text is None or d.doc_id in toxic else zlib.crc32(f"{key}:{d.text}".encode())))
    undone, stores = plain(records, 4)
    want = [("state", k + 1, len(s), sum(s.values())) for k, s in enumerate(stores)] + undone
    got = registry.QUERIES["op12_transactions"](spark, SF)
    assert dict(got.dtypes) == {"kind": "string", "id": "bigint", "n": "bigint", "value": "bigint"}
    assert order(map(tuple, got.select("kind", "id", "n", "value").collect())) == order(want) and len(stores) > 1


@pytest.mark.parametrize("seed", range(3))
def test_planted_logs(spark, seed, monkeypatch):
    r = random.Random(seed)
    ops = ["change"] * 12 + ["commit", "commit", "abort", "savepoint", "savepoint", "rollback", "rollback", None]
    # a third of the records is of one stream, and of one key; some are of none
    records = [(3 * k - 500, r.choice(["hot"] * 5 + ["a", "b", "c", None, ""]), r.choice(ops), r.choice(["hot"] * 5 + ["k1", "k2", None, "ü"]), r.choice([None, f"text {k}", "same"])) for k in range(700)]
    undone, stores = plain(records, 3)
    shuffled = r.sample(records, len(records))
    monkeypatch.setattr(transactions, "BLOCKS", 5)
    done = transactions.reassemble(frame(spark, shuffled).repartition(7), 3)
    assert order(map(tuple, done.undone.select("kind", "seq", "by", "key").collect())) == order(undone)
    assert held(done) == stores
    sizes = transactions.states(done, F.length("value"))
    assert [(x.n, x.total) for x in sizes.orderBy("epoch").collect()] == [(len(s), sum(map(len, s.values()))) for s in stores]


def test_savepoints(spark):
    text = [("change", "a"), ("savepoint", None), ("change", "b"), ("savepoint", None), ("change", "c"), ("rollback", None), ("change", "d"), ("rollback", None), ("change", "e"), ("rollback", None), ("change", "f"), ("commit", None)]
    records = [(k, "s", op, key, "v" if key else None) for k, (op, key) in enumerate(text)]
    done = transactions.reassemble(frame(spark, records))
    assert order(tuple(x) for x in done.undone.collect()) == order([("rollback", 4, 5, "c"), ("rollback", 2, 7, "b"), ("rollback", 6, 7, "d"), ("rollback", 0, 9, "a"), ("rollback", 8, 9, "e")])
    assert held(done) == [{"f": "v"}]


def test_odd_logs(spark):
    none = transactions.reassemble(frame(spark, []))
    assert (none.epochs, none.undone.count(), none.versions.count(), transactions.states(none, F.length("value")).count()) == (0, 0, 0, 0)
    long = "x" * 2_000_000
    records = [(None, "a", "change", "k", "lost"), (1, None, "change", "k", long), (1, None, "change", "k", long), (2, None, "commit", None, None), (3, "a", "rollback", None, None), (4, "a", "commit", None, None), (5, "a", None, "k", "open")]
    done = transactions.reassemble(frame(spark, records))
    assert held(done) == [{"k": long}] and [tuple(x) for x in done.undone.collect()] == [("abort", 5, None, "k")]
    # of one seq the order is the same however the rows lie
    same = [(7, "a", "change", k, "v") for k in "pqrs"] + [(7, "a", "savepoint", None, None), (7, "a", "rollback", None, None), (8, "a", "commit", None, None)]
    assert held(transactions.reassemble(frame(spark, same))) == held(transactions.reassemble(frame(spark, same[::-1]).repartition(3)))
