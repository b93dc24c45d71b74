"""Context windows against plain loops, and line numbers of files of many splits."""

from __future__ import annotations

import random

from quillmill.operators import context as X
from quillmill.sources import io

ITEMS = "doc string, page long, pos long, text string"


def cut(text, most):
    return text[: most - 3].rstrip() + "..." if len(text) > most else text


def planted():
    r = random.Random(2)
    out = []
    for doc in ("a", "b", "c"):
        page = 0
        for pos in range(120):
            page += r.choice([0, 0, 0, 0, 1, 2])
            out.append((doc, page if r.random() > 0.05 else None, pos, r.choice([None, "", " \n ", "short  text\n", "word " * r.randint(1, 40)])))
    return out


def clean(text):
    return " ".join((text or "").split())


def test_pages(spark):
    items = planted()
    centers = [(k, d, p) for k, (d, p) in enumerate([(d, p) for d in "abcz" for p in (*range(0, 75), None)])]
    got = {r.id: (r.pages, r.text) for r in X.page_contexts(spark.createDataFrame(centers, "id long, doc string, page long"), spark.createDataFrame(items, ITEMS).repartition(5), 200).collect()}
    assert len(got) == len(centers)
    for k, doc, page in centers:
        there = {p for d, p, _, _ in items if d == doc and p is not None}
        pages = [] if page is None else [p for p in ([page, page + 1] if page + 1 in there else [page - 1, page]) if p in there]
        text = " ".join(f"[page {p}] {clean(t)}" for d, p, _, t in items if d == doc and p in pages and clean(t))
        assert got[k] == (pages, cut(text, 200)), (doc, page)


def test_windows(spark):
    items = planted()
    centers = [(k, d, i) for k, (d, i) in enumerate([(d, i) for d in "abz" for i in (*range(-3, 125), None)])]
    got = {r.id: (r.n, r.text) for r in X.item_windows(spark.createDataFrame(centers, "id long, doc string, pos long"), spark.createDataFrame(items, ITEMS).repartition(5), 3, 2, 150).collect()}
    for k, doc, pos in centers:
        near = [] if pos is None else [(i, p, clean(t)) for d, p, i, t in items if d == doc and pos - 3 <= i <= pos + 2 and clean(t)]
        text = " ".join(f"[item {i} page {'' if p is None else p}] {t}" for i, p, t in near)
        assert got[k] == (len(near), cut(text, 150))


def test_a_hot_page_is_gathered_within_its_budget(spark):
    """Of a page with very many items no more is collected than its budget takes."""
    items = spark.range(30_000).selectExpr("'d' AS doc", "0L AS page", "id AS pos", "'a text of some length' AS text")
    centers = spark.createDataFrame([(1, "d", 0)], "id long, doc string, page long")
    got = X.page_contexts(centers, items, 100).first()
    assert got.pages == [0] and len(got.text) == 100 and got.text.endswith("...")


def test_lines_of_many_splits(spark, tmp_path):
    lines = {"one": [f"line {i} " + "x" * (i % 50) for i in range(20_000)], "two": ["", "a", "", "b"], "none": []}
    for name, rows in lines.items():
        (tmp_path / f"{name}.txt").write_text("".join(f"{r}\n" for r in rows))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        found = io.numbered_lines(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() >= 1
        splits = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        got = sorted((r.file.rsplit("/", 1)[1], r.line, r.value) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert splits > 10
    assert got == sorted((f"{name}.txt", i, v) for name, rows in lines.items() for i, v in enumerate(rows))
