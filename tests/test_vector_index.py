"""The inverted-file index against exact search: recall, exactness with all lists, pruning, blocks, skew and odd tables."""

from __future__ import annotations

import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillmill.operators import search as S
from quillmill.operators import vector_index as V
from quillmill.plans import q_search as QS
from quillmill.sources import io


def pairs(hits):
    return {(r.qid, r.docid) for r in hits.collect()}


def ranked(hits):
    return sorted((r.qid, r.rank, r.docid, round(r.score, 6)) for r in hits.collect())


@pytest.fixture(scope="module")
def clustered(spark):
    """Sixteen clusters, one of which holds a third of the rows, as copies of one vector."""
    r = np.random.default_rng(5)
    centers = r.standard_normal((16, 8)) * 6
    v = centers[np.arange(3000) % 16] + r.standard_normal((3000, 8))
    v[:1000] = centers[3]
    rows = [(i, x.astype(np.float32).tolist()) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "docid long, vec array<float>").repartition(5).cache()


@pytest.fixture(scope="module")
def index(spark, clustered):
    return V.build(clustered, io.scratch(spark, "clustered"), 8, "L2")


def asked(df, every=50):
    return df.where(F.col("docid") % every == 0).select(F.col("docid").alias("qid"), F.col("vec").alias("qvec"))


@pytest.mark.parametrize("metric", ["IP", "L2"])
def test_recall_of_the_default_on_the_given_vectors(spark, metric):
    corpus = QS.corpus(spark, "/root/testdata/sf0.1")
    index = V.build(corpus, io.scratch(spark, "vectors"), 64, metric)
    exact = pairs(S.dense_search(asked(corpus), corpus, 10, metric, not_self=True))
    found = pairs(V.search(index, asked(corpus), 10, not_self=True))
    assert len(exact & found) >= 0.95 * len(exact) and index.nprobe < index.lists


def test_few_lists_of_clusters_are_enough(index, clustered):
    exact, found = pairs(S.dense_search(asked(clustered, 7), clustered, 10, "L2")), pairs(V.search(index, asked(clustered, 7), 10))
    assert len(exact & found) >= 0.95 * len(exact) and index.nprobe <= index.lists // 4


def test_all_lists_are_exact_in_blocks_too(index, clustered):
    queries = asked(clustered, 11)
    want = ranked(S.dense_search(queries, clustered, 7, "L2"))
    assert ranked(V.search(index, queries, 7, index.lists)) == want
    # blocks of few queries: many, and the copies' list split between some
    assert ranked(V.search(index, queries, 7, index.lists, block_bytes=20 * (64 + 8 * index.lists))) == want


def test_products_are_bounded(clustered, monkeypatch):
    queries = asked(clustered, 3)
    want = ranked(S.dense_search(queries, clustered, 5, not_self=True))
    monkeypatch.setattr(S, "PRODUCT_BYTES", 1)
    ids, v = np.arange(30), np.random.default_rng(0).standard_normal((30, 4)).round(1)
    parts = list(S.nearest(ids, v, ids, v, 3, "IP"))
    assert len(parts) == 30
    monkeypatch.undo()
    whole = list(S.nearest(ids, v, ids, v, 3, "IP"))
    assert len(whole) == 1 and np.array_equal(np.concatenate([p[1] for p in parts]), whole[0][1])
    assert ranked(S.dense_search(queries, clustered, 5, not_self=True)) == want


def test_only_probed_lists_are_read(spark, index, clustered):
    one = clustered.where("docid = 1017").select(F.col("docid").alias("qid"), F.col("vec").alias("qvec"))
    hits = V.search(index, one, 5, 1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*list#\d+ = ", plan)
    home = V.probes(one, index.centroids, 1, "L2").first().lists[0]
    assert {r.list for r in index.rows(spark).join(hits.select("docid"), "docid", "left_semi").collect()} == {home}


def test_every_row_is_in_its_nearest_list(spark, index, clustered):
    rows = index.rows(spark).collect()
    assert len(rows) == 3000
    v = np.array([r.vec for r in rows])
    far = ((v[:, None] - index.centroids) ** 2).sum(axis=2)
    assert np.allclose(far[np.arange(3000), [r.list for r in rows]], far.min(axis=1))


def test_long_lists_are_many_files(spark, clustered, monkeypatch):
    monkeypatch.setattr(V, "FILE_ROWS", 100)
    index = V.build(clustered, io.scratch(spark, "files"), 8, "L2", lists=4)
    files = index.rows(spark).withColumn("file", F.input_file_name()).groupBy("list", "file").count().collect()
    assert max(r["count"] for r in files) <= 100 and index.rows(spark).count() == 3000


def test_fit_is_on_a_bounded_sample_and_indexes_all(spark, clustered):
    index = V.build(clustered, io.scratch(spark, "sampled"), 8, "L2", sample=300)
    assert index.rows(spark).count() == 3000 and index.lists <= 55
    assert ranked(V.search(index, asked(clustered), 5, index.lists)) == ranked(S.dense_search(asked(clustered), clustered, 5, "L2"))


def test_found_again_and_checked(spark, index, clustered):
    again = V.ensure(clustered, index.path, 8, "L2")
    assert (again.width, again.metric, again.nprobe) == (8, "L2", index.nprobe) and np.array_equal(again.centroids, index.centroids)
    for width, metric in ((9, "L2"), (8, "IP")):
        with pytest.raises(ValueError, match="width 8 and metric L2"):
            V.ensure(clustered, index.path, width, metric)
    with pytest.raises(ValueError, match="not of width"):
        V.build(clustered, io.scratch(spark, "wide"), 9)


def test_odd_vectors(spark):
    some = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (None, [0.0, 1.0])], "docid long, vec array<float>")
    index = V.build(some, io.scratch(spark, "odd"), 2)
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "qid long, qvec array<float>")
    assert [(r.qid, r.docid) for r in V.search(index, queries, 2, index.lists).collect()] == [(7, 1), (7, 1)]
    none = V.build(some.where("docid = 2"), io.scratch(spark, "none"), 2)
    assert none.lists == 0 and V.search(none, queries, 2).collect() == [] and V.load(spark, none.path).lists == 0
    assert V.search(index, queries.where("qid = 8"), 2).collect() == []


def test_query_recall(spark):
    exact = QS.run(spark, SF, 10)
    found = QS.dense_index_probed(spark, SF)
    assert len(pairs(exact) & pairs(found)) >= 0.95 * exact.count()


def test_products_are_small():
    """Many queries against a whole batch of vectors: what a task holds is bounded well under a product of them all."""
    import tracemalloc

    rng = np.random.default_rng(3)
    asked, v = rng.normal(size=(3000, 8)), rng.normal(size=(10_000, 8))
    ids, docs = np.arange(3000), np.arange(10_000)
    tracemalloc.start()
    got = list(S.nearest(ids, asked, docs, v, 3, "IP"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    q, d = (np.concatenate([x[k] for x in got]) for k in (0, 1))
    assert (q == np.repeat(ids, 3)).all()
    assert all((d[3 * i : 3 * i + 3] == np.argsort(-np.round(asked[i] @ v.T, 9), kind="stable")[:3]).all() for i in range(0, 3000, 500))
