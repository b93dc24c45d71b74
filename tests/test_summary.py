"""Quantile sketches: the error of their ranks, merged over grouping sets; distributions and top values."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from quillmill.operators import summary
from quillmill.plans.registry import QUERIES

GIVEN = "/root/testdata/sf0.1"


def test_ranks_of_the_given_lengths(spark):
    rows = spark.read.parquet(f"{GIVEN}/documents.parquet").select("lang", "source", "n_chars").toPandas()
    got = QUERIES["summary_quantiles"](spark, GIVEN).collect()
    assert len(got) == rows.lang.nunique() + rows.source.nunique() + 1
    for r in got:
        own = rows[(rows.lang == r.lang) if r.lang else (rows.source == r.source) if r.source else slice(None)].n_chars.to_numpy()
        assert (r.n, r.lo, r.hi) == (len(own), own.min(), own.max())
        for share, value in ((0.5, r.p50), (0.9, r.p90), (0.99, r.p99)):
            low, high = (own < value).mean(), (own <= value).mean()
            assert low - 0.02 <= share <= high + 0.02


def test_merged_sketches_keep_their_error(spark):
    v = np.random.default_rng(0).lognormal(size=60_000)
    rows = spark.createDataFrame([(i % 97, float(x)) for i, x in enumerate(v)], "k long, v double").repartition(9)
    one = summary.over_sets(rows, ["k"], [[]], "v", {f"q{p}": p / 100 for p in (1, 25, 50, 75, 99)}).first()
    assert one.n == 60_000
    for p in (1, 25, 50, 75, 99):
        assert abs((v <= one[f"q{p}"]).mean() - p / 100) < 0.015


def test_odd_rows(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), (None, 2.0), (None, 2.0)], "k string, v double")
    got = {(r.k, r.n, r.p) for r in summary.over_sets(rows, ["k"], [["k"], []], "v", {"p": 0.5}).collect()}
    assert got == {("a", 1, 1.0), (None, 2, 2.0), (None, 3, 2.0)}
    assert {(r["name"], r["value"], r["n"]) for r in summary.distributions(rows, ["k", "v"]).collect()} == {("k", "a", 2), ("k", None, 2), ("v", "1.0", 1), ("v", "2.0", 2), ("v", None, 1)}
    assert summary.over_sets(rows.limit(0), ["k"], [["k"]], "v", {"p": 0.5}).collect() == []
    with pytest.raises(ValueError, match="grouping"):
        summary.over_sets(rows, ["k"], [], "v", {})


def test_top(spark):
    words = [w for k, w in enumerate("abcdefgh") for _ in range(8 - k // 2)]
    want = sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[:3]
    assert [tuple(r) for r in summary.most_common(spark.createDataFrame([(w,) for w in [*words, None]], "w string"), "w", 3).collect()] == want
