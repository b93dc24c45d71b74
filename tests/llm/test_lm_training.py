"""The language model as the query trains it: rounds, held-out gain at the sizes it ships with, and scores against a plain network."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import lm_scoring
from quillmill.llm.gru import Model

GIVEN = "/root/testdata/sf0.01/documents.parquet"


def per_token(rows, column):
    return sum(r[column] for r in rows) / sum(r.n_tokens for r in rows)


def test_training_helps_at_the_default_sizes(spark):
    docs = spark.read.parquet(GIVEN)
    trained, untrained = ([r for r in lm_scoring.score_documents(docs, rounds=k).collect() if r.held_out] for k in (lm_scoring.ROUNDS, 0))
    base, before, after = per_token(trained, "base_score"), per_token(untrained, "score"), per_token(trained, "score")
    assert after > before + 0.05 and after > base + 0.05


@pytest.mark.parametrize("shards", [1, 2, 3, 55])
def test_every_round_has_rows_of_every_shard(spark, shards):
    marks = spark.range(20_000).select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("mark"))
    got = marks.groupBy(lm_scoring.round_of(shards, 2).alias("round"), F.pmod("mark", F.lit(shards)).alias("shard")).count().collect()
    assert len(got) == 2 * shards and min(r["count"] for r in got) > 20_000 / (2 * shards) / 3


def plain_score(m: Model, doc: list[int]) -> float:
    """A document's log-likelihood, token by token, from the definition."""
    p, w, out = m.p, m.width, 0.0
    h, last = np.zeros(w), 1
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for target in doc:
        gates, turned = p["embed"][last] @ p["wx"] + p["b"], h @ p["wh"]
        z, r = sigmoid(gates[:w] + turned[:w]), sigmoid(gates[w : 2 * w] + turned[w : 2 * w])
        new = np.tanh(gates[2 * w :] + r * turned[2 * w :])
        h = (1 - z) * new + z * h
        c = int(m.of[target])
        a, b = m.bounds[c], m.bounds[c + 1]
        outer, inner = h @ p["wc"] + p["bc"], p["wo"][a:b] @ h + p["bo"][a:b]
        out += outer[c] - np.log(np.exp(outer).sum()) + inner[target - a] - np.log(np.exp(inner).sum())
        last = target
    return float(out)


def test_scores_are_those_of_a_plain_network():
    r = np.random.default_rng(3)
    bounds = np.array([0, 1, 2, 10, 25, 40])
    m = Model(r.integers(1, 50, 40).astype(float), bounds, 8)
    docs = [r.integers(2, 40, n).astype(np.uint16) for n in (1, 7, 90, 300, 33)]
    m.train(docs, 1)
    want = [plain_score(m, d.tolist()) for d in docs]
    assert m.score(docs, 1, lanes=2) == pytest.approx(want, rel=1e-4)


def test_few_long_documents_do_not_make_most_steps():
    """One document is as long as all others together; training still helps the others."""
    r = np.random.default_rng(4)
    order = r.permutation(30) + 2
    follow = dict(zip(order.tolist(), np.roll(order, 1).tolist(), strict=True))

    def chain(n):
        out = [int(r.choice(order))]
        while len(out) < n:
            out.append(follow[out[-1]])
        return np.array(out, np.uint16)

    docs = [chain(40) for _ in range(400)] + [np.full(16_000, 5, np.uint16)]
    counts = np.bincount(np.concatenate(docs), minlength=32).astype(float)
    m = Model(counts, np.array([0, 1, 2, 12, 22, 32]), 12)
    test = [chain(40) for _ in range(20)]
    before = m.score(test, 1).sum()
    m.train(docs, 1)
    assert m.score(test, 1).sum() > before + 20 * math.log(1.2)


def test_scoring_lays_its_weights_out_once(monkeypatch):
    """Weights with their biases are put together once for all windows, and the scores are those of plain softmaxes."""
    rng = np.random.default_rng(5)
    bounds = np.array([0, 1, 2, 7, 20])
    m = Model(rng.integers(1, 50, 20).astype(np.float64), bounds, 6)
    m.load(m.flat() + rng.normal(size=m.flat().size) * 0.3)
    calls, made = [], Model.outputs
    monkeypatch.setattr(Model, "outputs", lambda self: calls.append(1) or made(self))
    docs = [rng.integers(0, 20, n).astype(np.uint16) for n in (70, 3, 40)]
    got = m.score(docs, 1, window=8)
    assert len(calls) == 1
    for d, found in zip(docs, got, strict=True):
        states = m.run(np.append(1, d[:-1])[:, None].astype(np.int64), np.zeros((6, 1), np.float32), np.zeros((len(d), 1), bool))["after"][:, :, 0].astype(np.float64)
        want = 0.0
        for h, t in zip(states, d, strict=True):
            c = int(m.of[t])
            over = h @ m.p["wc"] + m.p["bc"]
            own = m.p["wo"][bounds[c] : bounds[c + 1]] @ h + m.p["bo"][bounds[c] : bounds[c + 1]]
            want += over[c] - np.log(np.exp(over).sum()) + own[t - bounds[c]] - np.log(np.exp(own).sum())
        assert found == pytest.approx(want, rel=1e-4)
