"""Fixed cases of single operators."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import agent as A
from quillmill.operators import curate as K
from quillmill.operators import dataset as D
from quillmill.operators import evaluate as E
from quillmill.operators import rerank as R
from quillmill.operators import search as S
from quillmill.sources import io
from quillmill.streaming import ingest


@pytest.mark.parametrize(("b", "c", "p"), [(250, 436, 1.19087e-12), (54, 65, 0.359358), (74, 87, 0.344313), (0, 0, 1.0)])
def test_exact_p(b, c, p):
    assert E.exact_p(b, c) == pytest.approx(p, rel=1e-4)


def test_stage1_reasons(spark):
    texts = ["", " 　 ", "1234", "第三章", "abc/12", "!?!?!?", "图 1", "病例 12", "Copyright 2020 by someone", "胃镜胃镜胃镜", "胃镜胃镜胃镜", "a long enough sentence", "a long enough sentence"]
    rows = [(i, t, 99, t) for i, t in enumerate(texts)]
    got = {r.block_id: r.reason for r in K.stage1_reason(spark.createDataFrame(rows, "block_id long, text string, char_length long, content_hash string")).collect()}
    assert [got[i] for i in range(len(texts))] == ["empty_text", "empty_text", "pure_number", "chapter_only_heading", "catalog_slash_page", "only_symbols", "figure_table_short_caption", "short_label_with_number", "publication_meta", None, None, None, "duplicate_content_hash"]


def test_stage1_normalises_a_text_once_a_branch(spark):
    """A filter on the reason does not bring the text's normalising into every rule."""
    blocks = spark.createDataFrame([(1, "a text", 6, "h")], "block_id long, text string, char_length long, content_hash string")
    plan = K.stage1_reason(blocks).where("reason is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("regexp_replace") <= 2


def test_language_and_ngrams(spark):
    d = spark.createDataFrame([("中文内容很多",), ("plain English",), ("",), ("12345",)], "t string")
    assert [r[0] for r in d.select(T.detect_lang(F.col("t"))).collect()] == ["zh", "en", "mix", "mix"]
    one = spark.range(1).select(T.char_ngrams(F.lit("Ab c!")).alias("a"), T.jaccard(F.array(F.lit("x")), F.array().cast("array<string>")).alias("j"), T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("e")).first()
    assert one.a == ["abc"] and one.j == 0.0 and one.e == 1.0


def test_missing_side_counts_zero_after_normalising(spark):
    a = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0), (1, 3, 1.0)], "qid long, docid long, score double")
    b = spark.createDataFrame([(1, 3, 1.0), (1, 4, 0.5)], "qid long, docid long, score double")
    got = {r.docid: r.score for r in S.hybrid_search(a, b, 10, 0.5, 0.5, "zscore", "zscore").collect()}
    assert got[4] < 0 and got[2] == pytest.approx(0.0)


def test_discriminability():
    assert R.discriminability(np.array([[0.8, 0.2, 0.1, 0.3]]))[0] == pytest.approx(0.5)
    assert R.discriminability(np.array([[0.9, 0.1], [0.5, 0.5]])) == pytest.approx([0.8, 0.0])
    assert len(R.discriminability(np.zeros((0, 4)))) == 0


def test_selections_are_distinct():
    rng = np.random.default_rng(0)
    emb = rng.standard_normal((12, 8))
    emb /= np.linalg.norm(emb, axis=1, keepdims=True)
    source, group = np.arange(12) % 2, np.arange(12) // 2
    picks = [R.greedy(rng.random(12), emb, source, group, 3, 0.2, 0.05, 9.0), R.submodular(emb, source, np.maximum(emb @ emb[:4].T, 0), 3, 1, 0.5, 0.2, 0.5), R.medoids(emb, emb[0], rng.random(12))]
    assert all(len(p) == 3 == len(set(p)) for p in picks)
    restart = np.full(12, 1 / 12)
    assert R.walk(R.graph(emb, source, group, 4, 0.15, 0.45), restart, 0.15, 10).sum() == pytest.approx(1, abs=1e-6)


def test_keep_and_drop(spark):
    a = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    keep, rest = A.keep_and_drop(a(1, 1, 9, -1), a(0), F.lit(3).cast("long"))
    r = spark.range(1).select(keep.alias("k"), rest.alias("r")).first()
    assert (r.k, r.r) == ([1], [0, 2])


def test_split_keys_counts(spark):
    d = spark.range(1000).withColumnRenamed("id", "k")
    got = dict(D.split_keys(d, "k", "s", 0.1).groupBy("split").count().collect())
    assert got == {"val": 100, "train": 900}


def test_json_policies(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nnot json\n{"x": 2}\n')
    assert io.read_json(spark, str(tmp_path), "x int", "drop").count() == 2
    assert [r._corrupt_record for r in io.read_json(spark, str(tmp_path), "x int", "count").collect()].count("not json") == 1
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|FAILED_READ"):
        io.read_json(spark, str(tmp_path), "x int", "raise").collect()


def test_shards_and_manifest(spark, tmp_path):
    m = io.write_shards(spark.range(10).coalesce(1), str(tmp_path / "out"), 4).collect()
    assert sorted(r.n for r in m) == [2, 4, 4]


def test_merge_stream_keeps_the_latest(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    put = lambda n, rows: (src / n).write_text("".join(json.dumps(r) + "\n" for r in rows))
    run = lambda: ingest.merge_stream(spark, str(src), "k int, v int, at int", "k", "at", str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    put("1.json", [{"k": 1, "v": 1, "at": 1}, {"k": 2, "v": 1, "at": 1}])
    run()
    put("2.json", [{"k": 1, "v": 5, "at": 2}, {"k": 2, "v": 9, "at": 0}])
    run()
    run()
    assert sorted((r.k, r.v) for r in ingest.current(spark, str(tmp_path / "t"), "k", "at").collect()) == [(1, 5), (2, 1)]


def test_lag_lead_over_gaps(spark):
    d = spark.createDataFrame([(1, "a"), (5, "b"), (25, "c")], "i long, t string")
    got = [(r.prev, r.next) for r in K.lag_lead(d, "i", "t", 10).orderBy("i").collect()]
    assert got == [("", "b"), ("a", "c"), ("b", "")]


def test_multi_round_agent_against_plain_python(spark):
    import numpy as np

    from quillmill.operators import agent as A
    from quillmill.plans.q_agent import scripted

    rng = np.random.default_rng(2)
    hits = [(q, int(d), float(round(s, 6))) for q in range(0, 600, 50) for d, s in zip(rng.choice(200, 22, replace=False), rng.random(22), strict=True)]
    df = spark.createDataFrame(hits, "qid long, docid long, score double")

    def plain(q, forced):
        pool = sorted(((d, s) for x, d, s in hits if x == q), key=lambda r: (-round(r[1], 9), r[0]))
        retained, n = [], q / 50
        for r in range(3):
            new, pool = pool[:5], pool[5:]
            shown = [d for d, _ in retained] + [d for d, _ in new]
            score = dict(retained + new)
            action = "REWRITE" if n % 2 == 1 and r < 2 else "ACCEPT"
            parsed = not (n % 3 == 2 and r == 1)
            order = sorted(shown, key=lambda d: (-round(score[d], 9), d))
            kept = [d for d in order if d % 3 == 0]
            if (not parsed or action == "ACCEPT" or r == 2) and r >= forced:
                if parsed and action == "ACCEPT":
                    got = kept or order[:5]
                else:
                    got = list(dict.fromkeys([d for d, _ in retained] + order[:5]))[:5]
                return [(q, d, i + 1, r + 1, action) for i, d in enumerate(got)]
            retained = (retained + [(d, score[d]) for d in kept if d not in dict(retained)])[:5]

    for forced in (0, 2):
        want = [x for q in range(0, 600, 50) for x in plain(q, forced)]
        got = [tuple(r) for r in A.solve_rounds(df, scripted, forced=forced).collect()]
        assert sorted(got) == sorted(want)


def test_seed_alignment_stages(spark):
    from quillmill.operators import build as B

    rows = [
        (1, 0, 10, 0.95, 0.3, 0.0), (1, 1, 11, 0.90, 0.35, 0.7), (2, 0, 20, 0.80, 0.1, 0.1), (2, 1, 20, 0.79, 0.1, 0.1), (3, 0, 30, 0.85, 0.1, 0.0), (3, 0, 31, 0.80, 0.1, 0.0), (3, 1, 32, 0.86, 0.1, 0.0),
        (3, 1, 31, 0.79, 0.1, 0.0), (4, 0, 40, 0.5, 0.0, 0.1), (4, 1, 41, 0.6, 0.0, 0.1),
    ]
    got = {r.qid: (r.pk, r.stage, r.reason) for r in B.align_seeds(spark.createDataFrame(rows, "qid long, seed int, pk long, cosine double, char3 double, contain double")).collect()}
    assert got == {1: (11, "A_threshold", "soft_contain+cos+char3"), 2: (20, "B_consensus", "top1"), 3: (31, "B_consensus", "topk"), 4: (41, "C_fallback", "best_score")}


def test_task_quota_and_ranges(spark):
    from quillmill.operators import build as B
    from quillmill.sources import io

    src = spark.range(200).select(F.col("id").alias("source"))
    got = B.task_quota(src, {"a": 6, "b": 4, "c": 3}, "s", 12).collect()
    assert len(got) == 12 and len({r.task for r in got}) == 12
    kinds = [r.kind for r in got]
    assert all(kinds.count(k) <= n for k, n in (("a", 6), ("b", 4), ("c", 3)))
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r.kind)
    assert all(len(v) == len(set(v)) <= 2 for v in by_source.values())
    rows = spark.range(1000).select((F.col("id") * F.col("id")).alias("k"))
    parts = io.bisect_ranges(rows, "k", 90).orderBy("lo").collect()
    assert sum(p.n for p in parts) == 1000 and all(p.n <= 90 for p in parts) and all(a.hi < b.lo for a, b in zip(parts, parts[1:], strict=False))
    pages = io.keyset_pages(rows, "k", 64).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("lo")).orderBy("page").collect()
    assert [p.n for p in pages] == [64] * 15 + [40] and [p.lo for p in pages] == [(64 * i) ** 2 for i in range(16)]


def test_crc_include_is_crc32(spark):
    import zlib

    from quillmill.operators import validate as V

    got = {r.q for r in spark.range(500).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("q")).where(V.included(F.col("q"), 0.3)).collect()}
    assert got == {f"q{i}" for i in range(500) if zlib.crc32(f"q{i}".encode()) % 10000 < 3000}


def test_strict_join_fails_on_a_miss(spark):
    import pytest

    from quillmill.operators import build as B

    a = spark.range(5).select(F.col("id").alias("k"))
    assert B.strict_join(a, a.withColumn("v", F.lit(1)), "k").count() == 5
    with pytest.raises(Exception, match="no row for"):
        B.strict_join(a, a.where("k < 4").withColumn("v", F.lit(1)), "k").collect()


def test_plug_ins(spark):
    from quillmill.operators import plugins as P

    def factory():
        return lambda xs: [[float(len(x)), 1.0] for x in xs]

    rows = spark.createDataFrame([(i, "x" * i) for i in range(200)], "id long, text string")
    got = {r.id: r.vec for r in P.encoded(rows, "text", "lengths", factory, batch=7).collect()}
    assert got == {i: [float(i), 1.0] for i in range(200)}
    cache = rows.where("id < 50").select("id", F.lit(0.5).alias("score"))
    judged = P.only_missing(rows, cache, "id", lambda d: P.scored(d, "text", "judge", lambda: lambda xs: [float(len(x)) for x in xs]).select("id", "score"))
    assert {r.id: r.score for r in judged.collect()} == {i: 0.5 if i < 50 else float(i) for i in range(200)}
    tools = P.Registry()
    tools.add("search", lambda q: [q])
    tools.add("fail", lambda: 1 / 0)
    assert tools.call("search", "a") == (True, ["a"])
    assert tools.call("none") == (False, "unknown tool 'none'; use one of ['fail', 'search']")
    assert tools.call("fail") == (False, "tool execution error: division by zero")


def test_order_statistics_and_parts(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(x)) for g in ("a", "b") for x in np.round(rng.normal(0, 5, 700), 2)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    n = F.col("n")
    got = {r.g: (r.lo, r.mid, r.hi) for r in E.order_statistics(df, ["g"], "v", {"lo": n * 0, "mid": F.floor(n / 2), "hi": n - 1}, cells=16).collect()}
    for g in "abc":
        v = sorted(x for h, x in rows if h == g)
        assert got[g] == (v[0], v[len(v) // 2], v[-1])
    parts = D.greedy_parts(spark.createDataFrame([("f", i, n) for i, n in enumerate([5, 5, 1, 20, 2, 9, 3])], "g string, i int, n int"), "g", "i", "n", 10)
    assert [r.part for r in parts.orderBy("i").collect()] == [0, 0, 1, 2, 3, 4, 5]


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(5)
    rows = [(i, bool(a), bool(b), f"s{i % 3}") for i, (a, b) in enumerate(zip(rng.random(3000) < 0.5, rng.random(3000) < 0.55, strict=True))]
    df = spark.createDataFrame(rows, "key long, a boolean, b boolean, s string")
    d = np.array([r[2] - 0.0 - r[1] for r in rows])
    for strata in (None, ["s"]):
        r = E.paired_bootstrap(df, 2000, strata=strata).first()
        half = 1.96 * d.std() / np.sqrt(len(d))
        assert r.delta == pytest.approx(d.mean()) and r.low == pytest.approx(d.mean() - half, abs=0.1 * half) and r.high == pytest.approx(d.mean() + half, abs=0.1 * half)


def test_stream_parts_are_compacted(spark, tmp_path):
    src, t = tmp_path / "in", str(tmp_path / "t")
    src.mkdir()
    want = {}
    for i in range(7):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"k": k, "v": 10 * i + k, "at": i}) for k in range(i % 3, 4)))
        want |= {k: 10 * i + k for k in range(i % 3, 4)}
        ingest.merge_stream(spark, str(src), "k int, v int, at int", "k", "at", t, str(tmp_path / "c"), compact=2).awaitTermination()
        assert {r.k: r.v for r in ingest.current(spark, t, "k", "at").collect()} == want
    parts = sorted(p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith("."))
    assert parts == ["base=3", "base=5", "delta=4", "delta=5", "delta=6"]


def test_seed_scores_sent_and_joined(spark, monkeypatch):
    """Seeds that are sent to the passages give what the join gives, in one pass without a shuffle."""
    from quillmill.operators import build as B

    rng = random.Random(4)
    word = lambda: rng.choice(["a", "ab", "cde", "fghi", "éa", "x-y", "胃镜", "jk", "lmn", "o’p"])
    text = lambda n: " ".join(word() for _ in range(n))
    seeds = spark.createDataFrame([(q, s, text(rng.randint(0, 6))) for q in range(20) for s in range(2)] + [(90, 0, "- ’"), (91, 0, "")], "qid long, seed int, text string")
    lines = [(i, text(rng.randint(0, 9))) for i in range(300)] + [(500, None), (501, "’ - _"), (502, text(4000))]
    passages = spark.createDataFrame(lines, "pk long, text string").repartition(3)
    joined = sorted(map(tuple, B.seed_scores(seeds, passages, most=0).collect()))
    monkeypatch.setattr(B, "CELLS_HELD", 500)
    monkeypatch.setattr(B, "PAIRS_HELD", 7)
    sent = B.seed_scores(seeds, passages)
    assert sorted(map(tuple, sent.collect())) == joined and len(joined) > 1000
    assert "Join" not in sent._jdf.queryExecution().executedPlan().toString()


def test_bisect_ranges_with_crowded_keys(spark):
    """Ranges of keys that crowd together are those of halving one by one, without a job for each."""
    keys = [10**15 + i for i in range(3000)] + [-(10**15), 5, 5, 5]
    want, todo = [], [(min(keys), max(keys))]
    while todo:
        a, z = todo.pop()
        n = sum(a <= k <= z for k in keys)
        if n > 40 and a < z:
            todo += [(a, (a + z) // 2), ((a + z) // 2 + 1, z)]
        elif n:
            want.append((a, z, n))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("bisect", "bisect")
    try:
        got = [tuple(r) for r in io.bisect_ranges(spark.createDataFrame([(k,) for k in keys], "k long"), "k", 40).collect()]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == sorted(want)
    assert 0 < len(tracker.getJobIdsForGroup("bisect")) < 80


def test_json_values_one_after_another(spark, tmp_path):
    """Several lists in a file, and lines of which the first is broken: nothing that parses is lost."""
    (tmp_path / "lists.json").write_text('[{"a": 1},\n{"a": 2}]\n[{"a": 3}]\n[]\n')
    (tmp_path / "first.json").write_text('{broken\n{"a": 4}\n{"a": 5}\n[broken\n{"a": 6}\n')
    (tmp_path / "one.json").write_text('{\n "b": [\n  [1]\n ],\n "a":\n 7\n}\n')
    assert sorted(r.a for r in io.read_json_any(spark, str(tmp_path), "a long").collect()) == [1, 2, 3, 4, 5, 6, 7]
