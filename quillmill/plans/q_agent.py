"""Queries: decisions and answers of models, evidence, agent loops, leaks and batch search. Replies are planted by id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import agent as A
from ..operators import search as S
from ..sources import io
from . import q_search as QS
from .base import fixture, plain, query

REPLY = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"keep": [2, 0, 9, 2], "action": "accept", "reason": "r"}' WHEN 1 THEN 'so: {"keep": ["1", "x", -1], "action": "REWRITE", "rewrite_query": "q1"} done {}'
WHEN 2 THEN '{"keep": [1, ' WHEN 3 THEN '' WHEN 4 THEN '{"action": "DROP", "reason": "{x}"}' ELSE '<think>{"keep": [3]}</think>{"keep": [0]}' END AS t FROM T_documents"""


def _list(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("parse_action", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '0,2' WHEN 1 THEN '1' WHEN 5 THEN '0' ELSE '' END AS keep, CASE doc_id % 6 WHEN 0 THEN '1,3' WHEN 1 THEN '0,2,3' WHEN 5 THEN '1,2,3' ELSE '0,1,2,3' END AS dropped, CASE WHEN doc_id % 6 = 1 THEN 'REWRITE' ELSE 'ACCEPT' END AS action, CASE WHEN doc_id % 6 = 1 THEN 'q1' ELSE '' END AS rewrite_query, doc_id % 6 NOT IN (2, 3) AS parsed FROM documents")
def parse_action(spark, sf):
    d = fixture(spark, sf, REPLY).select("doc_id", A.parse_action(F.col("t"), F.lit(4)).alias("a"))
    return d.select("doc_id", _list("a.keep").alias("keep"), _list("a.drop").alias("dropped"), "a.action", "a.rewrite_query", "a.parsed")


@query("first_json_object", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '{"keep": [2, 0, 9, 2], "action": "accept", "reason": "r"}' WHEN 1 THEN '{"keep": ["1", "x", -1], "action": "REWRITE", "rewrite_query": "q1"}' WHEN 2 THEN '{"keep": [1, ' WHEN 3 THEN '' WHEN 4 THEN '{"action": "DROP", "reason": "{x}"}' ELSE '{"keep": [3]}' END AS body FROM documents""")
def first_json_object(spark, sf):
    return fixture(spark, sf, REPLY).select("doc_id", A.first_object(F.col("t")).alias("body"))


_ANSWER = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'It is (C), not B' WHEN 1 THEN 'Dx none' WHEN 2 THEN 'nothing here' WHEN 3 THEN '' ELSE 'so e' END AS t FROM T_documents"


@query("answer_parsers", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'D' ELSE '' END AS anywhere, CASE doc_id % 5 WHEN 0 THEN 'B' WHEN 1 THEN 'D' WHEN 2 THEN 'E' WHEN 3 THEN '' ELSE 'E' END AS holds FROM documents")
def answer_parsers(spark, sf):
    letters = F.array(*map(F.lit, ("B", "D", "E")))
    return fixture(spark, sf, _ANSWER).select("doc_id", A.answer_anywhere(F.col("t")).alias("anywhere"), A.answer_substring(F.col("t"), letters).alias("holds"))


_ASK = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '答案是 B' WHEN 1 THEN '最终答案' WHEN 2 THEN '答案BC' WHEN 3 THEN '胃窦息肉' WHEN 4 THEN NULL ELSE '答案：b' END AS q FROM T_documents"


@query("hard_leakage", "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS hard, CASE doc_id % 6 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 3 THEN 0.2 ELSE 0.0 END::DOUBLE AS penalty FROM documents")
def hard_leakage(spark, sf):
    d = fixture(spark, sf, _ASK).withColumn("h", A.states_answer(F.col("q"), F.lit(" b")))
    return d.select("doc_id", F.col("h").cast("double").alias("hard"), F.coalesce(A.leakage(F.coalesce("q", F.lit("")), F.lit("息肉"), F.col("h")), F.lit(0.0)).alias("penalty"))


@query("action_reward", "SELECT doc_id, round(b - CASE WHEN doc_id % 6 IN (2, 3) THEN 0.5 ELSE 0 END, 6) AS reward FROM (SELECT doc_id, (h - o) + 0.5 * h - 0.05 * greatest(0, (length(text) - 120) / 400.0) AS b FROM (SELECT doc_id, text, (doc_id % 2)::DOUBLE AS h, (doc_id % 3 = 0)::INT::DOUBLE AS o FROM documents))")
def action_reward(spark, sf):
    d = fixture(spark, sf, "SELECT doc_id, text FROM T_documents").join(fixture(spark, sf, REPLY), "doc_id")
    a = A.parse_action(F.col("t"), F.lit(4))
    base = A.reward(F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 1, F.col("text"), F.lit(0.0), F.lit(True), a["action"])
    return d.select("doc_id", F.round(A.action_reward(base, a["parsed"]), 6).alias("reward"))


@query("target_build", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"keep":[0,2],"drop":[1,3],"action":"ACCEPT","rewrite_query":""}' WHEN 1 THEN '{"keep":[],"drop":[0,1,2,3],"action":"REWRITE","rewrite_query":"' || lang || '"}' END AS target FROM documents""")
def target_build(spark, sf):
    m = F.col("doc_id") % 3
    action, text = F.when(m == 0, "ACCEPT").otherwise("REWRITE"), F.when(m == 1, F.col("lang")).otherwise("")
    keep = F.array(*[F.lit(x) for x in (2, 0, 7, 2)])
    return fixture(spark, sf, "SELECT doc_id, lang FROM T_documents").select("doc_id", A.target(action, keep, text, F.lit(4)).alias("target"))


@query("agg_ctrl_eval", f"WITH r AS (SELECT doc_id, doc_id % 6 AS m FROM documents), x AS (SELECT m, CASE m WHEN 0 THEN [0, 2] WHEN 1 THEN [1] WHEN 5 THEN [0] ELSE [] END AS p, CASE WHEN doc_id % 4 = 0 THEN [] ELSE [0, 1] END AS t, CASE WHEN m = 1 THEN 'REWRITE' ELSE 'ACCEPT' END = CASE WHEN doc_id % 3 = 1 THEN 'REWRITE' ELSE 'ACCEPT' END AS same FROM r), s AS (SELECT count(*) AS n, avg((m NOT IN (2, 3))::INT) AS parse_ok, avg((p = t)::INT) AS keep_exact, sum(len(list_intersect(p, t))) AS tp, sum(len(p)) AS np, sum(len(t)) AS nt, avg(same::INT) AS action_acc FROM x) SELECT n, round(parse_ok, 6) AS parse_ok, round(keep_exact, 6) AS keep_exact, round(tp / np, 6) AS keep_prec, round(tp / nt, 6) AS keep_rec, round(2 * tp / (np + nt), 6) AS keep_f1, round(action_acc, 6) AS action_acc FROM s")
def agg_ctrl_eval(spark, sf):
    a = A.parse_action(F.col("t"), F.lit(4))
    true = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = fixture(spark, sf, REPLY).select(a["keep"].alias("pred_keep"), true.alias("true_keep"), a["action"].alias("pred_action"), F.when(F.col("doc_id") % 3 == 1, "REWRITE").otherwise("ACCEPT").alias("true_action"), a["parsed"].alias("parsed"))
    s = A.controller_scores(rows)
    return s.select("n", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


_TURNS = "SELECT conv_id AS qid, turn AS pos, md5(CASE WHEN length(text) > 40 THEN substr(text, 1, 40) ELSE role END) AS candidate_id FROM T_conversations"


@query("dedup_evidence_cap", f"WITH p AS ({plain(_TURNS)}), f AS (SELECT qid, candidate_id, min(pos) AS pos FROM p GROUP BY 1, 2), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS r FROM f) WHERE r <= 4) SELECT p.qid, count(DISTINCT k.candidate_id) AS n_added, count(k.candidate_id) - count(DISTINCT k.candidate_id) AS n_dup FROM p LEFT JOIN k USING (qid, candidate_id) GROUP BY 1")
def dedup_evidence_cap(spark, sf):
    return A.merge_evidence(fixture(spark, sf, _TURNS), 4)[1]


@query("evidence_filter", f"WITH {QS.RUNS} SELECT qid, docid FROM a WHERE CASE WHEN qid % 100 = 0 THEN rank IN (2, 4) ELSE rank <= 5 END")
def evidence_filter(spark, sf):
    """A model names hits 2, 4 and 99 of every second query, nothing valid of the others."""
    hits = QS.run(spark, sf)
    picks = hits.select("qid").distinct().select("qid", F.explode(F.when(F.col("qid") % 100 == 0, F.array(F.lit(2), F.lit(4), F.lit(99))).otherwise(F.array(F.lit(99)))).alias("number"))
    return A.choose_evidence(hits, picks).select("qid", "docid")


@query("final_evidence", f"WITH {QS.RUNS}, m AS (SELECT qid, docid, 0 AS part, rank AS pos FROM a WHERE rank IN (3, 7, 9)), t5 AS (SELECT qid, docid, 1 AS part, rank AS pos FROM a WHERE rank <= 5), f AS (SELECT qid, docid, min(part * 1000 + pos) AS p FROM (SELECT * FROM m UNION ALL SELECT * FROM t5) GROUP BY 1, 2) SELECT * FROM (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY p, docid) AS pos FROM f) WHERE pos <= 5")
def final_evidence(spark, sf):
    a = QS.run(spark, sf)
    return A.final_evidence(a.where("rank in (3, 7, 9)").select("qid", "docid", F.col("rank").alias("pos")), a)


def scripted(d):
    """A stand-in for the model: keeps ids divisible by 3, rewrites every second query in its first two rounds, and fails to parse on every third."""
    n = F.col("qid") / 50
    action = F.when((n % 2 == 1) & (F.col("round_idx") < 2), "REWRITE").otherwise("ACCEPT")
    return d.withColumns({"kept": F.col("docid") % 3 == 0, "action": action, "parsed": ~((n % 3 == 2) & (F.col("round_idx") == 1))})


@query("multiround_eval")
def multiround_eval(spark, sf):
    return A.solve_rounds(QS.run(spark, sf), scripted)


@query("rescue_3round")
def rescue_3round(spark, sf):
    """Three rounds whatever the model says; only the last may end."""
    return A.solve_rounds(QS.run(spark, sf), scripted, forced=2)


_CALLS = "SELECT user_id AS qid, event_id AS step, CASE WHEN event_type = 'purchase' THEN 'submit' WHEN event_id % 3 = 0 THEN 'think' ELSE 'search' END AS tool, event_id % 5 > 0 AS ok FROM T_events"


@query("harness_solve", f"WITH c AS (SELECT *, row_number() OVER w AS calls, sum((tool = 'search')::INT) OVER w AS searches, max((tool = 'submit' AND ok)::INT) OVER w AS stop FROM ({plain(_CALLS)}) WINDOW w AS (PARTITION BY qid ORDER BY step ROWS UNBOUNDED PRECEDING)), l AS (SELECT *, lag(calls) OVER v AS pc, lag(searches) OVER v AS ps, lag(stop) OVER v AS pt FROM c WINDOW v AS (PARTITION BY qid ORDER BY step)) SELECT qid, count(*) AS n_calls, max(searches) AS n_rounds, count(*) FILTER (WHERE NOT ok) AS n_failed, CASE WHEN max(stop) = 1 THEN 'submitted' ELSE 'budget_exhausted' END AS finish_reason FROM l WHERE coalesce(pt, 0) = 0 AND coalesce(pc, 0) < 12 AND coalesce(ps, 0) < 6 GROUP BY 1")
def harness_solve(spark, sf):
    return A.tool_loop(fixture(spark, sf, _CALLS), 6, 12)


_LEAK = f"{QS._ranked('l', QS.DOT, 40, 'true')}, h AS (SELECT qid, docid, rank, docid = qid AS s, docid <> qid AND docid // 2 = qid // 2 AS b, label FROM l JOIN embeddings e ON e.vec_id = l.docid)"


def _leaks(spark, sf):
    hits = S.dense_search(QS.queries(spark, sf), QS.corpus(spark, sf), 40)
    hits = hits.withColumns({"sample_id": F.col("docid"), "image_path": F.lit(""), "doc_id": F.floor(F.col("docid") / 2)})
    own = QS.queries(spark, sf).select("qid", F.col("qid").alias("sample_id"), F.lit("").alias("image_path"), F.floor(F.col("qid") / 2).alias("doc_id"))
    return hits, *S.leak_filter(hits, own)


@query("leak_filter", f"WITH {_LEAK} SELECT qid, count(*) FILTER (WHERE s) AS n_self, count(*) FILTER (WHERE b) AS n_book, count(*) FILTER (WHERE NOT s AND NOT b) AS n_left FROM h GROUP BY 1")
def leak_filter(spark, sf):
    _, left, counts = _leaks(spark, sf)
    return counts.join(left.groupBy("qid").agg(F.count(F.lit(1)).alias("n_left")), "qid")


@query("agg_leak_report", f"WITH {_LEAK}, q AS (SELECT qid, count(*) FILTER (WHERE s) AS s, count(*) FILTER (WHERE b) AS b, avg((docid % 2)::INT) FILTER (WHERE NOT s AND NOT b) AS ratio FROM h GROUP BY 1) SELECT count(*) AS n_questions, count(*) FILTER (WHERE s > 0) AS with_self, count(*) FILTER (WHERE b > 0) AS with_book, round(avg(ratio), 4) AS text_ratio, CASE WHEN round(avg(ratio), 4) > 0.3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM q")
def agg_leak_report(spark, sf):
    """Questions with hits of their own before the filter, none may be left after it; odd ids count as text."""
    _, left, counts = _leaks(spark, sf)
    after = left.groupBy("qid").agg(F.avg((F.col("docid") % 2).cast("double")).alias("ratio"), F.count_if(F.col("docid") == F.col("qid")).alias("bad"))
    t = counts.join(after, "qid").agg(F.count(F.lit(1)).alias("n_questions"), F.count_if(F.col("n_self") > 0).alias("with_self"), F.count_if(F.col("n_book") > 0).alias("with_book"), F.round(F.avg("ratio"), 4).alias("text_ratio"), F.sum("bad").alias("bad"))
    return t.select("n_questions", "with_self", "with_book", "text_ratio", F.when((F.col("bad") == 0) & (F.col("text_ratio") > 0.3), "PASS").otherwise("FAIL").alias("verdict"))


_SIDES = f"{QS.SPARSE}, {QS._ranked('dense', QS.DOT, 30)}, z AS (SELECT qid, docid, CASE WHEN sd < 1e-6 THEN score ELSE (score - m) / sd END AS s FROM (SELECT *, stddev_pop(score) OVER (PARTITION BY qid) AS sd, avg(score) OVER (PARTITION BY qid) AS m FROM sparse))"


def _batch_sql(wd: str, ws: str, sides: str) -> str:
    return f"WITH {_SIDES}, f AS (SELECT qid, docid, CASE WHEN qid IN (SELECT qid FROM sparse) THEN {wd} ELSE 1.0 END * coalesce(d.score, 0) + CASE WHEN qid IN (SELECT qid FROM sparse) THEN {ws} ELSE 0.0 END * coalesce(z.s, 0) AS score FROM {sides}) SELECT * FROM (SELECT qid, docid, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, docid) AS rank FROM f) WHERE rank <= 15"


def _batch(spark, sf, **k):
    sparse = QS.sparse_hits(spark, sf, 20)
    has = sparse.select("qid").distinct().withColumn("has_terms", F.lit(True))
    q = QS.queries(spark, sf).select("qid").join(has, "qid", "left").select("qid", F.lit("en").alias("lang"), F.coalesce("has_terms", F.lit(False)).alias("has_terms"))
    got = S.hybrid_batch(QS.run(spark, sf, 30), sparse, q, 15, **k)
    return got.select("qid", "docid", F.round("score", 6).alias("score"), "rank")


@query("hybrid_batch", _batch_sql("0.55", "0.45", "dense d FULL JOIN z USING (qid, docid)"))
def hybrid_batch(spark, sf):
    """Separate depths (30 dense, 20 sparse); English queries adapt both weights."""
    return _batch(spark, sf, adapt={"en": 0.45, "zh": 0.3})


@query("hybrid_batch_sparse", _batch_sql("0.0", "1.0", "(SELECT qid, docid, NULL::DOUBLE AS score FROM z) d JOIN z USING (qid, docid)"))
def hybrid_batch_sparse(spark, sf):
    return _batch(spark, sf, mode="sparse")


@query("hybrid_batch_override", _batch_sql("0.8", "0.45", "dense d FULL JOIN z USING (qid, docid)"))
def hybrid_batch_override(spark, sf):
    """An override with adaptation on: the sparse weight is replaced, the dense one is not."""
    return _batch(spark, sf, override=(0.8, 0.2), adapt={"en": 0.45})




@query("hybrid_rescore", f"WITH {QS.SPARSE}, {QS._ranked('dense', QS.DOT, 20)}, pool AS (SELECT qid, docid FROM sparse JOIN embeddings e ON e.vec_id = sparse.docid UNION SELECT qid, docid FROM dense), d AS (SELECT p.qid, p.docid, list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS dense FROM pool p JOIN embeddings q ON q.vec_id = p.qid JOIN embeddings v ON v.vec_id = p.docid), s AS (SELECT d.qid, d.docid, sum(qv.weight * post.weight) AS sparse FROM d JOIN qv ON qv.qid = d.qid JOIN post ON post.docid = d.docid AND post.token = qv.token GROUP BY 1, 2) SELECT * FROM (SELECT qid, docid, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, docid) AS rank FROM (SELECT qid, docid, 0.75 * dense + 0.25 * coalesce(sparse, 0) AS score FROM d LEFT JOIN s USING (qid, docid))) WHERE rank <= 20")
def hybrid_rescore(spark, sf):
    """Exact scores of both kinds over the union of both sides' candidates; weights 3 and 1 made to sum to 1."""
    t = QS.terms(spark, sf)
    stats, w = QS.weights(spark, sf, t)
    qv = S.query_vectors(QS.query_tokens(spark, sf), w)
    sparse = QS.sparse_hits(spark, sf, 20, t).select("qid", "docid").join(QS.corpus(spark, sf).select("docid"), "docid", "left_semi").select("qid", "docid")
    pool = io.written(sparse.unionByName(QS.run(spark, sf, 20).select("qid", "docid")), "pool")
    # only the pool's documents are weighed, by the statistics of all
    post = S.bm25_vectors(t.join(pool.select("docid").distinct(), "docid", "left_semi"), w, stats)
    got = S.rescore(pool, QS.queries(spark, sf), QS.corpus(spark, sf), qv, post, 3.0, 1.0, 20)
    return got.select("qid", "docid", F.round("score", 6).alias("score"), "rank")


@query("weights_normalize", "SELECT user_id, round(CASE WHEN a + b = 0 THEN 1.0 ELSE a / (a + b) END, 6) AS wd, round(CASE WHEN a + b = 0 THEN 0.0 ELSE b / (a + b) END, 6) AS ws FROM (SELECT DISTINCT user_id, greatest(user_id % 5 - 2, 0)::DOUBLE AS a, greatest(user_id % 3 - 1, 0)::DOUBLE AS b FROM events)")
def weights_normalize(spark, sf):
    u = fixture(spark, sf, "SELECT DISTINCT user_id FROM T_events")
    grid = spark.createDataFrame([(a, b, *S.normalize_weights(float(a), float(b))) for a in range(-2, 3) for b in range(-1, 2)], "a int, b int, wd double, ws double")
    x = u.join(F.broadcast(grid), (F.col("user_id") % 5 - 2 == F.col("a")) & (F.col("user_id") % 3 - 1 == F.col("b")))
    return x.select("user_id", F.round("wd", 6).alias("wd"), F.round("ws", 6).alias("ws"))


_NORM = "CASE WHEN hi - lo < 1e-12 THEN 0.0 ELSE (score - lo) / (hi - lo) END"


@query("win_norm_select", f"WITH {QS.RUNS}, x AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(score) OVER w AS m, stddev_pop(score) OVER w AS sd FROM a WINDOW w AS (PARTITION BY qid)) SELECT 'none' AS method, qid, docid, round(score, 6) AS norm FROM x UNION ALL SELECT 'minmax', qid, docid, round({_NORM}, 6) FROM x UNION ALL SELECT 'zscore', qid, docid, round((score - m) / sd, 6) FROM x")
def win_norm_select(spark, sf):
    a, out = QS.run(spark, sf), None
    for m in ("none", "minmax", "zscore"):
        x = S.norm_select(a, m).select(F.lit(m).alias("method"), "qid", "docid", F.round("norm", 6).alias("norm"))
        out = x if out is None else out.unionByName(x)
    return out


@query("topk_overfetch", f"WITH {QS.RUNS}, g AS (SELECT *, row_number() OVER (PARTITION BY qid, docid // 4 ORDER BY rank) AS n FROM a WHERE rank <= 20) SELECT * FROM (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM g WHERE n = 1) WHERE rank <= 4")
def topk_overfetch(spark, sf):
    return S.over_fetched(QS.run(spark, sf).withColumn("g", F.floor(F.col("docid") / 4)), 4, "g").select("qid", "docid", "rank")


@query("scalar_filter", f"WITH {QS._ranked('l', QS.DOT, 10, 'v.vec_id <> q.vec_id AND v.label = q.label')} SELECT qid, docid, rank FROM l")
def scalar_filter(spark, sf):
    """The filter holds before scoring: all ten hits meet it."""
    lab = fixture(spark, sf, "SELECT vec_id, label FROM T_embeddings")
    q = QS.queries(spark, sf).join(lab.select(F.col("vec_id").alias("qid"), F.col("label").alias("same")), "qid")
    c = QS.corpus(spark, sf).join(lab.select(F.col("vec_id").alias("docid"), F.col("label").alias("same")), "docid")
    return S.dense_search(q, c, 10, not_self=True, same="same").select("qid", "docid", "rank")


@query("dual_retrieve", f"WITH {QS.RUNS} SELECT qid, 'text' AS origin, docid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM a WHERE rank <= 8 UNION ALL SELECT qid, 'image', docid, 8 + row_number() OVER (PARTITION BY qid ORDER BY rank) FROM b WHERE rank <= 4")
def dual_retrieve(spark, sf):
    """Text hits, then image hits: concatenated, not merged."""
    a, b = QS.run(spark, sf, 8), QS.run(spark, sf, 4, part=16)
    put = lambda d, origin, base: d.select("qid", F.lit(origin).alias("origin"), "docid", (F.col("rank") + base).alias("pos"))
    return put(a, "text", 0).unionByName(put(b, "image", 8))


@query("batch_with_errors", f"WITH {QS.RUNS} SELECT vec_id AS query_idx, CASE WHEN vec_id % 100 = 0 THEN 'empty query' END AS error, CASE WHEN vec_id % 100 = 0 THEN NULL ELSE h END AS hits FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q LEFT JOIN (SELECT qid, string_agg(docid, ',' ORDER BY rank) AS h FROM a WHERE rank <= 3 GROUP BY 1) x ON x.qid = q.vec_id")
def batch_with_errors(spark, sf):
    from ..sources import io

    requests = QS.queries(spark, sf).select(F.col("qid").alias("query_idx"), F.when(F.col("qid") % 100 != 0, F.col("qvec")).alias("qvec"))

    def search(r):
        hits = S.dense_search(r.select(F.col("query_idx").alias("qid"), "qvec"), QS.corpus(spark, sf), 3, not_self=True)
        return hits.groupBy("qid").agg(_list(F.transform(F.sort_array(F.collect_list(F.struct("rank", "docid"))), lambda h: h["docid"])).alias("hits")).withColumnRenamed("qid", "query_idx")

    return io.replay_requests(requests, search, F.col("qvec").isNotNull(), F.lit("empty query"))


@query("offline_replay", f"WITH {QS.RUNS} SELECT qid AS query_idx, string_agg(docid, ',' ORDER BY rank) AS hits FROM a WHERE rank <= 5 GROUP BY 1")
def offline_replay(spark, sf):
    """Requests of a JSONL file answered into another, aligned by query_idx, and read back."""
    from ..sources import io

    path = io.scratch(spark, "replay")
    QS.queries(spark, sf).select(F.col("qid").alias("query_idx"), F.col("qvec").cast("array<double>").alias("qvec")).write.json(f"{path}/in")
    r = spark.read.schema("query_idx long, qvec array<double>").json(f"{path}/in")
    hits = S.dense_search(r.select(F.col("query_idx").alias("qid"), "qvec"), QS.corpus(spark, sf), 5, not_self=True)
    hits.groupBy(F.col("qid").alias("query_idx")).agg(_list(F.transform(F.sort_array(F.collect_list(F.struct("rank", "docid"))), lambda h: h["docid"])).alias("hits")).write.json(f"{path}/out")
    return spark.read.schema("query_idx long, hits string").json(f"{path}/out")


@query("fetch_by_keys", f"WITH {QS.RUNS} SELECT DISTINCT docid, label FROM a JOIN embeddings e ON e.vec_id = a.docid WHERE rank <= 5")
def fetch_by_keys(spark, sf):
    """Rows of the keys that a run names: a semi-join, no chunked lists."""
    keys = QS.run(spark, sf, 5).select(F.col("docid").alias("vec_id")).distinct()
    return fixture(spark, sf, "SELECT vec_id, label FROM T_embeddings").join(keys, "vec_id", "left_semi").select(F.col("vec_id").alias("docid"), "label")


@query("threshold_grid", "SELECT round(0.5 - 0.06 + 0.01 * i, 6)::DOUBLE AS tau FROM range(13) t(i)")
def threshold_grid(spark, sf):
    """Centre 0.5, span 0.06, step 0.01."""
    return spark.range(13).select(F.round(F.lit(0.5) - 0.06 + 0.01 * F.col("id"), 6).alias("tau"))


@query("explode_states", "SELECT conv_id, turn, n FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, turn) AS n, CASE conv_id % 3 WHEN 0 THEN 'trivial' WHEN 1 THEN 'rewrite' ELSE 'bad' END AS tier FROM conversations WHERE length(text) > 0) WHERE tier = 'rewrite'")
def explode_states(spark, sf):
    """One state for each round with candidates, of trajectories of a tier."""
    c = fixture(spark, sf, "SELECT conv_id, turn, text, CASE conv_id % 3 WHEN 0 THEN 'trivial' WHEN 1 THEN 'rewrite' ELSE 'bad' END AS tier FROM T_conversations")
    traj = c.groupBy("conv_id", "tier").agg(F.collect_list(F.struct("turn", "text")).alias("rounds"))
    return traj.where("tier = 'rewrite'").select("conv_id", F.explode("rounds").alias("r")).where("length(r.text) > 0").select("conv_id", "r.turn").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conv_id", "turn")))


@query("rewrite_recall", f"WITH {QS.RUNS}, m AS (SELECT qid, k, CASE WHEN k % 2 = 0 THEN qid ELSE (qid + 50) % (SELECT max(vec_id) // 50 * 50 + 50 FROM embeddings) END AS rq FROM (SELECT vec_id AS qid FROM embeddings WHERE vec_id % 50 = 0), range(3) t(k)) SELECT m.qid, k, docid, rank FROM m JOIN a ON a.qid = m.rq WHERE rank <= 4")
def rewrite_recall(spark, sf):
    """Candidates for each member's rewrite: one search for each distinct query, joined back to the members that share it."""
    top = fixture(spark, sf, "SELECT max(vec_id) DIV 50 * 50 + 50 AS m FROM T_embeddings").first()[0]
    m = QS.queries(spark, sf).select("qid", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    m = m.withColumn("rq", F.when(F.col("k") % 2 == 0, F.col("qid")).otherwise((F.col("qid") + 50) % top))
    q = m.select(F.col("rq").alias("qid")).distinct().join(QS.queries(spark, sf), "qid")
    hits = S.dense_search(q, QS.corpus(spark, sf), 4, not_self=True).select(F.col("qid").alias("rq"), "docid", "rank")
    return m.join(hits, "rq").select("qid", "k", "docid", "rank")


@query("round2_apply", f"WITH {QS.RUNS} SELECT qid, docid FROM a WHERE rank <= 6 AND CASE WHEN qid % 100 = 0 THEN rank IN (1, 3) ELSE false END")
def round2_apply(spark, sf):
    """A second round's keep, by place from 0, applied to the candidates recalled; replies that do not parse keep nothing."""
    reply = F.when(F.col("qid") % 100 == 0, '{"keep": [0, 2, 8], "action": "ACCEPT"}').otherwise("{broken")
    hits = QS.run(spark, sf, 6)
    acts = QS.queries(spark, sf).select("qid", A.parse_action(reply, F.lit(6)).alias("a")).select("qid", F.explode("a.keep").alias("i"))
    return hits.join(acts, (hits["qid"] == acts["qid"]) & (hits["rank"] == acts["i"] + 1)).select(hits["qid"], "docid")


@query("rebuild_observations", f"WITH {QS.RUNS} SELECT qid, 'image' AS origin, docid, rank AS pos FROM b WHERE rank <= 2 UNION ALL SELECT qid, 'text', docid, 2 + rank FROM a WHERE rank <= 3")
def rebuild_observations(spark, sf):
    """The first round's window anew: a fixed quota of image hits, then of text hits."""
    put = lambda d, origin, base: d.select("qid", F.lit(origin).alias("origin"), "docid", (F.col("rank") + base).alias("pos"))
    return put(QS.run(spark, sf, 2, part=16), "image", 0).unionByName(put(QS.run(spark, sf, 3), "text", 2))


_GROUP = "SELECT user_id AS qid, event_id AS member_id, value AS reward FROM T_events"


@query("rollout_group", f"SELECT qid, member_id, round((reward - m) / CASE WHEN sd > 1e-6 THEN sd ELSE 1.0 END, 6) AS advantage FROM (SELECT *, avg(reward) OVER (PARTITION BY qid) AS m, stddev_pop(reward) OVER (PARTITION BY qid) AS sd FROM ({plain(_GROUP)}))")
def rollout_group(spark, sf):
    return A.advantages(fixture(spark, sf, _GROUP), "qid").select("qid", "member_id", F.round("advantage", 6).alias("advantage"))


@query("dilution_stats", "WITH g AS (SELECT user_id, max(value) - min(value) AS t, max(value / 2 + event_id % 7) - min(value / 2 + event_id % 7) AS a FROM events GROUP BY 1 HAVING count(*) >= 2) SELECT count(*) AS n, round(avg(t), 6) AS mean_text, round(median(t), 6) AS median_text, round(avg(a), 6) AS mean_all, round(median(a), 6) AS median_all, round(avg((a < t - 1e-6)::INT), 6) AS diluted FROM g")
def dilution_stats(spark, sf):
    """Spread of a group's probabilities with text evidence and with all evidence; the share of groups that all evidence flattens."""
    e = fixture(spark, sf, "SELECT user_id, value AS t, value / 2 + event_id % 7 AS a FROM T_events")
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("k"), (F.max("t") - F.min("t")).alias("t"), (F.max("a") - F.min("a")).alias("a")).where("k >= 2")
    r = lambda c: F.round(c, 6)
    return g.agg(F.count(F.lit(1)).alias("n"), r(F.avg("t")).alias("mean_text"), r(F.percentile("t", 0.5)).alias("median_text"), r(F.avg("a")).alias("mean_all"), r(F.percentile("a", 0.5)).alias("median_all"), r(F.avg((F.col("a") < F.col("t") - 1e-6).cast("int"))).alias("diluted"))


@query("mixed_only", f"WITH {QS.RUNS}, x AS (SELECT * FROM a WHERE rank <= 2) SELECT qid, docid FROM x WHERE qid IN (SELECT qid FROM x GROUP BY 1 HAVING count(DISTINCT docid % 2) = 2)")
def mixed_only(spark, sf):
    """Only queries with candidates of both channels (odd and even ids)."""
    x = QS.run(spark, sf, 2)
    both = x.groupBy("qid").agg(F.count_distinct(F.col("docid") % 2).alias("c")).where("c = 2").select("qid")
    return x.join(both, "qid", "left_semi").select("qid", "docid")
