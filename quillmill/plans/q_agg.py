"""Queries: grouped summaries, paired statistics, windows, joins. labels joined to documents stand for per-question results."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import agent as A
from ..operators import curate as K
from ..operators import evaluate as E
from ..operators import summary as Y
from ..operators.running import running_total, same
from .base import query, table

RES = "res AS (SELECT d.doc_id AS qid, d.lang AS scene, d.source AS task, quality = 1 AS a, toxic = 1 AS b, d.n_chars AS n_chars, (d.doc_id * 7919 % 1000) / 1000.0::DOUBLE AS logp, ['ACCEPT', 'REWRITE', 'STOP'][1 + d.doc_id % 3] AS action FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def results(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    x = d.join(table(spark, sf, "labels"), "doc_id")
    act = F.element_at(F.array(*map(F.lit, ("ACCEPT", "REWRITE", "STOP"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return x.select(F.col("doc_id").alias("qid"), F.col("lang").alias("scene"), F.col("source").alias("task"), (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"), "n_chars", (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("logp"), act.alias("action"))


def n():
    return F.count(F.lit(1))


_LEVEL = "CASE WHEN grouping(scene) = 0 AND grouping(task) = 0 THEN 'scene|task' WHEN grouping(scene) = 0 THEN 'scene' WHEN grouping(task) = 0 THEN 'task' ELSE 'overall' END AS level"


@query("agg_accuracy", f"WITH {RES} SELECT scene, task, count(*) AS n, round(avg(a::INT), 6) AS acc, round(avg(logp), 6) AS mean_logp, {_LEVEL} FROM res GROUP BY GROUPING SETS ((), (scene), (task))")
def agg_accuracy(spark, sf):
    return E.by_sets(results(spark, sf), [[], ["scene"], ["task"]], [n().alias("n"), F.round(F.avg(F.col("a").cast("int")), 6).alias("acc"), F.round(F.avg("logp"), 6).alias("mean_logp")])


@query("agg_distribution", f"WITH {RES} SELECT scene, task, count(*) AS n, round(count(*) / (SELECT count(*) FROM res), 6) AS ratio, {_LEVEL} FROM res GROUP BY GROUPING SETS ((scene), (scene, task))")
def agg_distribution(spark, sf):
    r = results(spark, sf)
    total = r.agg(n().alias("total"))
    return E.by_sets(r, [["scene"], ["scene", "task"]], [n().alias("n")]).crossJoin(F.broadcast(total)).withColumn("ratio", F.round(F.col("n") / F.col("total"), 6)).drop("total")


@query("agg_weight_summary", f"WITH {RES} SELECT action, scene, count(*) AS n FROM res GROUP BY GROUPING SETS ((action), (scene), (action, scene))")
def agg_weight_summary(spark, sf):
    return E.by_sets(results(spark, sf), [["action"], ["scene"], ["action", "scene"]], [n().alias("n")]).drop("level")


_ROWS = "SELECT d.doc_id, lang, source, quality, toxic, n_chars // 1000 AS band, length(text) = 0 AS blank, split_part(text, chr(10), 1) AS head, n_chars FROM documents d LEFT JOIN labels USING (doc_id)"
_SIX = ("lang", "source", "quality", "toxic", "band", "blank")


def summary_rows(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select("lang", "source", "quality", "toxic", F.expr("n_chars div 1000").alias("band"), (F.length("text") == 0).alias("blank"), F.split("text", "\n")[0].alias("head"), "n_chars")


@query("summary_distributions", f"WITH r AS ({_ROWS}) " + " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::VARCHAR AS value, count(*) AS n FROM r GROUP BY {c}" for c in _SIX))
def summary_distributions(spark, sf):
    """Six distributions in one pass."""
    return Y.distributions(summary_rows(spark, sf), list(_SIX))


@query("summary_top20", f"SELECT head, count(*) AS n FROM ({_ROWS}) WHERE head IS NOT NULL GROUP BY 1 ORDER BY n DESC, head LIMIT 20")
def summary_top20(spark, sf):
    """The first lines that most documents have: a top-k report."""
    return Y.most_common(summary_rows(spark, sf), "head", 20)


@query("summary_quantiles")
def summary_quantiles(spark, sf):
    """Quantiles by language, by source and of all, from sketches; a test holds the error of their ranks."""
    return Y.over_sets(summary_rows(spark, sf), ["lang", "source"], [["lang"], ["source"], []], "n_chars", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("agg_query_summary", f"WITH {RES} SELECT scene, min(n_chars) AS lo, max(n_chars) AS hi, round(median(n_chars), 6) AS med, (list_sort(list(n_chars)))[1 + least(count(*) - 1, floor(0.9 * count(*))::INT)::INT] AS p90, count(DISTINCT n_chars) AS distinct_n FROM res GROUP BY 1")
def agg_query_summary(spark, sf):
    r, c = results(spark, sf), F.col("n")
    p90 = E.order_statistics(r, ["scene"], "n_chars", {"p90": F.least(c - 1, F.floor(0.9 * c))})
    x = r.groupBy("scene").agg(F.min("n_chars").alias("lo"), F.max("n_chars").alias("hi"), F.round(F.median("n_chars"), 6).alias("med"), F.count_distinct("n_chars").alias("distinct_n"))
    return x.join(p90, "scene")


@query("agg_task_baseline", f"WITH {RES} SELECT scene, task, count(*) AS n, count(*) FILTER (WHERE a) AS correct, round(avg(a::INT), 6) AS acc, round(median(logp), 6) AS median_logp, {_LEVEL} FROM res GROUP BY GROUPING SETS ((scene), (task))")
def agg_task_baseline(spark, sf):
    return E.by_sets(results(spark, sf), [["scene"], ["task"]], [n().alias("n"), F.count_if("a").alias("correct"), F.round(F.avg(F.col("a").cast("int")), 6).alias("acc"), F.round(F.median("logp"), 6).alias("median_logp")])


@query("agg_behavior", f"WITH {RES} SELECT action, count(*) AS n, round(avg(a::INT), 6) AS acc, round(avg(n_chars), 4) AS mean_keep, round(avg((logp < 0.1)::INT), 6) AS parse_fail FROM res GROUP BY 1")
def agg_behavior(spark, sf):
    return results(spark, sf).groupBy("action").agg(n().alias("n"), F.round(F.avg(F.col("a").cast("int")), 6).alias("acc"), F.round(F.avg("n_chars"), 4).alias("mean_keep"), F.round(F.avg((F.col("logp") < 0.1).cast("int")), 6).alias("parse_fail"))


@query("agg_quadrants", f"WITH {RES} SELECT count(*) FILTER (WHERE a AND b) AS cc, count(*) FILTER (WHERE a AND NOT b) AS cw, count(*) FILTER (WHERE NOT a AND b) AS wc, count(*) FILTER (WHERE NOT a AND NOT b) AS ww FROM res")
def agg_quadrants(spark, sf):
    return results(spark, sf).agg(*E.quadrants(F.col("a"), F.col("b")))


_Q = "count(*) FILTER (WHERE a AND b) AS cc, count(*) FILTER (WHERE a AND NOT b) AS cw, count(*) FILTER (WHERE NOT a AND b) AS wc, count(*) FILTER (WHERE NOT a AND NOT b) AS ww"


@query("agg_action_breakdown", f"WITH {RES} SELECT action, {_Q}, round(coalesce(count(*) FILTER (WHERE NOT a AND b) / nullif(count(*) FILTER (WHERE NOT a), 0), 0), 6) AS correction, round(coalesce(count(*) FILTER (WHERE a AND NOT b) / nullif(count(*) FILTER (WHERE a), 0), 0), 6) AS regression FROM res GROUP BY 1")
def agg_action_breakdown(spark, sf):
    x = results(spark, sf).groupBy("action").agg(*E.quadrants(F.col("a"), F.col("b")))
    rate = lambda p, q: F.round(F.when(p + q > 0, p / (p + q)).otherwise(0.0), 6)
    return x.withColumns({"correction": rate(F.col("wc"), F.col("ww")), "regression": rate(F.col("cw"), F.col("cc"))})


@query("agg_clinical", f"WITH {RES} SELECT scene, task, {_Q}, {_LEVEL} FROM res GROUP BY GROUPING SETS ((), (scene), (task), (scene, task))")
def agg_clinical(spark, sf):
    return E.by_sets(results(spark, sf), [[], ["scene"], ["task"], ["scene", "task"]], E.quadrants(F.col("a"), F.col("b")))


@query("agg_cost_stability", f"WITH {RES} SELECT round(avg(1 + qid % 3), 6) AS mean_rounds, round(100.0 * avg((action = 'STOP')::INT), 4) AS fallback_pct, round(100.0 * avg((action = 'ACCEPT')::INT), 4) AS accept_pct FROM res")
def agg_cost_stability(spark, sf):
    pct = lambda c: F.round(100.0 * F.avg(c.cast("int")), 4)
    return results(spark, sf).agg(F.round(F.avg(1 + F.col("qid") % 3), 6).alias("mean_rounds"), pct(F.col("action") == "STOP").alias("fallback_pct"), pct(F.col("action") == "ACCEPT").alias("accept_pct"))


@query("agg_confusion_f1", f"""WITH {RES}, c AS (SELECT unnest([true, false]) AS class), m AS (SELECT class, count(*) FILTER (WHERE a = class) AS n, count(*) FILTER (WHERE b = class) AS np, count(*) FILTER (WHERE a = class AND b = class) AS tp FROM c, res GROUP BY 1),
p AS (SELECT class, n, CASE WHEN np > 0 THEN tp / np ELSE 0.0 END AS precision, CASE WHEN n > 0 THEN tp / n ELSE 0.0 END AS recall FROM m)
SELECT class, n, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1 FROM p""")
def agg_confusion_f1(spark, sf):
    x = E.macro_f1(results(spark, sf), "a", "b")
    return x.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("agg_class_weights", f"WITH {RES} SELECT scene, round((SELECT count(*) FROM res) / (count(*) * (SELECT count(DISTINCT scene) FROM res)), 6) AS weight FROM res GROUP BY 1")
def agg_class_weights(spark, sf):
    c = results(spark, sf).groupBy("scene").agg(n().alias("n"))
    t = c.agg(F.sum("n").alias("total"), n().alias("k"))
    return c.crossJoin(F.broadcast(t)).select("scene", F.round(F.col("total") / (F.col("n") * F.col("k")), 6).alias("weight"))


@query("agg_rank_reference", f"WITH {RES}, s AS (SELECT scene, list_sort(list(logp)) AS v FROM res GROUP BY 1) SELECT scene, len(v) AS n, round(list_avg(v), 6) AS mean, v[1 + round_even((len(v) - 1) * 0.1, 0)::INT] AS p10, v[1 + round_even((len(v) - 1) * 0.5, 0)::INT] AS p50, v[1 + round_even((len(v) - 1) * 0.9, 0)::INT] AS p90 FROM s")
def agg_rank_reference(spark, sf):
    r, c = results(spark, sf), F.col("n")
    at = lambda p: F.bround((c - 1) * F.lit(p).cast("double"), 0)
    q = E.order_statistics(r, ["scene"], "logp", {"p10": at(0.1), "p50": at(0.5), "p90": at(0.9)})
    return r.groupBy("scene").agg(n().alias("n"), F.round(F.avg("logp"), 6).alias("mean")).join(q, "scene")


@query("agg_seq_lengths", f"WITH {RES}, s AS (SELECT list_sort(list(n_chars)) AS v FROM res) SELECT v[1 + least(len(v) - 1, floor(0.5 * len(v))::INT)::INT] AS p50, v[1 + least(len(v) - 1, floor(0.99 * len(v))::INT)::INT] AS p99, len(list_filter(v, lambda x: x > 4096)) AS over_4096 FROM s")
def agg_seq_lengths(spark, sf):
    s = results(spark, sf)
    # exact order statistics by a distributed histogram of lengths, not one sorted array
    h = s.groupBy("n_chars").agg(n().alias("m"))
    w = Window.orderBy("n_chars")
    c = h.withColumn("upto", F.sum("m").over(w)).crossJoin(F.broadcast(s.agg(n().alias("total"))))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(p * F.col("total"))), F.col("n_chars")))
    return c.agg(at(0.5).alias("p50"), at(0.99).alias("p99"), F.sum(F.when(F.col("n_chars") > 4096, F.col("m")).otherwise(0)).alias("over_4096"))


@query("agg_headroom", "WITH g AS (SELECT user_id, max(value) - min(value) AS spread, stddev_pop(value) AS sd FROM events GROUP BY 1) SELECT round(avg(spread), 6) AS mean_spread, round(quantile_cont(spread, 0.5), 6) AS median_spread, round(avg((spread > 50)::INT), 6) AS frac_wide, round(avg(sd), 6) AS mean_sd FROM g")
def agg_headroom(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg((F.max("value") - F.min("value")).alias("spread"), F.stddev_pop("value").alias("sd"))
    return g.agg(F.round(F.avg("spread"), 6).alias("mean_spread"), F.round(F.percentile("spread", 0.5), 6).alias("median_spread"), F.round(F.avg((F.col("spread") > 50).cast("int")), 6).alias("frac_wide"), F.round(F.avg("sd"), 6).alias("mean_sd"))


@query("agg_slope", "SELECT user_id, round(regr_slope(value, event_id), 6) AS slope FROM events GROUP BY 1")
def agg_slope(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.regr_slope("value", "event_id"), 6).alias("slope"))


@query("agg_train_log", "WITH h AS (SELECT event_type, value, ntile(2) OVER (PARTITION BY event_type ORDER BY event_id) AS half FROM events) SELECT event_type, round(avg(value) FILTER (WHERE half = 1), 6) AS early, round(avg(value) FILTER (WHERE half = 2), 6) AS late FROM h GROUP BY 1")
def agg_train_log(spark, sf):
    """The earlier and the later half of each type's records, parted at an order statistic (the earlier one takes the odd one)."""
    e = table(spark, sf, "events").select("event_type", "event_id", "value")
    cut = E.order_statistics(e, ["event_type"], "event_id", {"cut": F.floor((F.col("n") + 1) / 2) - 1})
    h = e.join(cut, "event_type").withColumn("half", F.when(F.col("event_id") <= F.col("cut"), 1).otherwise(2))
    return h.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("half") == 1, F.col("value"))), 6).alias("early"), F.round(F.avg(F.when(F.col("half") == 2, F.col("value"))), 6).alias("late"))


@query("agg_status_counts", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_type FROM events WHERE event_id % 2 = 1) GROUP BY 1")
def agg_status_counts(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return e.where("event_id % 2 = 0").unionByName(e.where("event_id % 2 = 1")).groupBy("event_type").agg(n().alias("n"))


@query("agg_consensus_votes", "SELECT label, vec_id % 50 AS pk, count(DISTINCT vec_id % 7) AS votes, round(avg(vec_id), 6) AS mean_score FROM embeddings GROUP BY 1, 2 HAVING count(DISTINCT vec_id % 7) >= 2")
def agg_consensus_votes(spark, sf):
    e = table(spark, sf, "embeddings").select("label", (F.col("vec_id") % 50).alias("pk"), (F.col("vec_id") % 7).alias("seed"), "vec_id")
    return e.groupBy("label", "pk").agg(F.count_distinct("seed").alias("votes"), F.round(F.avg("vec_id"), 6).alias("mean_score")).where("votes >= 2")


@query("agg_memory_activity", "SELECT turn, count(*) AS n, round(avg(length(text)), 4) AS mean_len, count(*) FILTER (WHERE role = 'assistant') AS n_assistant FROM conversations GROUP BY 1")
def agg_memory_activity(spark, sf):
    return table(spark, sf, "conversations").groupBy("turn").agg(n().alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean_len"), F.count_if(F.col("role") == "assistant").alias("n_assistant"))


@query("agg_harness", f"WITH {RES} SELECT count(*) AS n, round(avg(a::INT) FILTER (WHERE action <> 'STOP'), 6) AS acc_scored, round(avg((action = 'ACCEPT')::INT), 6) AS submit_rate, count(*) FILTER (WHERE action = 'STOP') AS errors FROM res")
def agg_harness(spark, sf):
    return results(spark, sf).agg(n().alias("n"), F.round(F.avg(F.when(F.col("action") != "STOP", F.col("a").cast("int"))), 6).alias("acc_scored"), F.round(F.avg((F.col("action") == "ACCEPT").cast("int")), 6).alias("submit_rate"), F.count_if(F.col("action") == "STOP").alias("errors"))


@query("agg_support_report", f"WITH {RES} SELECT scene, count(*) AS n, count(*) FILTER (WHERE logp > 0.2) AS supported, round(avg((logp > 0.2)::INT), 4) AS rate, CASE WHEN avg((logp > 0.2)::INT) >= 0.6 THEN 'proceed' WHEN avg((logp > 0.2)::INT) < 0.4 THEN 'relax_or_expand' ELSE 'borderline' END AS hint FROM res GROUP BY 1")
def agg_support_report(spark, sf):
    rate = F.avg((F.col("logp") > 0.2).cast("int"))
    return results(spark, sf).groupBy("scene").agg(n().alias("n"), F.count_if(F.col("logp") > 0.2).alias("supported"), F.round(rate, 4).alias("rate"), F.when(rate >= 0.6, "proceed").when(rate < 0.4, "relax_or_expand").otherwise("borderline").alias("hint"))


@query("agg_paper_table", f"WITH {RES} SELECT scene, round(avg(a::INT) FILTER (WHERE action = 'ACCEPT'), 6) AS acc_accept, round(avg(a::INT) FILTER (WHERE action = 'REWRITE'), 6) AS acc_rewrite, round(avg(a::INT) FILTER (WHERE action = 'STOP'), 6) AS acc_stop FROM res GROUP BY 1")
def agg_paper_table(spark, sf):
    p = results(spark, sf).groupBy("scene").pivot("action", ["ACCEPT", "REWRITE", "STOP"]).agg(F.round(F.avg(F.col("a").cast("int")), 6))
    return p.select("scene", F.col("ACCEPT").alias("acc_accept"), F.col("REWRITE").alias("acc_rewrite"), F.col("STOP").alias("acc_stop"))


@query("mcnemar_chi2", f"WITH {RES}, q AS (SELECT scene, {_Q} FROM res GROUP BY 1) SELECT scene, round(CASE WHEN cw + wc = 0 THEN 0.0 ELSE greatest(abs(cw - wc) - 1, 0) ** 2 / (cw + wc) END, 6) AS chi2 FROM q")
def mcnemar_chi2(spark, sf):
    q = results(spark, sf).groupBy("scene").agg(*E.quadrants(F.col("a"), F.col("b")))
    return q.select("scene", F.round(E.mcnemar_chi2(F.col("cw"), F.col("wc")), 6).alias("chi2"))


_P = "least(1.0, 2 * list_sum(list_transform(range(0, least(cw, wc) + 1), lambda i: exp(lgamma(cw + wc + 1) - lgamma(i + 1) - lgamma(cw + wc - i + 1) - (cw + wc) * ln(2)))))"


@query("mcnemar_exact", f"WITH {RES}, q AS (SELECT task, {_Q} FROM res GROUP BY 1) SELECT task, cw, wc, round(CASE WHEN cw + wc = 0 THEN 1.0 ELSE {_P} END, 9) AS p FROM q")
def mcnemar_exact(spark, sf):
    q = results(spark, sf).groupBy("task").agg(*E.quadrants(F.col("a"), F.col("b")))
    return q.select("task", "cw", "wc", F.round(E.mcnemar_exact("cw", "wc"), 9).alias("p"))


@query("paired_stats", f"WITH {RES}, q AS (SELECT scene, count(*) AS n, {_Q} FROM res GROUP BY 1) SELECT scene, n, round((cc + cw) / n, 6) AS acc_a, round((cc + wc) / n, 6) AS acc_b, round((wc - cw) / n, 6) AS delta, round(CASE WHEN cw + wc = 0 THEN 1.0 ELSE {_P} END, 9) AS p FROM q")
def paired_stats(spark, sf):
    q = results(spark, sf).groupBy("scene").agg(n().alias("n"), *E.quadrants(F.col("a"), F.col("b")))
    r = lambda c: F.round(c / F.col("n"), 6)
    return q.select("scene", "n", r(F.col("cc") + F.col("cw")).alias("acc_a"), r(F.col("cc") + F.col("wc")).alias("acc_b"), r(F.col("wc") - F.col("cw")).alias("delta"), F.round(E.mcnemar_exact("cw", "wc"), 9).alias("p"))


@query("significance_stars", f"WITH {RES}, q AS (SELECT task, {_Q} FROM res GROUP BY 1), p AS (SELECT task, CASE WHEN cw + wc = 0 THEN 1.0 ELSE {_P} END AS p FROM q) SELECT task, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars FROM p")
def significance_stars(spark, sf):
    q = results(spark, sf).groupBy("task").agg(*E.quadrants(F.col("a"), F.col("b")))
    return q.select("task", E.stars(E.mcnemar_exact("cw", "wc")).alias("stars"))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf):
    return E.paired_bootstrap(results(spark, sf).select(F.col("qid").alias("key"), "a", "b"), 200)


@query("stratified_bootstrap")
def stratified_bootstrap(spark, sf):
    return E.paired_bootstrap(results(spark, sf).select(F.col("qid").alias("key"), "a", "b", "scene"), 200, strata=["scene"])


@query("win_topk_mean", "SELECT user_id, round(list_avg(list_slice(list_reverse_sort(list(value)), 1, 3)), 6) AS top3 FROM events GROUP BY 1")
def win_topk_mean(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    t = table(spark, sf, "events").withColumn("r", F.row_number().over(w)).where("r <= 3")
    return t.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("top3"))


@query("win_group_adv", "SELECT event_id, round((value - avg(value) OVER w) / CASE WHEN stddev_pop(value) OVER w > 1e-6 THEN stddev_pop(value) OVER w ELSE 1 END, 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def win_group_adv(spark, sf):
    return A.advantages(table(spark, sf, "events"), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query("win_moving_avg", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smooth FROM events")
def win_moving_avg(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-3, 3)
    return table(spark, sf, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("smooth"))


@query("win_monotone", "SELECT conv_id, bool_and(ok) AS rising FROM (SELECT conv_id, coalesce(length(text) > lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), true) AS ok FROM conversations) GROUP BY 1")
def win_monotone(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("ok", F.coalesce(F.length("text") > F.lag(F.length("text")).over(w), F.lit(True)))
    return c.groupBy("conv_id").agg(F.bool_and("ok").alias("rising"))


@query("win_percentile_rank", f"WITH {RES} SELECT r.qid, round(100.0 * (SELECT count(*) FROM res x WHERE x.logp <= r.logp AND x.scene = r.scene) / (SELECT count(*) FROM res y WHERE y.scene = r.scene), 6) AS pct FROM res r")
def win_percentile_rank(spark, sf):
    r = results(spark, sf).select("qid", "scene", "logp", F.lit(1).alias("one"))
    total = r.groupBy("scene").agg(n().alias("n"))
    upto = running_total(r, "logp", "one", "c", ["scene"])
    return upto.alias("x").join(total.alias("t"), same("x", "t", ["scene"])).select("qid", F.round(100.0 * F.col("c") / F.col("n"), 6).alias("pct"))


@query("win_last_wins", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def win_last_wins(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))


@query("win_quota", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 20")
def win_quota(spark, sf):
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf, "documents").select("doc_id", "lang", F.row_number().over(w).alias("rn")).where("rn <= 20").drop("rn")


@query("sort_multi_key", "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, lang, doc_id")
def sort_multi_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "lang", "doc_id")


@query("sort_mainset", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars % 100 DESC, n_chars, doc_id DESC")
def sort_mainset(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy((F.col("n_chars") % 100).desc(), "n_chars", F.desc("doc_id"))


@query("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def limit_offset(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").offset(100).limit(50)


@query("top_counts", "SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 5")
def top_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(n().alias("n")).orderBy(F.desc("n"), "source").limit(5)


@query("top_repeated", "SELECT lang, sha256(text) AS h, count(*) AS n FROM documents GROUP BY lang, text HAVING count(*) > 1 ORDER BY n DESC, h LIMIT 30")
def top_repeated(spark, sf):
    g = table(spark, sf, "documents").groupBy("lang", F.sha2("text", 256).alias("h")).agg(n().alias("n")).where("n > 1")
    return g.orderBy(F.desc("n"), "h").limit(30)


@query("argmax_pred", "SELECT user_id, arg_max(event_type, total) AS pred FROM (SELECT user_id, event_type, sum(value) AS total FROM events GROUP BY 1, 2) GROUP BY 1")
def argmax_pred(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("total"))
    return g.groupBy("user_id").agg(F.max_by("event_type", "total").alias("pred"))


@query("pick_best_per_source", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE left(o_orderpriority, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def pick_best_per_source(spark, sf):
    p = F.substring("o_orderpriority", 1, 1)
    w = Window.partitionBy("o_custkey").orderBy(F.when(p == "1", 0).when(p == "2", 1).otherwise(2), F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("o_orderkey", "o_custkey")


@query("join_gen_review", "SELECT g.doc_id, g.quality AS generated, r.toxic AS reviewed FROM labels g JOIN labels r ON g.doc_id = r.doc_id")
def join_gen_review(spark, sf):
    x = table(spark, sf, "labels")
    last = lambda d: K.first_per(d, ["doc_id"], [F.desc("doc_id")])
    g, r = last(x.select("doc_id", F.col("quality").alias("generated"))), last(x.select("doc_id", F.col("toxic").alias("reviewed")))
    return g.join(r, "doc_id")


@query("join_paired_results", f"WITH {RES} SELECT x.user_id, x.v AS click, y.v AS other FROM (SELECT user_id, sum(value) FILTER (WHERE event_id % 2 = 0) AS v FROM events GROUP BY 1) x JOIN (SELECT user_id, sum(value) FILTER (WHERE event_id % 2 = 1) AS v FROM events GROUP BY 1) y ON x.user_id = y.user_id")
def join_paired_results(spark, sf):
    e = table(spark, sf, "events")
    part = lambda k, c: e.groupBy("user_id").agg(F.sum(F.when(F.col("event_id") % 2 == k, F.col("value"))).alias(c))
    return part(0, "click").join(part(1, "other"), "user_id")


@query("join_exclude_used", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join_exclude_used(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("join_meta_by_index", "SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey")
def join_meta_by_index(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_orderkey", "l_linenumber")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    return li.join(o, "k", "left").drop("k")


@query("union_all_sources", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def union_all_sources(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    return a.unionByName(table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


@query("intersect_qids", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def intersect_qids(spark, sf):
    return table(spark, sf, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, sf, "labels").where("quality = 1").select("doc_id"))


@query("except_keys", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@query("union_distinct_docs", "SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def union_distinct_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id").union(table(spark, sf, "labels").select("doc_id")).distinct()
