"""State of multi-round retrieval, rewards, utilities, and the choice of training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import written


def candidate_id(sample: Column, doc: Column, page: Column, block: Column, text: Column) -> Column:
    """s:sample, else d:doc:page:block, else t: and 16 digits of the text's md5, else empty."""
    blank = lambda c: F.coalesce(F.trim(c.cast("string")), F.lit(""))
    by_doc = F.concat_ws(":", F.lit("d"), blank(doc), blank(page), blank(block))
    return F.when(blank(sample) != "", F.concat(F.lit("s:"), blank(sample))).when(blank(doc) != "", by_doc).when(blank(text) != "", F.concat(F.lit("t:"), F.substring(F.md5(text), 1, 16))).otherwise("")


def suppress_seen(rows: DataFrame) -> DataFrame:
    """rows(qid, round_idx, candidate_id) without those their query returned in an earlier round."""
    first = rows.groupBy("qid", "candidate_id").agg(F.min("round_idx").alias("_first"))
    return rows.join(first, ["qid", "candidate_id"]).where("round_idx = _first").drop("_first")


def round_candidates(retained: DataFrame, failed: DataFrame, new: DataFrame) -> DataFrame:
    """qid, idx, kind, candidate_id: what was kept, one note of failed queries if there are any, then what is new."""
    a = retained.select("qid", F.lit(0).alias("part"), F.col("pos"), F.lit("retained").alias("kind"), "candidate_id")
    b = failed.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_set("query")), " | ").alias("candidate_id")).select("qid", F.lit(1).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit("note").alias("kind"), "candidate_id")
    c = new.select("qid", F.lit(2).alias("part"), F.col("pos"), F.lit("new").alias("kind"), "candidate_id")
    x = a.unionByName(b).unionByName(c)
    w = Window.partitionBy("qid").orderBy("part", "pos", "candidate_id")
    return x.select("qid", (F.row_number().over(w) - 1).alias("idx"), "kind", "candidate_id")


def keep_and_drop(keep: Column, drop: Column, n: Column) -> tuple[Column, Column]:
    """Valid distinct indexes: what is kept wins, what is in neither is dropped."""
    inside = lambda a: F.array_distinct(F.filter(a, lambda i: (i >= 0) & (i < n)))
    kept = inside(keep)
    rest = F.when(n > 0, F.array_except(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), kept)).otherwise(F.array().cast("array<bigint>"))
    return kept, rest


def apply_selection(evidence: Column, picks: Column) -> Column:
    """Items at 1-based picks, invalid and repeated ones ignored; everything if none is valid."""
    valid = F.array_distinct(F.filter(picks, lambda i: (i >= 1) & (i <= F.size(evidence))))
    return F.when(F.size(valid) == 0, evidence).otherwise(F.transform(valid, lambda i: F.get(evidence, i.cast("int") - 1)))


def evidence_hit(same_doc: Column, page: Column, gold_doc: Column, gold_page: Column, tolerance: int = 1) -> Column:
    """Whether an item meets the gold document and page; either may be missing."""
    has_doc = F.coalesce(gold_doc.cast("string"), F.lit("")) != ""
    near = F.coalesce(F.abs(page - gold_page) <= tolerance, F.lit(False))
    return F.when(has_doc & gold_page.isNotNull(), same_doc & near).when(has_doc, same_doc).when(gold_page.isNotNull(), near).otherwise(F.lit(False))


def leakage(query: Column, answer_text: Column, hard: Column) -> Column:
    soft = (F.length(answer_text) >= 2) & F.contains(query, answer_text)
    return hard.cast("double") + F.when(F.coalesce(soft, F.lit(False)), 0.2).otherwise(0.0)


def reward(original_hit: Column, hit: Column, query: Column, leak: Column, is_original: Column, action: Column) -> Column:
    delta = hit.cast("double") - original_hit.cast("double")
    unneeded = F.when(~is_original & original_hit & hit & (F.upper(action) == "REWRITE"), 0.1).otherwise(0.0)
    long = F.greatest(F.lit(0.0), (F.length(query) - 120) / 400.0)
    return delta + 0.5 * hit.cast("double") - 0.5 * leak - unneeded - 0.05 * long


def advantages(rows: DataFrame, group: str, value: str = "reward", floor: float = 1e-6) -> DataFrame:
    """Adds advantage: (x - mean) / population deviation of the group, 1 in place of a deviation at or under floor."""
    w = Window.partitionBy(group)
    sd = F.stddev_pop(value).over(w)
    return rows.withColumn("advantage", (F.col(value) - F.avg(value).over(w)) / F.when(sd > floor, sd).otherwise(1.0))


def set_utility(utilities: Column) -> Column:
    """0.7 * mean of the best three + 0.3 * mean of all; 0 without any."""
    top = F.slice(F.sort_array(utilities, asc=False), 1, 3)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return F.when(F.size(utilities) == 0, 0.0).otherwise(0.7 * mean(top) + 0.3 * mean(utilities))


def set_utilities(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, u: set_utility of each key's values, without gathering them; the best three are limited before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(value))
    top = rows.withColumn("_n", F.row_number().over(w)).where("_n <= 3").groupBy(key).agg(F.avg(value).alias("_t"))
    mean = rows.groupBy(key).agg(F.avg(value).alias("_m"))
    return top.join(mean, key).select(key, (0.7 * F.col("_t") + 0.3 * F.col("_m")).alias("u"))


def tier(valid: Column, base_correct: Column, any_flip: Column) -> Column:
    return F.when(~valid, "bad").when(base_correct, "trivial").when(any_flip, "selection").otherwise("rewrite")


def preference(actions: Column, margin: float) -> Column:
    """(best, worst) names of an array of (name, util) in order, the first of equals; null under the margin."""
    best = F.aggregate(actions, F.get(actions, F.lit(0)), lambda a, x: F.when(x["util"] > a["util"], x).otherwise(a))
    worst = F.aggregate(actions, F.get(actions, F.lit(0)), lambda a, x: F.when(x["util"] < a["util"], x).otherwise(a))
    return F.when(best["util"] - worst["util"] >= margin, F.struct(best["name"].alias("best"), worst["name"].alias("worst")))


def pick_training(members: DataFrame, rewrite_top: int = 2) -> DataFrame:
    """Rows(qid, tier, member_id, kind, action, n_keep, rewrite_query, u_set) to learn from, by tier: rewrites that
    beat the original query (distinct ones, the best first), the best useful selection, or the best acceptance."""
    anchor = members.where("kind = 'anchor_original'").groupBy("qid").agg(F.min_by("u_set", "member_id").alias("u_anchor"))
    wins = members.where("tier = 'rewrite' and kind = 'rewrite' and trim(coalesce(rewrite_query, '')) <> ''").join(anchor, "qid").where("u_set > u_anchor")
    own = Window.partitionBy("qid", F.trim("rewrite_query")).orderBy(F.desc("u_set"), "member_id")
    wins = wins.withColumn("n", F.row_number().over(own)).where("n = 1")
    best = Window.partitionBy("qid").orderBy(F.desc("u_set"), "member_id")
    cut = lambda d, k, why: d.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("qid", "member_id", F.lit(why).alias("source"))
    a = cut(wins, rewrite_top, "rewrite_win")
    b = cut(members.where("tier = 'selection' and kind = 'select' and n_keep > 0 and u_set > 0"), 1, "selection_best")
    c = cut(members.where("tier = 'trivial' and action = 'ACCEPT' and n_keep > 0"), 1, "trivial_accept")
    return a.unionByName(b).unionByName(c)


def trajectories(hits: DataFrame, rounds: int, keep: int, decide=None) -> DataFrame:
    """qid, round_idx, docid, kept: a few rounds over scored hits(qid, docid, score).

    Each round sees the best `keep` candidates that no earlier round returned; decide(frame) -> frame with a
    boolean kept stands for the agent (default: a positive score). What is kept stays known; a query ends when a round brings nothing.
    """
    decide = decide or (lambda d: d.withColumn("kept", F.col("score") > 0))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "docid")
    out = None
    left = hits
    for r in range(rounds):
        now = decide(left.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")).withColumn("round_idx", F.lit(r))
        out = now if out is None else out.unionByName(now)
        left = left.join(now.select("qid", "docid"), ["qid", "docid"], "left_anti")
    return out.select("qid", "round_idx", "docid", "kept")


def first_object(text: Column) -> Column:
    """The first balanced {...} of a text; from the first brace on if it never closes; the text itself without one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    none = F.lit(None).cast("int")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), none.alias("begin"), none.alias("end"))

    def step(a: Column, c: Column) -> Column:
        up, down = c == "{", (c == "}") & (a["depth"] > 0)
        closes = down & (a["depth"] == 1)
        return F.struct(
            (a["i"] + 1).alias("i"), (a["depth"] + up.cast("int") - down.cast("int")).alias("depth"),
            F.coalesce(a["begin"], F.when(up, a["i"])).alias("begin"), F.coalesce(a["end"], F.when(closes, a["i"] + 1)).alias("end"),
        )

    at = F.aggregate(chars, start, step)
    cut = F.substring(text, at["begin"] + 1, F.coalesce(at["end"], F.length(text)) - at["begin"])
    return F.when(at["begin"].isNull(), text).otherwise(cut)


def parse_action(text: Column, n: Column) -> Column:
    """keep (indexes from 0 below n, ascending), drop, action, rewrite_query, reason, parsed of a model's decision. What does
    not parse keeps nothing and accepts; an unknown action accepts."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>", "")
    body = first_object(plain)
    j = F.from_json(body, "keep array<string>, action string, rewrite_query string, reason string")
    parsed = F.coalesce(F.try_parse_json(body).isNotNull() & F.startswith(body, F.lit("{")) & (F.size(F.json_object_keys(body)) > 0), F.lit(False))
    ids = F.filter(F.transform(F.coalesce(j["keep"], F.array().cast("array<string>")), lambda x: x.try_cast("int")), lambda i: i.isNotNull() & (i >= 0) & (i < n))
    keep = F.when(parsed, F.array_sort(F.array_distinct(ids))).otherwise(F.array().cast("array<int>"))
    every = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    action = F.when(parsed & (F.upper(j["action"]) == "REWRITE"), "REWRITE").otherwise("ACCEPT")
    some = lambda c: F.when(parsed, F.coalesce(c, F.lit(""))).otherwise("")
    return F.struct(keep.alias("keep"), F.array_except(every, keep).alias("drop"), action.alias("action"), some(j["rewrite_query"]).alias("rewrite_query"), some(j["reason"]).alias("reason"), parsed.alias("parsed"))


def answer_anywhere(text: Column) -> Column:
    """The first stand-alone option letter anywhere, else the first character if it is one."""
    t = F.trim(F.coalesce(text, F.lit("")))
    alone = F.regexp_extract(t, r"(?U)\b([A-F])\b", 1)
    return F.when(alone != "", alone).when(F.substring(t, 1, 1).rlike("[A-F]"), F.substring(t, 1, 1)).otherwise("")


def answer_substring(text: Column, letters: Column) -> Column:
    """The first option letter (longest first, in order) that the upper-cased text holds at all."""
    up = F.upper(F.coalesce(text, F.lit("")))
    return F.coalesce(F.get(F.filter(letters, lambda x: F.contains(up, F.upper(x))), F.lit(0)), F.lit(""))


def states_answer(query: Column, answer: Column) -> Column:
    """Whether a query states the answer outright: the letter after the word for answer, or the words for final answer."""
    a = F.upper(F.trim(F.coalesce(answer, F.lit(""))))
    said = F.regexp_like(query, F.concat(F.lit("答案(?U:\\s)*[是为：:]?(?U:\\s)*"), a, F.lit("(?U:(?!\\w))")))
    return F.coalesce(F.contains(query, F.lit("最终答案")) | (a.rlike("^[A-F]$") & said), F.lit(False))


def action_reward(value: Column, parsed: Column) -> Column:
    """A reward, lowered where the decision did not parse."""
    return value - F.when(parsed, 0.0).otherwise(0.5)


def target(action: Column, keep: Column, rewrite: Column, n: Column) -> Column:
    """What a member should have answered: consistent keep, drop, action and rewrite; null for a rewrite without a query."""
    every = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    inside = F.array_sort(F.array_distinct(F.filter(keep, lambda i: (i >= 0) & (i < n))))
    accepts = action == "ACCEPT"
    kept = F.when(accepts, inside).otherwise(F.array().cast("array<int>"))
    query = F.when(action == "REWRITE", F.coalesce(rewrite, F.lit(""))).otherwise("")
    made = F.struct(kept.alias("keep"), F.array_except(every, kept).alias("drop"), action.alias("action"), query.alias("rewrite_query"))
    return F.when(~((action == "REWRITE") & (query == "")), F.to_json(made))


def merge_evidence(passages: DataFrame, cap: int = 12) -> tuple[DataFrame, DataFrame]:
    """(qid, candidate_id, pos) of the evidence collected from passages(qid, pos, candidate_id) in order: the first of each id, at most
    cap; and qid, n_added, n_dup: a passage is a duplicate if its id was collected before it."""
    own = Window.partitionBy("qid", "candidate_id").orderBy("pos")
    first = passages.withColumn("_k", F.row_number().over(own))
    order = Window.partitionBy("qid").orderBy("pos")
    rank = F.sum(F.when(F.col("_k") == 1, 1).otherwise(0)).over(order)
    marked = first.withColumn("_r", rank)
    within = F.max(F.when((F.col("_k") == 1) & (F.col("_r") <= cap), F.col("candidate_id"))).over(Window.partitionBy("qid", "candidate_id"))
    marked = marked.withColumn("_in", within.isNotNull())
    kept = marked.where((F.col("_k") == 1) & F.col("_in")).select("qid", "candidate_id", "pos")
    counts = marked.groupBy("qid").agg(F.count_if((F.col("_k") == 1) & F.col("_in")).alias("n_added"), F.count_if((F.col("_k") > 1) & F.col("_in")).alias("n_dup"))
    return kept, counts


def choose_evidence(hits: DataFrame, picks: DataFrame, top: int = 5) -> DataFrame:
    """hits(qid, rank, docid, score) that a model's picks(qid, number from 1) name; the best `top` of a query without a valid pick."""
    named = hits.join(picks.select("qid", F.col("number").alias("rank")).distinct(), ["qid", "rank"], "left_semi")
    some = named.select("qid").distinct()
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "docid")
    rest = hits.join(some, "qid", "left_anti").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")
    return named.unionByName(rest)


def final_evidence(retained: DataFrame, candidates: DataFrame, top: int = 5, cap: int = 5) -> DataFrame:
    """qid, docid, pos: what was retained (qid, docid, pos), then the best candidates, each id once, at most cap: an answer is never given without evidence."""
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "docid")
    best = candidates.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top).select("qid", "docid", F.lit(1).alias("part"), F.col("pos").cast("long").alias("pos"))
    both = retained.select("qid", "docid", F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos")).unionByName(best)
    first = both.groupBy("qid", "docid").agg(F.min(F.struct("part", "pos")).alias("p"))
    order = Window.partitionBy("qid").orderBy("p.part", "p.pos", "docid")
    return first.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= cap).select("qid", "docid", "pos")


def solve_rounds(hits: DataFrame, decide, rounds: int = 3, per_round: int = 5, memory: int = 5, forced: int = 0) -> DataFrame:
    """qid, docid, pos, n_rounds, action: the evidence that a multi-round agent ends with, over hits(qid, docid, score).

    Each round shows the best `per_round` hits that no earlier one showed, behind what is retained. decide(frame) adds to
    candidates (qid, docid, score, round_idx, old) the columns kept, action (ACCEPT or REWRITE, the same for a query's rows) and parsed. A parsed ACCEPT ends with what is
    kept, or the best candidates if nothing is; an answer that does not parse, and the last round, end with what is
    retained and the best candidates; a REWRITE adds what is kept to the memory, the first `memory` of it. Rounds
    before `forced` never end.
    """
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "docid")
    left = written(hits.select("qid", "docid", "score"), "left")
    retained = left.limit(0).withColumn("pos", F.lit(0).cast("long"))
    out = None
    for r in range(rounds):
        if r and left.isEmpty() and retained.isEmpty():
            break
        new = left.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_round).drop("_n")
        shown = retained.select("qid", "docid", "score").withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
        # written, so that a later round does not run the earlier ones again
        d = written(decide(shown.withColumn("round_idx", F.lit(r))), "round")
        ends = (~F.col("parsed") | (F.col("action") == "ACCEPT") | F.lit(r == rounds - 1)) & F.lit(r >= forced)
        done = d.where(ends)
        chosen = done.where("parsed and action = 'ACCEPT' and kept").withColumn("pos", F.row_number().over(order)).select("qid", "docid", F.col("pos").cast("long").alias("pos"), "action")
        rest = done.join(chosen.select("qid").distinct(), "qid", "left_anti")
        about = rest.groupBy("qid").agg(F.max("action").alias("action"))
        mine = retained.join(rest.where("not (parsed and action = 'ACCEPT')").select("qid").distinct(), "qid", "left_semi")
        filled = final_evidence(mine, rest.select("qid", "docid", "score")).join(about, "qid").select("qid", "docid", F.col("pos").cast("long").alias("pos"), "action")
        now = chosen.unionByName(filled).withColumn("n_rounds", F.lit(r + 1))
        out = now if out is None else out.unionByName(now)
        going = d.where(~ends)
        added = going.where("kept and not old").join(new.select("qid", "docid"), ["qid", "docid"], "left_semi").withColumn("pos", F.row_number().over(order) + r * 1000).select("qid", "docid", "score", F.col("pos").cast("long").alias("pos"))
        both = retained.join(going.select("qid").distinct(), "qid", "left_semi").unionByName(added)
        retained = both.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "docid"))).where(F.col("_n") <= memory).drop("_n")
        retained = written(retained, "retained")
        left = written(left.join(new.select("qid", "docid"), ["qid", "docid"], "left_anti").join(going.select("qid").distinct(), "qid", "left_semi"), "left")
    return out.select("qid", "docid", "pos", "n_rounds", "action")


def tool_loop(calls: DataFrame, max_rounds: int, max_calls: int) -> DataFrame:
    """qid, n_calls, n_rounds, n_failed, finish_reason of scripted tool calls(qid, step, tool, ok): every call uses budget,
    a search also a round; a submission, or an exhausted budget, ends it."""
    w = Window.partitionBy("qid").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = calls.withColumn("calls", F.row_number().over(Window.partitionBy("qid").orderBy("step")))
    x = x.withColumn("searches", F.sum((F.col("tool") == "search").cast("int")).over(w))
    x = x.withColumn("stop", F.max(((F.col("tool") == "submit") & F.col("ok")).cast("int")).over(w))
    before = Window.partitionBy("qid").orderBy("step")
    alive = (F.coalesce(F.lag("stop").over(before), F.lit(0)) == 0) & (F.coalesce(F.lag("calls").over(before), F.lit(0)) < max_calls) & (F.coalesce(F.lag("searches").over(before), F.lit(0)) < max_rounds)
    run = x.withColumn("alive", alive).where("alive")
    return run.groupBy("qid").agg(F.count(F.lit(1)).alias("n_calls"), F.max("searches").alias("n_rounds"), F.count_if(~F.col("ok")).alias("n_failed"), F.max("stop").alias("stop")).select("qid", "n_calls", "n_rounds", "n_failed", F.when(F.col("stop") == 1, "submitted").otherwise("budget_exhausted").alias("finish_reason"))


def controller_scores(rows: DataFrame) -> DataFrame:
    """n, parse_ok, keep_exact, keep_prec, keep_rec, keep_f1, action_acc of rows(pred_keep, true_keep, pred_action, true_action, parsed): keeps are pooled."""
    both = F.size(F.array_intersect("pred_keep", "true_keep"))
    t = rows.select(both.alias("tp"), (F.size("pred_keep") - both).alias("fp"), (F.size("true_keep") - both).alias("fn"), "parsed", (F.array_sort("pred_keep") == F.array_sort("true_keep")).alias("exact"), (F.col("pred_action") == F.col("true_action")).alias("same"))
    s = t.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("parsed").cast("int")).alias("parse_ok"), F.avg(F.col("exact").cast("int")).alias("keep_exact"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.avg(F.col("same").cast("int")).alias("action_acc"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return s.select("n", "parse_ok", "keep_exact", p.alias("keep_prec"), r.alias("keep_rec"), div(2 * p * r, p + r).alias("keep_f1"), "action_acc")
