"""Queries: agent state, rewards, splits, samplers, pair builders, validators, reranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import agent as A
from ..operators import build as B
from ..operators import context as X
from ..operators import dataset as D
from ..operators import rerank as R
from ..operators import search as S
from . import q_search as QS
from .base import BLOCKS, blocks, query, table


def hash01(s: str) -> str:
    return f"('0x' || substr(sha1({s}), 1, 8))::BIGINT / 4294967295.0::DOUBLE"


@query("split_doc_hash", f"SELECT doc, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'internal_test' END AS split FROM (SELECT doc, {hash01("'42:' || doc")} AS u FROM (SELECT DISTINCT source AS doc FROM documents))")
def split_doc_hash(spark, sf):
    return blocks(spark, sf).select("doc").distinct().select("doc", D.split_by_hash(F.col("doc"), "42").alias("split"))


@query("split_core_hash", f"WITH {BLOCKS} SELECT block_id, CASE WHEN k < 8 THEN 'train' WHEN k = 8 THEN 'val' ELSE 'test' END AS split FROM (SELECT block_id, ('0x' || substr(content_hash, 1, 8))::BIGINT % 10 AS k FROM blocks)")
def split_core_hash(spark, sf):
    return blocks(spark, sf).select("block_id", D.split_by_digest(F.col("content_hash")).alias("split"))


@query("hash_order", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha1('s:' || doc_id), doc_id) AS rn FROM documents")
def hash_order(spark, sf):
    return D.ranked(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", "s").select("doc_id", "rn")


@query("sample_reservoir", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('r:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 25")
def sample_reservoir(spark, sf):
    return D.sample_per(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 25, "r")


@query("split_stratified", "SELECT doc_id, CASE WHEN n < 3 THEN 'train' WHEN rn <= k THEN 'test' WHEN rn <= 2 * k THEN 'val' ELSE 'train' END AS split FROM (SELECT *, greatest(round_even(n * 0.1::DOUBLE, 0), 1) AS k FROM (SELECT doc_id, count(*) OVER (PARTITION BY lang, source) AS n, row_number() OVER (PARTITION BY lang, source ORDER BY sha1('t:' || doc_id), doc_id) AS rn FROM documents))")
def split_stratified(spark, sf):
    return D.split_stratified(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", "t").select("doc_id", "split")


@query("split_by_qid", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY sha1('v:' || doc_id), doc_id) <= greatest(floor(count(*) OVER () * 0.1::DOUBLE), 1) THEN 'val' ELSE 'train' END AS split FROM documents")
def split_by_qid(spark, sf):
    return D.split_keys(table(spark, sf, "documents").select("doc_id"), "doc_id", "v", 0.1)


@query("split_doc_random", "SELECT doc, CASE WHEN row_number() OVER (ORDER BY sha1('d:' || doc), doc) <= greatest(floor(count(*) OVER () * 0.2::DOUBLE), 1) THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT source AS doc FROM documents)")
def split_doc_random(spark, sf):
    return D.split_keys(blocks(spark, sf).select("doc"), "doc", "d", 0.2)


@query("sample_allocate", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT lang, n, (100 - (SELECT count(*) FROM c)) * (n / (SELECT sum(n) FROM c)) AS share FROM c), f AS (SELECT *, floor(share) AS w, share - floor(share) AS frac FROM s) SELECT lang, (1 + w + (row_number() OVER (ORDER BY frac DESC, lang DESC) <= (100 - (SELECT count(*) FROM c)) - sum(w) OVER ())::INT)::BIGINT AS k FROM f")
def sample_allocate(spark, sf):
    return D.allocate(table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", 100)


@query("sample_quota", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('q:' || doc_id), doc_id) AS rn FROM documents), a AS (SELECT doc_id, 0 AS fill FROM r WHERE rn <= 10), b AS (SELECT doc_id, 1 AS fill FROM r WHERE rn > 10 ORDER BY sha1('q:' || doc_id), doc_id LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM b")
def sample_quota(spark, sf):
    r = D.ranked(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], "doc_id", "q")
    rest = r.where("rn > 10").orderBy(D.seeded("q", F.col("doc_id")), "doc_id").limit(20)
    return r.where("rn <= 10").select("doc_id", F.lit(0).alias("fill")).unionByName(rest.select("doc_id", F.lit(1).alias("fill")))


@query("sample_round_robin", "SELECT doc_id FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1('o:' || doc_id), doc_id) AS rn FROM documents) ORDER BY rn, source LIMIT 45")
def sample_round_robin(spark, sf):
    r = D.ranked(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", "o")
    return r.orderBy("rn", "source").limit(45).select("doc_id")


@query("sample_oversample", "SELECT doc_id, unnest(range(0, CASE WHEN toxic = 1 THEN 3 ELSE 1 END)) AS copy FROM labels")
def sample_oversample(spark, sf):
    return D.oversample(table(spark, sf, "labels").select("doc_id", "toxic"), F.when(F.col("toxic") == 1, 3).otherwise(1)).select("doc_id", "copy")


@query("shard_modulo", "SELECT doc_id % 4 AS shard, count(*) AS n FROM documents GROUP BY 1")
def shard_modulo(spark, sf):
    return table(spark, sf, "documents").groupBy(F.pmod("doc_id", F.lit(4)).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("shard_lpt", "WITH RECURSIVE o AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS r FROM (SELECT source, sum(n_chars) AS n FROM documents GROUP BY 1)), w AS (SELECT r, source, 0 AS shard, n AS a, 0::HUGEINT AS b, 0::HUGEINT AS c, 0::HUGEINT AS d FROM o WHERE r = 1 UNION ALL SELECT r, source, s, a + CASE WHEN s = 0 THEN n ELSE 0 END, b + CASE WHEN s = 1 THEN n ELSE 0 END, c + CASE WHEN s = 2 THEN n ELSE 0 END, d + CASE WHEN s = 3 THEN n ELSE 0 END FROM (SELECT o.r, o.source, o.n, w.a, w.b, w.c, w.d, CASE WHEN a <= b AND a <= c AND a <= d THEN 0 WHEN b <= c AND b <= d THEN 1 WHEN c <= d THEN 2 ELSE 3 END AS s FROM w JOIN o ON o.r = w.r + 1)) SELECT source, shard FROM w")
def shard_lpt(spark, sf):
    sizes = [(r["source"], r["n"]) for r in table(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("n")).toLocalIterator()]
    return spark.createDataFrame(list(D.largest_first(sizes, 4).items()), "source string, shard int")


@query("win_running_pack", "WITH RECURSIVE o AS (SELECT source, doc_id, n_chars AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), w AS (SELECT source, doc_id, r, n AS s, 0 AS part FROM o WHERE r = 1 UNION ALL SELECT o.source, o.doc_id, o.r, CASE WHEN w.s > 0 AND w.s + o.n > 20000 THEN o.n ELSE w.s + o.n END, w.part + (w.s > 0 AND w.s + o.n > 20000)::INT FROM w JOIN o ON o.source = w.source AND o.r = w.r + 1) SELECT source, doc_id, part FROM w")
def win_running_pack(spark, sf):
    return D.greedy_parts(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", "n_chars", 20_000).select("source", "doc_id", "part")


@query("page_chunks", "SELECT doc_id, s AS first_page, least(s + 9, pages) AS last_page FROM (SELECT doc_id, n_chars // 100 + 1 AS pages, unnest(range(1, n_chars // 100 + 2, 10)) AS s FROM documents)")
def page_chunks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("n_chars") / 100 + 1).alias("pages"))
    return d.select("doc_id", "pages", F.explode(F.sequence(F.lit(1).cast("long"), "pages", F.lit(10).cast("long"))).alias("first_page")).select("doc_id", "first_page", F.least(F.col("first_page") + 9, "pages").alias("last_page"))


@query("dedup_first_conflict", "SELECT sha256(d.text) AS h, min(d.doc_id) AS first_key, count(*) AS n, count(DISTINCT quality) > 1 AS conflict FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.text")
def dedup_first_conflict(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h")).join(table(spark, sf, "labels"), "doc_id")
    return D.conflicts(x, "h", "quality", "doc_id")


@query("dedup_label_conflict", "SELECT count(*) AS n_texts, count(*) FILTER (WHERE k > 1) AS n_conflicts FROM (SELECT d.text, count(DISTINCT quality * 2 + toxic) AS k FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1)")
def dedup_label_conflict(spark, sf):
    x = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h")).join(table(spark, sf, "labels"), "doc_id").withColumn("l", F.col("quality") * 2 + F.col("toxic"))
    return D.conflicts(x, "h", "l", "doc_id").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("conflict").alias("n_conflicts"))


@query("consensus_exact", "SELECT doc_id, quality FROM labels WHERE quality = toxic")
def consensus_exact(spark, sf):
    x = table(spark, sf, "labels")
    return D.consensus(x.select("doc_id", "quality"), x.select("doc_id", "toxic"), "doc_id", "quality", "toxic")


@query("rank_pairs", "SELECT a.conv_id, a.turn AS low, b.turn AS high, length(b.text) - length(a.text) AS gap FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def rank_pairs(spark, sf):
    return D.pairs_of_levels(table(spark, sf, "conversations").withColumn("score", F.length("text")), "conv_id", "turn", "score")


@query("nlj_level_pairs", "SELECT conv_id, count(*) AS n_pairs FROM (SELECT a.conv_id FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn) GROUP BY 1")
def nlj_level_pairs(spark, sf):
    return D.pairs_of_levels(table(spark, sf, "conversations").withColumn("score", F.length("text")), "conv_id", "turn", "score").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_pairs"))


@query("sft_rows", "SELECT conv_id, turn, (SELECT count(*) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn) AS n_before, sha256(text) AS target FROM conversations a WHERE role = 'assistant'")
def sft_rows(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("n_before", (F.row_number().over(w) - 1).cast("long"))
    return c.where("role = 'assistant'").select("conv_id", "turn", "n_before", F.sha2("text", 256).alias("target"))


@query("candidate_id", f"WITH {BLOCKS} SELECT block_id, CASE WHEN block_id % 3 = 0 THEN 's:' || block_id WHEN block_id % 3 = 1 THEN 'd:' || doc || ':' || page_idx || ':' || block_id ELSE 't:' || substr(md5(text), 1, 16) END AS candidate_id FROM blocks")
def candidate_id(spark, sf):
    b, m = blocks(spark, sf), F.col("block_id") % 3
    return b.select("block_id", A.candidate_id(F.when(m == 0, F.col("block_id")), F.when(m == 1, F.col("doc")), F.col("page_idx"), F.col("block_id"), F.col("text")).alias("candidate_id"))


@query("suppress_seen", "SELECT user_id AS qid, event_type AS candidate_id, min(event_id % 4) AS round_idx, count(*) FILTER (WHERE event_id % 4 = m) AS n FROM (SELECT *, min(event_id % 4) OVER (PARTITION BY user_id, event_type) AS m FROM events) GROUP BY 1, 2")
def suppress_seen(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("candidate_id"), (F.col("event_id") % 4).alias("round_idx"))
    return A.suppress_seen(e).groupBy("qid", "candidate_id").agg(F.min("round_idx").alias("round_idx"), F.count(F.lit(1)).alias("n"))


@query("round_candidates", "WITH x AS (SELECT conv_id AS qid, 0 AS part, turn AS pos, 'retained' AS kind, left(text, 20) AS candidate_id FROM conversations WHERE turn < 2 UNION ALL SELECT conv_id, 1, 0, 'note', string_agg(DISTINCT role, ' | ' ORDER BY role) FROM conversations WHERE turn = 2 GROUP BY 1 UNION ALL SELECT conv_id, 2, turn, 'new', left(text, 20) FROM conversations WHERE turn > 2) SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY part, pos, candidate_id) - 1 AS idx, kind, candidate_id FROM x")
def round_candidates(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), "turn", F.col("turn").alias("pos"), "role", F.substring("text", 1, 20).alias("candidate_id"))
    return A.round_candidates(c.where("turn < 2"), c.where("turn = 2").withColumn("query", F.col("role")), c.where("turn > 2"))


@query("gold_hit", f"WITH {BLOCKS}, g AS (SELECT doc AS gold_doc, 3 AS gold_page FROM (SELECT DISTINCT doc FROM blocks)) SELECT gold_doc, bool_or(doc = gold_doc AND abs(page_idx - gold_page) <= 1) AS hit FROM blocks JOIN g ON doc = gold_doc GROUP BY 1")
def gold_hit(spark, sf):
    b = blocks(spark, sf)
    g = b.select(F.col("doc").alias("gold_doc")).distinct().withColumn("gold_page", F.lit(3))
    x = b.join(g, F.col("doc") == F.col("gold_doc"))
    return x.groupBy("gold_doc").agg(F.bool_or(A.evidence_hit(F.col("doc") == F.col("gold_doc"), F.col("page_idx"), F.col("gold_doc"), F.col("gold_page"))).alias("hit"))


@query("reward_score", "SELECT doc_id, round((q::DOUBLE - o::DOUBLE) + 0.5 * q::DOUBLE - 0.5 * l - CASE WHEN doc_id % 2 = 1 AND o AND q AND doc_id % 3 = 0 THEN 0.1 ELSE 0 END - 0.05 * greatest(0, (n_chars - 120) / 400.0), 6) AS reward FROM (SELECT d.doc_id, d.n_chars, quality = 1 AS q, toxic = 1 AS o, CASE WHEN contains(text, 'the') THEN 0.2 ELSE 0 END AS l FROM documents d JOIN labels USING (doc_id) WHERE n_chars = length(text))")
def reward_score(spark, sf):
    x = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where("n_chars = length(text)")
    leak = A.leakage(F.col("text"), F.lit("the"), F.lit(0))
    r = A.reward(F.col("toxic") == 1, F.col("quality") == 1, F.col("text"), leak, F.col("doc_id") % 2 == 0, F.when(F.col("doc_id") % 3 == 0, "rewrite").otherwise("accept"))
    return x.select("doc_id", F.round(r, 6).alias("reward"))


@query("set_utility", "SELECT user_id, round(0.7 * list_avg(list_slice(list_reverse_sort(v), 1, 3)) + 0.3 * list_avg(v), 6) AS u FROM (SELECT user_id, list(ln(value + 1)) AS v FROM events GROUP BY 1)")
def set_utility(spark, sf):
    u = table(spark, sf, "events").select("user_id", F.log(F.col("value") + 1).alias("v"))
    return A.set_utilities(u, "user_id", "v").withColumn("u", F.round("u", 6))


@query("tier_assign", "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN doc_id % 11 = 0 THEN 'bad' WHEN quality = 1 AND toxic = 0 THEN 'trivial' WHEN toxic = 1 THEN 'selection' ELSE 'rewrite' END AS tier FROM labels) GROUP BY 1")
def tier_assign(spark, sf):
    t = A.tier(F.col("doc_id") % 11 != 0, (F.col("quality") == 1) & (F.col("toxic") == 0), F.col("toxic") == 1)
    return table(spark, sf, "labels").select(t.alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("support_label", "SELECT event_id, CASE WHEN u > 0.2 THEN 'pos' WHEN u < -0.2 THEN 'neg' ELSE 'neutral' END AS label FROM (SELECT event_id, ln(value + 1) - 3 AS u FROM events)")
def support_label(spark, sf):
    return table(spark, sf, "events").select("event_id", D.support_label(F.log(F.col("value") + 1) - 3).alias("label"))


@query("dpo_pairs", "WITH u AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS i, unnest(['teacher', 'keep_none', 'keep_all', 'flip']) AS name, unnest([doc_id * 37 % 101, doc_id * 53 % 97, doc_id * 71 % 89, doc_id * 13 % 83]) AS util FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY util DESC, i) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY util, i) AS w FROM u) SELECT doc_id, max(name) FILTER (WHERE b = 1) AS best, max(name) FILTER (WHERE w = 1) AS worst FROM r GROUP BY 1 HAVING max(util) - min(util) >= 30")
def dpo_pairs(spark, sf):
    acts = (("teacher", 37, 101), ("keep_none", 53, 97), ("keep_all", 71, 89), ("flip", 13, 83))
    a = F.array(*[F.struct(F.lit(n).alias("name"), (F.col("doc_id") * m % k).alias("util")) for n, m, k in acts])
    return table(spark, sf, "documents").select("doc_id", A.preference(a, 30).alias("p")).where("p is not null").select("doc_id", "p.best", "p.worst")


MEM = "m AS (SELECT user_id AS qid, ['rewrite', 'selection', 'trivial'][1 + user_id % 3] AS tier, event_id AS member_id, ['anchor_original', 'rewrite', 'rewrite', 'select'][1 + event_id % 4] AS kind, CASE WHEN event_id % 5 = 0 THEN 'ACCEPT' ELSE 'REWRITE' END AS action, event_id % 3 AS n_keep, 'q' || (event_id % 6) AS rewrite_query, value - 20 AS u_set FROM events)"


@query("rft_pick", f"WITH {MEM}, anc AS (SELECT qid, arg_min(u_set, member_id) AS ua FROM m WHERE kind = 'anchor_original' GROUP BY 1), w AS (SELECT *, row_number() OVER (PARTITION BY qid, rewrite_query ORDER BY u_set DESC, member_id) AS rn FROM m JOIN anc USING (qid) WHERE tier = 'rewrite' AND kind = 'rewrite' AND u_set > ua), w2 AS (SELECT qid, member_id, row_number() OVER (PARTITION BY qid ORDER BY u_set DESC, member_id) AS k FROM w WHERE rn = 1), s AS (SELECT qid, member_id, row_number() OVER (PARTITION BY qid ORDER BY u_set DESC, member_id) AS k FROM m WHERE tier = 'selection' AND kind = 'select' AND n_keep > 0 AND u_set > 0), t AS (SELECT qid, member_id, row_number() OVER (PARTITION BY qid ORDER BY u_set DESC, member_id) AS k FROM m WHERE tier = 'trivial' AND action = 'ACCEPT' AND n_keep > 0) SELECT qid, member_id, 'rewrite_win' AS source FROM w2 WHERE k <= 2 UNION ALL SELECT qid, member_id, 'selection_best' FROM s WHERE k = 1 UNION ALL SELECT qid, member_id, 'trivial_accept' FROM t WHERE k = 1")
def rft_pick(spark, sf):
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (c + 1).cast("int"))
    e = table(spark, sf, "events").select(F.col("user_id").alias("qid"), pick(("rewrite", "selection", "trivial"), F.col("user_id") % 3).alias("tier"), F.col("event_id").alias("member_id"), pick(("anchor_original", "rewrite", "rewrite", "select"), F.col("event_id") % 4).alias("kind"), F.when(F.col("event_id") % 5 == 0, "ACCEPT").otherwise("REWRITE").alias("action"), (F.col("event_id") % 3).alias("n_keep"), F.concat(F.lit("q"), (F.col("event_id") % 6).cast("string")).alias("rewrite_query"), (F.col("value") - 20).alias("u_set"))
    return A.pick_training(e)


@query("levels_to_coarse", "SELECT conv_id, turn, CASE WHEN turn <= 1 THEN 'L01' WHEN turn <= 4 THEN 'L24' END AS coarse FROM conversations")
def levels_to_coarse(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") <= 1, "L01").when(F.col("turn") <= 4, "L24").alias("coarse"))


@query("dep_adjust_k", "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN 6 WHEN 1 THEN 10 ELSE 8 END AS text_k, CASE doc_id % 4 WHEN 3 THEN 5 WHEN 1 THEN 2 ELSE 3 END AS image_k FROM documents")
def dep_adjust_k(spark, sf):
    t, i = D.adjusted_k(F.concat(F.lit("R"), (F.col("doc_id") % 4).cast("string")), 8, 3)
    return table(spark, sf, "documents").select("doc_id", t.alias("text_k"), i.alias("image_k"))


@query("density_score", "SELECT doc_id, round([0.1, 0.3, 0.5, 0.7, 0.9][1 + doc_id % 5]::DOUBLE + greatest(-0.08, least(0.08, 0.16 * ((doc_id * 37 % 101) / 100.0::DOUBLE - 0.5))), 6) AS score FROM documents")
def density_score(spark, sf):
    level, raw = F.concat(F.lit("L"), (F.col("doc_id") % 5).cast("string")), F.col("doc_id") * 37 % 101 / 100.0
    return table(spark, sf, "documents").select("doc_id", F.round(D.density_score(level, raw, {"L0": 0.1, "L1": 0.3, "L2": 0.5, "L3": 0.7, "L4": 0.9}), 6).alias("score"))


_CLEAN = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
_CUT = "CASE WHEN length({0}) > {1} THEN rtrim(substr({0}, 1, {1} - 3)) || '...' ELSE {0} END"
_ITEMS = f"{BLOCKS}, i AS (SELECT doc, page_idx AS page, block_id AS pos, {_CLEAN.format('text')} AS t FROM blocks)"


def items(spark, sf):
    """Blocks as items of their document, block_id being their place."""
    return blocks(spark, sf).select("doc", F.col("page_idx").alias("page"), F.col("block_id").alias("pos"), "text")


@query("page_context", f"WITH {_ITEMS}, there AS (SELECT DISTINCT doc, page FROM i), c AS (SELECT DISTINCT doc, page FROM i), p AS (SELECT c.doc, c.page, t.page AS p FROM c JOIN there t ON t.doc = c.doc AND (t.page IN (c.page, c.page + 1) OR t.page = c.page - 1 AND NOT EXISTS (SELECT 1 FROM there n WHERE n.doc = c.doc AND n.page = c.page + 1))), x AS (SELECT p.doc, p.page, string_agg('[page ' || p.p || '] ' || t, ' ' ORDER BY pos) AS text FROM p JOIN i ON i.doc = p.doc AND i.page = p.p WHERE t <> '' GROUP BY 1, 2) SELECT id, pages, {_CUT.format('text', 3000)} AS text FROM (SELECT DISTINCT i.doc || ':' || i.page AS id, (SELECT list(p.p ORDER BY p.p) FROM p WHERE p.doc = i.doc AND p.page = i.page) AS pages, coalesce(x.text, '') AS text FROM i LEFT JOIN x USING (doc, page))")
def page_context(spark, sf):
    """The text of every page and the next, or the one before."""
    own = items(spark, sf)
    centers = own.select("doc", "page").distinct().withColumn("id", F.concat_ws(":", "doc", F.col("page").cast("string")))
    return X.page_contexts(centers, own, 3000)


@query("item_context", f"WITH {_ITEMS}, w AS (SELECT c.pos AS id, count(*) AS n, string_agg('[item ' || i.pos || ' page ' || i.page || '] ' || i.t, ' ' ORDER BY i.pos) AS text FROM i c JOIN i ON i.doc = c.doc AND i.pos BETWEEN c.pos - 8 AND c.pos + 8 WHERE i.t <> '' GROUP BY 1) SELECT i.pos AS id, coalesce(n, 0) AS n, coalesce({_CUT.format('text', 1500)}, '') AS text FROM i LEFT JOIN w ON w.id = i.pos")
def item_context(spark, sf):
    """The items around every block."""
    own = items(spark, sf)
    return X.item_windows(own.select(F.col("pos").alias("id"), "doc", "pos"), own, most=1500)


@query("sanitize_keep_drop", "SELECT doc_id, list_filter([0, 1, 2, 3], lambda i: i < n AND (i = k1 OR i = k2)) AS keep, list_filter([0, 1, 2, 3], lambda i: i < n AND i <> k1 AND i <> k2) AS dropped FROM (SELECT doc_id, 2 + doc_id % 3 AS n, doc_id % 4 AS k1, doc_id % 5 AS k2 FROM documents)")
def sanitize_keep_drop(spark, sf):
    d = F.col("doc_id")
    keep, rest = A.keep_and_drop(F.array(d % 4, d % 5, F.lit(-1).cast("long"), F.lit(9).cast("long")), F.array(d % 2), 2 + d % 3)
    return table(spark, sf, "documents").select("doc_id", F.sort_array(keep).alias("keep"), rest.alias("dropped"))


@query("apply_selection", "SELECT doc_id, CASE WHEN doc_id % 6 BETWEEN 1 AND 3 THEN ['a', 'b', 'c'][doc_id % 6] ELSE 'a,b,c' END AS picked FROM documents")
def apply_selection(spark, sf):
    got = A.apply_selection(F.array(*map(F.lit, "abc")), F.array(F.col("doc_id") % 6, F.lit(7).cast("long"), F.col("doc_id") % 6))
    return table(spark, sf, "documents").select("doc_id", F.array_join(got, ",").alias("picked"))


@query("run_trajectory")
def run_trajectory(spark, sf):
    return A.trajectories(QS.run(spark, sf, 10, 40), 3, 5)


@query("image_explode", "SELECT page_id, i AS pos, 'p' || page_id || '_' || i AS image_id FROM (SELECT page_id, unnest(range(0, page_id % 4)) AS i FROM pages) WHERE i <> 1")
def image_explode(spark, sf):
    """A sample's images as rows; the second has a blank path and goes."""
    image = lambda i: F.struct(F.concat_ws("_", F.concat(F.lit("p"), F.col("page_id")), i.cast("string")).alias("image_id"), F.when(i == 1, " ").otherwise(F.col("url")).alias("image_path"))
    images = F.when(F.col("page_id") % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("page_id") % 4 - 1), image))
    return B.image_rows(table(spark, sf, "pages").withColumn("images", images), "images").select("page_id", "pos", "image_id")


def candidates(spark, sf):
    """The 20 best vectors of each query: source by parity, group by half, two option vectors."""
    top = QS.run(spark, sf, 20)
    e = QS.corpus(spark, sf)
    unit = e.select("docid", S.l2_normalize(F.col("vec")).alias("emb"))
    q = unit.where("docid % 50 = 0").select(F.col("docid").alias("qid"), F.col("emb").alias("qvec"))
    o = unit.where("docid % 50 = 1").select((F.col("docid") - 1).alias("qid"), F.col("emb").alias("ov"))
    x = top.join(unit, "docid").join(q, "qid").join(o, "qid")
    return x.select("qid", F.col("docid").alias("idx"), "emb", (F.col("docid") % 2).alias("source"), F.floor(F.col("docid") / 2).alias("group_id"), F.col("score").alias("first"), "qvec", F.array("qvec", "ov").alias("options"))


_CAND = f"{QS._ranked('a', QS.DOT, 20)}, c AS (SELECT a.qid, a.docid AS idx, list_transform(e.embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 1e-12)) AS emb, a.docid % 2 AS source, a.docid // 2 AS grp FROM a JOIN embeddings e ON e.vec_id = a.docid)"
_SIM = f"{_CAND}, sim AS (SELECT x.qid, x.idx AS i, y.idx AS j, greatest(list_dot_product(x.emb, y.emb), 0) AS sim, x.source <> y.source AND x.grp = y.grp AS paired FROM c x JOIN c y ON x.qid = y.qid AND x.idx <> y.idx)"


@query("nlj_pairwise_sim", f"WITH {_SIM} SELECT qid, i, j, round(sim, 6) AS sim FROM sim")
def nlj_pairwise_sim(spark, sf):
    return R.pair_similarity(candidates(spark, sf)).withColumn("sim", F.round("sim", 6))


@query("ppr_adjacency", f"WITH {_SIM}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, i ORDER BY round(sim, 9) DESC, j) AS r FROM sim) WHERE r <= 8 AND sim > 0), b AS (SELECT qid, i, j, max(sim) AS w FROM (SELECT qid, i, j, sim FROM near UNION ALL SELECT qid, j, i, sim FROM near) GROUP BY 1, 2, 3), p AS (SELECT qid, i, j FROM sim WHERE paired) SELECT qid, i, j, round(CASE WHEN paired THEN least(greatest(coalesce(w, 0) + 0.15, 0.45), 1) ELSE w END, 6) AS w FROM (SELECT coalesce(b.qid, p.qid) AS qid, coalesce(b.i, p.i) AS i, coalesce(b.j, p.j) AS j, w, p.qid IS NOT NULL AS paired FROM b FULL JOIN p ON b.qid = p.qid AND b.i = p.i AND b.j = p.j)")
def ppr_adjacency(spark, sf):
    return R.adjacency(candidates(spark, sf)).withColumn("w", F.round("w", 6))


@query("ppr_iterate")
def ppr_iterate(spark, sf):
    return R.ppr_scores(candidates(spark, sf)).withColumn("score", F.round("score", 6))


@query("ppr_rerank")
def ppr_rerank(spark, sf):
    return R.rerank(candidates(spark, sf), "ppr")


@query("odsc_submodular")
def odsc_submodular(spark, sf):
    return R.rerank(candidates(spark, sf), "odsc")


@query("vcms_select")
def vcms_select(spark, sf):
    return R.rerank(candidates(spark, sf), "vcms")


def _options(spark, sf):
    c = candidates(spark, sf).select("qid", "options").distinct()
    return c.select("qid", F.posexplode("options").alias("option", "ovec"))


_SUP = f"{_CAND}, u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS v FROM embeddings WHERE vec_id % 50 < 2), o AS (SELECT vec_id - vec_id % 50 AS qid, vec_id % 50 AS option, v AS ovec FROM u), s AS (SELECT c.qid, idx, option, greatest(list_dot_product(emb, ovec), 0) AS support FROM c JOIN o USING (qid))"


@query("odsc_support", f"WITH {_SUP} SELECT qid, idx, option, round(support, 6) AS support FROM s")
def odsc_support(spark, sf):
    return R.support(candidates(spark, sf), _options(spark, sf)).withColumn("support", F.round("support", 6))


@query("odsc_disc", f"WITH {_SUP} SELECT qid, idx, round(max(support) - min(support), 6) AS disc FROM s GROUP BY 1, 2")
def odsc_disc(spark, sf):
    return R.top_two_gap(R.support(candidates(spark, sf), _options(spark, sf))).withColumn("disc", F.round("disc", 6))


_UNIT = "CASE WHEN max({0}) OVER w - min({0}) OVER w < 1e-12 THEN 0.5 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


@query("ppr_restart", f"WITH {_CAND}, s AS (SELECT a.qid, a.docid AS idx, a.score AS first, greatest(list_dot_product(c.emb, q.emb), 0) AS sim FROM a JOIN c ON c.qid = a.qid AND c.idx = a.docid JOIN (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS emb FROM embeddings WHERE vec_id % 50 = 0) q ON q.vec_id = a.qid), m AS (SELECT qid, idx, 0.5 * {_UNIT.format('first')} + 0.5 * {_UNIT.format('sim')} AS r FROM s WINDOW w AS (PARTITION BY qid)) SELECT qid, idx, round(r / sum(r) OVER (PARTITION BY qid), 6) AS r FROM m")
def ppr_restart(spark, sf):
    return R.restart(candidates(spark, sf)).withColumn("r", F.round("r", 6))


@query("greedy_mmr")
def greedy_mmr(spark, sf):
    return R.mmr(candidates(spark, sf).withColumn("score", F.col("first")), 3)


@query("join_qrels_run", f"WITH {QS.RUNS}, {QS.QRELS} SELECT qid, docid, rel, a.rank AS rank FROM qrels LEFT JOIN a USING (qid, docid)")
def join_qrels_run(spark, sf):
    """Every judgement with the rank that its document has, if any."""
    return QS.qrels(spark, sf).join(QS.run(spark, sf).select("qid", "docid", "rank"), ["qid", "docid"], "left")
