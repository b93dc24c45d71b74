"""Queries: text functions, cleaning rules, table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curate as K
from ..sources import io, relational
from ..sources.stored import StoredTable
from .base import BLOCKS, blocks, query, table

NORM = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


def _n(cls: str, s: str = "s") -> str:
    return f"len(regexp_extract_all({s}, '{cls}'))"


_SYM = f"CASE WHEN length(s) = 0 THEN 1.0 ELSE {_n('[[:punct:]\\p{P}\\p{S}]')} / length(s) END"
_SYM = f"CASE WHEN length(s) = 0 THEN 1.0 ELSE {_n('[\\p{P}\\p{S}]')} / length(s) END"
_INFO = f"CASE WHEN length(s) = 0 THEN 0.0 ELSE ({_n('\\p{L}')} + {_n('\\p{Nd}')}) / length(s) END"
_STAGE1 = rf"""{BLOCKS}, n AS (SELECT *, {NORM} AS s FROM blocks),
r AS (SELECT *, CASE WHEN s = '' THEN 'empty_text' WHEN char_length < 5 THEN 'too_short_lt_5'
  WHEN regexp_matches(s, '^[\p{{P}}\p{{S}}\s]*$') THEN 'only_symbols' WHEN regexp_matches(s, '^[0-9]{{1,4}}$') THEN 'pure_number'
  WHEN regexp_matches(s, '^.{{1,40}}/[0-9]{{1,4}}$') THEN 'catalog_slash_page'
  WHEN regexp_matches(s, '(?i)^(FIG|Figure|Table)\s*[0-9A-Za-z\-.]*\s*[:：]?\s*$') THEN 'figure_table_short_caption'
  WHEN length(s) <= 120 AND regexp_matches(s, '(?i)(ISBN|Copyright)') THEN 'publication_meta'
  WHEN length(s) <= 40 AND {_SYM} >= 0.6 THEN 'high_symbol_ratio_short'
  WHEN length(s) <= 12 AND {_INFO} < 0.5 THEN 'low_info_density_short' END AS reason0,
  length(s) <= 12 AND regexp_matches(lower(s), 'ercp|eus|esd|emr|nbi') AS safe FROM n),
stage1 AS (SELECT *, CASE WHEN reason0 IS NULL AND NOT safe AND row_number() OVER (PARTITION BY content_hash, reason0 IS NULL AND NOT safe ORDER BY block_id) > 1
  THEN 'duplicate_content_hash' ELSE reason0 END AS reason FROM r)"""


@query("clean_stage1", f"WITH {_STAGE1} SELECT block_id, reason FROM stage1")
def clean_stage1(spark, sf):
    return K.stage1_reason(blocks(spark, sf)).select("block_id", "reason")


@query("agg_reason_counts", f"WITH {_STAGE1} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM stage1), 4) AS share FROM stage1 GROUP BY 1")
def agg_reason_counts(spark, sf):
    return K.reason_counts(K.stage1_reason(blocks(spark, sf)))


@query("reason_examples", f"WITH {_STAGE1} SELECT * FROM (SELECT reason, block_id, row_number() OVER (PARTITION BY reason ORDER BY block_id) AS rn FROM stage1 WHERE reason IS NOT NULL) WHERE rn <= 5")
def reason_examples(spark, sf):
    return K.examples(K.stage1_reason(blocks(spark, sf)), "reason", "block_id")


@query("delete_rejected", f"WITH {_STAGE1} SELECT block_id, doc, char_length FROM stage1 WHERE reason IS NULL")
def delete_rejected(spark, sf):
    b = blocks(spark, sf)
    stored = StoredTable(io.scratch(spark, "kept"), "block_id", "block_id long, doc string, char_length long")
    stored.create(b.select("block_id", "doc", "char_length"))
    stored.delete(K.stage1_reason(b).where("reason is not null").select("block_id"))
    return stored.read(spark)


@query("join_semi_reject", f"WITH {_STAGE1} SELECT block_id, content_hash FROM stage1 WHERE reason IS NOT NULL")
def join_semi_reject(spark, sf):
    b = blocks(spark, sf)
    gone = K.stage1_reason(b).where("reason is not null").select("block_id")
    return b.join(gone, "block_id", "left_semi").select("block_id", "content_hash")


@query("text_signals", f"WITH n AS (SELECT doc_id, {NORM} AS s FROM documents) SELECT doc_id, length(s) AS len, round({_INFO}, 6) AS info_ratio, round({_SYM}, 6) AS symbol_ratio FROM n")
def text_signals(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("s"))
    return s.select("doc_id", F.length("s").alias("len"), F.round(T.info_ratio(F.col("s")), 6).alias("info_ratio"), F.round(T.symbol_ratio(F.col("s")), 6).alias("symbol_ratio"))


def _signals_sql(v: int) -> tuple[str, str]:
    wide = v == 2
    rules = [("char_length <= 8", "very_short", 3), ("char_length > 8 AND char_length <= 15", "short", 1), (f"char_length <= {100 if wide else 80} AND regexp_matches(s, '/[0-9]{{1,4}}$')", "catalog_page_like", 2), ("regexp_matches(s, '(?i)^(FIG|Figure|Table)\\s*[0-9A-Za-z\\-.]*')", "figure_table_like", 2), ("regexp_matches(s, '(?i)(ISBN|Copyright)')", "publication_meta_like", 2), (f"char_length <= {60 if wide else 40} AND regexp_matches(s, '^\\s*\\[?[0-9]{{1,3}}\\]?\\s*[\\.、)]\\s*')", "enumeration_like", 1)]
    if wide:
        rules += [("regexp_matches(s, '^\\s*(?:[A-Za-z][、.:：]\\s*[A-Za-z]{1,10}\\s*){2,}\\s*$')", "enum_fragment_like", 3), ("char_length <= 120 AND regexp_matches(s, '(\\\\text|\\\\mathrm|\\\\mathbb|\\\\spadesuit|\\\\textcircled|\\$\\s*\\\\)')", "latex_ocr_like", 2)]
    rules.append((f"char_length <= {120 if wide else 80} AND {_SYM} >= 0.45", "high_symbol_ratio", 2))
    if wide:
        rules.append((f"{_n('[�□◻◼◇◆※#@$%^&*_+=~`|]')} >= 2", "bad_char_like", 2))
    rules.append((f"char_length <= {24 if wide else 30} AND {_n('[A-Za-z]')} >= 6 AND upper(s) = s", "upper_latin_fragment" if wide else "upper_english_fragment", 1))
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n, _ in rules) + ")", " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for c, _, w in rules)


@query("clean_candidates", f"WITH {BLOCKS}, n AS (SELECT *, {NORM} AS s FROM blocks), g AS (SELECT block_id, char_length, {_signals_sql(1)[0]} AS signals, {_signals_sql(1)[1]} AS score FROM n) SELECT * FROM g WHERE score >= 2 ORDER BY score DESC, char_length, block_id LIMIT 200")
def clean_candidates(spark, sf):
    return K.review_candidates(blocks(spark, sf), 2, 200)


@query("clean_signals_v2", f"WITH {BLOCKS}, n AS (SELECT *, {NORM} AS s FROM blocks) SELECT block_id, {_signals_sql(2)[0]} AS signals, {_signals_sql(2)[1]} AS score FROM n")
def clean_signals_v2(spark, sf):
    names, score = K.signals(F.col("text"), F.col("char_length"), 2)
    return blocks(spark, sf).select("block_id", F.array_join(names, ",").alias("signals"), score.alias("score"))


_BAD = _n("[�□◻◼◇◆※#@$%^&*_+=~`|]")
_LATEX = "regexp_matches(s, '(\\\\text|\\\\mathrm|\\\\mathbb|\\\\spadesuit|\\\\textcircled|\\$\\s*\\\\)')"
_MED = "regexp_matches(s, '(ERCP|EUS|ESD|EMR|NBI)')"
_STAGE2 = rf"""{BLOCKS}, n AS (SELECT *, {NORM} AS s FROM blocks), d AS (SELECT *, {_signals_sql(2)[1]} AS score,
  CASE WHEN s = '' THEN 'empty_text' WHEN char_length <= 3 THEN 'very_short' WHEN regexp_matches(s, '(CIP|ISBN|p\.[0-9]+)') THEN 'hard_drop_non_content_meta_or_catalog'
  WHEN regexp_matches(s, '^[0-9]{{1,4}}$') THEN 'pure_number' WHEN regexp_matches(s, '^[\p{{P}}\p{{S}}\s]*$') THEN 'only_symbols'
  WHEN char_length <= 50 AND regexp_matches(s, '^\s*(?:[A-Za-z][、.:：]\s*[A-Za-z]{{1,10}}\s*){{2,}}\s*$') AND NOT {_MED} THEN 'enum_fragment_without_medical_semantics'
  WHEN {_LATEX} AND {_n("[A-Za-z]")} <= 5 THEN 'latex_ocr_noise' WHEN {_SYM} >= 0.62 AND char_length <= 60 THEN 'high_symbol_ratio_short'
  WHEN {_BAD} >= 3 AND char_length <= 80 THEN 'bad_chars_noise' WHEN char_length <= 20 THEN 'short_without_retrieval_signal'
  WHEN char_length <= 80 AND {_MED} AND regexp_matches(s, '^[1-5]\.') THEN 'low_retrieval_value_fragment'
  WHEN {_LATEX} AND {_n("[A-Za-z]")} >= 8 THEN 'has_semantics_but_latex_ocr_polluted' ELSE 'to_llm' END AS reason0 FROM n),
e AS (SELECT *, CASE WHEN reason0 = 'to_llm' THEN NULL WHEN reason0 = 'has_semantics_but_latex_ocr_polluted' THEN 'rewrite' ELSE 'drop' END AS action0 FROM d),
stage2 AS (SELECT *, CASE WHEN action0 IS NULL AND score < 2 THEN 'low_risk_after_candidate_filter' ELSE reason0 END AS reason,
  CASE WHEN action0 IS NULL AND score < 2 THEN 'keep' ELSE coalesce(action0, 'llm') END AS action,
  CASE WHEN action0 = 'drop' THEN 5 WHEN action0 IS NULL AND score < 2 THEN 70 END AS quality FROM e)"""


@query("clean_stage2_rules", f"WITH {_STAGE2} SELECT block_id, action, reason, score FROM stage2")
def clean_stage2_rules(spark, sf):
    return K.stage2_decision(blocks(spark, sf)).select("block_id", "action", "reason", "score")


@query("clean_stage2_route", f"WITH {_STAGE2} SELECT action, quality, count(*) AS n FROM stage2 GROUP BY 1, 2")
def clean_stage2_route(spark, sf):
    return K.stage2_decision(blocks(spark, sf)).groupBy("action", "quality").agg(F.count(F.lit(1)).alias("n"))


@query("rewrite_guard", "SELECT doc_id, sha256(CASE WHEN trim(new) = '' OR length(text) >= 20 AND length(new) < floor(length(text) * 0.6) THEN text ELSE new END) AS text_hash FROM (SELECT *, substr(text, 1, (doc_id * 37) % 400) AS new FROM documents)")
def rewrite_guard(spark, sf):
    d = table(spark, sf, "documents").withColumn("new", F.expr("substr(text, 1, cast((doc_id * 37) % 400 as int))"))
    return d.select("doc_id", F.sha2(K.rewrite_or_keep(F.col("text"), F.col("new")), 256).alias("text_hash"))


@query("apply_rewrites", "SELECT doc_id, length(t) AS char_length, sha256(t) AS content_hash FROM (SELECT d.doc_id, coalesce(r.text || '!', d.text) AS t FROM documents d LEFT JOIN (SELECT * FROM documents WHERE doc_id % 7 = 1) r ON d.doc_id = r.doc_id WHERE d.doc_id % 5 <> 0)")
def apply_rewrites(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    gone, new = d.where("doc_id % 5 = 0").select("doc_id"), d.where("doc_id % 7 = 1").select("doc_id", F.concat("text", F.lit("!")).alias("new"))
    stored = StoredTable(io.scratch(spark, "rewritten"), "doc_id", "doc_id long, text string")
    stored.create(d)
    stored.update(new, {"text": F.col("new.new")})
    stored.delete(gone)
    out = stored.read(spark).withColumnRenamed("text", "t")
    return out.select("doc_id", F.length("t").alias("char_length"), F.sha2("t", 256).alias("content_hash"))


@query("candidate_pool_filter", f"WITH n AS (SELECT doc_id, {NORM} AS s FROM documents), r AS (SELECT *, CASE WHEN length(s) = 0 THEN 'empty' WHEN length(s) < 40 THEN 'too_short' WHEN length(s) > 5000 THEN 'too_long' WHEN contains(s, 'License') THEN 'low_conf' END AS r0 FROM n) SELECT doc_id, CASE WHEN r0 IS NULL AND row_number() OVER (PARTITION BY s, r0 IS NULL ORDER BY doc_id) > 1 THEN 'duplicate' ELSE r0 END AS reason FROM r")
def candidate_pool_filter(spark, sf):
    return K.pool_reasons(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", 40, 5000, ("License",)).select("doc_id", "reason")


@query("bad_en_token", r"SELECT token, length(token) < 3 OR length(token) > 40 OR regexp_matches(token, '^[-''_]|[-''_]$') OR regexp_matches(token, 'aaaa|bbbb|cccc|dddd|eeee|ffff|gggg|hhhh|iiii|jjjj|kkkk|llll|mmmm|nnnn|oooo|pppp|qqqq|rrrr|ssss|tttt|uuuu|vvvv|wwww|xxxx|yyyy|zzzz|0000|1111|2222|3333|4444|5555|6666|7777|8888|9999|____|----|’’’’|''''''''') OR (length(token) >= 12 AND regexp_matches(token, '^[acgt]+$')) OR NOT regexp_matches(token, '[aeiou0-9]') AS bad FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9’''_\-]+')) AS token FROM documents WHERE doc_id < 1000000)")
def bad_en_token(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(T.tokens_en(F.col("text"), 1 << 30)).alias("token")).distinct()
    return t.select("token", K.bad_token(F.col("token")).alias("bad"))


@query("win_dedup_hash", f"WITH {BLOCKS} SELECT block_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY block_id) AS rn FROM blocks) WHERE rn = 1")
def win_dedup_hash(spark, sf):
    return K.first_per(blocks(spark, sf), ["content_hash"], ["block_id"]).select("block_id", "content_hash")


@query("win_lag_lead", "SELECT doc_id, sha256(coalesce(lag(text) OVER (ORDER BY doc_id), '')) AS prev_hash, sha256(coalesce(lead(text) OVER (ORDER BY doc_id), '')) AS next_hash FROM documents")
def win_lag_lead(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return K.lag_lead(d, "doc_id", "text", 100).select("doc_id", F.sha2("prev", 256).alias("prev_hash"), F.sha2("next", 256).alias("next_hash"))


@query("join_neighbors", "WITH d AS (SELECT * FROM documents) SELECT d.doc_id, length(coalesce(p.text, '')) AS prev_len, length(coalesce(n.text, '')) AS next_len FROM d LEFT JOIN d p ON p.doc_id = d.doc_id - 1 LEFT JOIN d n ON n.doc_id = d.doc_id + 1")
def join_neighbors(spark, sf):
    b = blocks(spark, sf).select("block_id", "text")
    return K.neighbours(b).select(F.col("block_id").alias("doc_id"), F.length("prev_text").alias("prev_len"), F.length("next_text").alias("next_len"))


@query("update_doc_stats", f"WITH {BLOCKS}, k AS (SELECT * FROM blocks WHERE doc <> 'src1') SELECT s.doc, count(k.block_id) AS block_count, coalesce(max(k.page_idx) + 1, 0) AS page_count FROM (SELECT DISTINCT doc FROM blocks) s LEFT JOIN k ON s.doc = k.doc GROUP BY 1")
def update_doc_stats(spark, sf):
    """Counts of documents are set in their stored table, once some blocks have gone."""
    b = blocks(spark, sf)
    stored = StoredTable(io.scratch(spark, "documents"), "doc", "doc string, block_count long, page_count long", 16)
    docs = b.select("doc").distinct()
    stored.create(docs.withColumns({"block_count": F.lit(-1).cast("long"), "page_count": F.lit(-1).cast("long")}))
    stored.update(K.document_stats(docs, b.where("doc <> 'src1'"), "doc"), {c: F.col(f"new.{c}") for c in ("block_count", "page_count")})
    return stored.read(spark)


@query("upsert_document", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_name || '*' FROM customer WHERE c_custkey % 10 = 0")
def upsert_document(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_name")
    changed = old.where("c_custkey % 10 = 0").withColumn("c_name", F.concat("c_name", F.lit("*")))
    stored = StoredTable(io.scratch(spark, "customers"), "c_custkey", "c_custkey long, c_name string")
    stored.create(old.where("c_custkey % 20 <> 0"))
    stored.upsert(changed)
    return stored.read(spark)


@query("append_new_only", "SELECT doc_id, lang FROM documents WHERE doc_id % 4 = 0")
def append_new_only(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    return K.append_new(d.where("doc_id % 4 <> 0"), d, "doc_id")


@query("insert_hash_dedup", f"WITH {BLOCKS} SELECT content_hash FROM blocks GROUP BY 1 HAVING count(*) FILTER (WHERE block_id % 3 = 0) = 0")
def insert_hash_dedup(spark, sf):
    b = blocks(spark, sf).select("block_id", "content_hash")
    return K.append_new(b.where("block_id % 3 = 0"), b.where("block_id % 3 <> 0"), "content_hash").select("content_hash")


@query("append_blocks", "SELECT doc_id, length(trim(text)) AS char_length FROM documents WHERE lang = 'en' AND length(trim(text)) >= 3")
def append_blocks(spark, sf):
    d = table(spark, sf, "documents").where("lang = 'en'").select("doc_id", F.length(F.trim("text")).alias("char_length"))
    return d.where("char_length >= 3")


@query("scan_sqlite_blocks", f"WITH {BLOCKS}, d AS (SELECT source AS doc, count(*) AS n_blocks FROM documents GROUP BY 1) SELECT block_id, blocks.doc, n_blocks, char_length FROM blocks JOIN d ON blocks.doc = d.doc WHERE char_length BETWEEN 50 AND 4000 ORDER BY block_id")
def scan_sqlite_blocks(spark, sf):
    """Blocks of a length from a relational store, joined to their documents, in order; the length filter runs in the store."""
    path = io.scratch(spark, "blocks")
    stored = blocks(spark, sf).select("block_id", "doc", "page_idx", "text", "char_length")
    relational.write_relational(stored, path, "text_blocks", "block_id")
    found = relational.read_relational(spark, path, "text_blocks", "block_id", "block_id long, doc string, char_length long")
    d = table(spark, sf, "documents").groupBy(F.col("source").alias("doc")).agg(F.count(F.lit(1)).alias("n_blocks"))
    return K.text_blocks(found, d, least=50, most=4000).select("block_id", "doc", "n_blocks", "char_length")


@query("join_block_doc", f"WITH {BLOCKS}, d AS (SELECT source AS doc, min(lang) AS lang FROM documents WHERE lang <> 'fr' GROUP BY 1) SELECT block_id, blocks.doc, lang FROM blocks JOIN d ON blocks.doc = d.doc")
def join_block_doc(spark, sf):
    d = table(spark, sf, "documents").where("lang <> 'fr'").groupBy(F.col("source").alias("doc")).agg(F.min("lang").alias("lang"))
    return K.text_blocks(blocks(spark, sf), d).select("block_id", "doc", "lang")


@query("join_block_doc_left", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_block_doc_left(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")


@query("agg_db_stats", f"WITH {BLOCKS} SELECT count(*) AS n_blocks, count(DISTINCT doc) AS n_docs, sum(char_length) AS chars, round(avg(char_length), 2) AS avg_chars FROM blocks")
def agg_db_stats(spark, sf):
    return blocks(spark, sf).agg(F.count(F.lit(1)).alias("n_blocks"), F.count_distinct("doc").alias("n_docs"), F.sum("char_length").alias("chars"), F.round(F.avg("char_length"), 2).alias("avg_chars"))


@query("agg_type_counts", "SELECT source, sum(n)::BIGINT AS n, string_agg(lang || ':' || n, ',' ORDER BY lang) AS types FROM (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1")
def agg_type_counts(spark, sf):
    """Counts of each document's types of blocks, in all and by type."""
    d = table(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"))
    one = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    types = F.array_sort(F.collect_list(F.struct("lang", "n")))
    return one.groupBy("source").agg(F.sum("n").alias("n"), F.array_join(F.transform(types, lambda x: F.concat_ws(":", x["lang"], x["n"].cast("string"))), ",").alias("types"))


@query("distinct_count", f"WITH {BLOCKS} SELECT count(DISTINCT content_hash) AS n_hash, count(DISTINCT text) AS n_text FROM blocks")
def distinct_count(spark, sf):
    return blocks(spark, sf).agg(F.count_distinct("content_hash").alias("n_hash"), F.count_distinct("text").alias("n_text"))


@query("detect_lang", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 'mix' WHEN en / greatest(en, 1) >= 0.6 THEN 'en' ELSE 'mix' END AS lang FROM (SELECT doc_id, text, len(regexp_extract_all(text, '[A-Za-z]')) AS en FROM documents)")
def detect_lang(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.detect_lang(F.col("text")).alias("lang"))


@query("tokenise", r"SELECT doc_id, len(t) AS n, t[1] AS first_token, t[len(t)] AS last_token FROM (SELECT doc_id, list_slice(regexp_extract_all(lower(text), '[a-z0-9’''_\-]+'), 1, 4000) AS t FROM documents)")
def tokenise(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.tokens_en(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.get("t", F.lit(0)).alias("first_token"), F.get("t", F.size("t") - 1).alias("last_token"))


@query("char_ngram_similarity", "WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, length(s) - 1), lambda i: substr(s, i, 3))) AS g FROM (SELECT item_id, regexp_replace(lower(text), '[^0-9a-z]', '', 'g') AS s FROM benchmark)) SELECT a.item_id, b.item_id AS other, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS jaccard, round(len(list_intersect(a.g, b.g)) / len(a.g), 6) AS containment FROM g a JOIN g b ON b.item_id = a.item_id + 1")
def char_ngram_similarity(spark, sf):
    g = table(spark, sf, "benchmark").select("item_id", T.char_ngrams(F.col("text")).alias("g"))
    o = g.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("g").alias("h"))
    return g.join(o, "item_id").select("item_id", "other", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("jaccard"), F.round(T.containment(F.col("g"), F.col("h")), 6).alias("containment"))


@query("hashing", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, md5(text) AS md5, ('0x' || substr(sha1(text), 1, 15))::BIGINT AS stable64 FROM documents")
def hashing(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.sha1(t).alias("sha1"), F.sha2(t, 256).alias("sha256"), F.md5(t).alias("md5"), T.stable_int64(t).alias("stable64"))


@query("truncate_text", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short FROM documents")
def truncate_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate(F.col("text"), 100).alias("short"))


@query("near_dup_text", r"SELECT a.doc_id, min(b.doc_id) AS first_doc FROM documents a JOIN documents b ON regexp_replace(a.text, '\s+', '', 'g') = regexp_replace(b.text, '\s+', '', 'g') GROUP BY 1")
def near_dup_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(T.strip_all(F.col("text")), 256).alias("k"))
    return d.join(d.groupBy("k").agg(F.min("doc_id").alias("first_doc")), "k").select("doc_id", "first_doc")


#: A text for each rule, with full-width digits, wide spaces and Chinese, and what the rules make of it.
_ZH1 = [
    ("\u3000", "empty_text"), ("胃", "too_short_lt_2"), ("……！", "only_symbols"), ("１２３４", "pure_number"), ("病例\u3000１２", "short_label_with_number"), ("第三章", "chapter_only_heading"), ("胃镜检查概论/１２", "catalog_slash_page"),
    ("图 1：", "figure_table_short_caption"), ("本书版权所有", "publication_meta"), ("胃（）……、、", "high_symbol_ratio_short"), ("①②③④a", "low_info_density_short"), ("胃窦可见息肉样隆起病变", None), ("１２３４５", None),
]
_ZH2 = [
    ("胃镜下", "drop", "very_short"), ("视频\u3000１２ 演示胃镜操作", "drop", "hard_drop_non_content_meta_or_catalog"), ("１２３４", "drop", "pure_number"), ("！！？？。。", "drop", "only_symbols"),
    ("ａ、前壁 ｂ、后壁 ｃ、小弯", "drop", "enum_fragment_without_medical_semantics"), ("\\text 1", "drop", "latex_ocr_noise"), ("胃（）（）（）（）", "drop", "high_symbol_ratio_short"), ("□□□胃体部黏膜光滑", "drop", "bad_chars_noise"),
    ("胃体部黏膜光滑", "drop", "short_without_retrieval_signal"), ("胃体大弯侧大小的病变位于后壁近贲门处的黏膜隆起", "drop", "low_retrieval_value_fragment"), ("内镜下可见胃窦部黏膜充血水肿" * 7, "keep", "long_semantic_sentence"),
    ("内镜检查提示胃窦部溃疡需要随访处理", "keep", "low_risk_after_candidate_filter"), ("图1 内镜检查提示胃窦部溃疡需要随访", "llm", "medical_statement_needs_llm_validation"),
    ("\\mathrm{ab} 这一段文字说明了实验的基本方法和结果分析", "rewrite", "has_semantics_but_latex_ocr_polluted"), ("这一段文字说明了实验的基本方法和结果分析过程", "keep", "low_risk_after_candidate_filter"),
]


def _planted(spark, sf, texts):
    t = F.get(F.array(*map(F.lit, texts)), (F.col("block_id") % len(texts)).cast("int"))
    return blocks(spark, sf).withColumn("text", t).withColumn("char_length", F.length(F.trim("text")).cast("long"))


def _constants(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query("clean_stage1_zh", f"SELECT doc_id AS block_id, {_constants(r for _, r in _ZH1)}[doc_id % {len(_ZH1)} + 1] AS reason FROM documents")
def clean_stage1_zh(spark, sf):
    return K.stage1_reason(_planted(spark, sf, [t for t, _ in _ZH1]), min_length=2, dedup=False).select("block_id", "reason")


@query("clean_stage2_zh", f"SELECT doc_id AS block_id, {_constants(a for _, a, _ in _ZH2)}[doc_id % {len(_ZH2)} + 1] AS action, {_constants(r for *_, r in _ZH2)}[doc_id % {len(_ZH2)} + 1] AS reason FROM documents")
def clean_stage2_zh(spark, sf):
    return K.stage2_decision(_planted(spark, sf, [t for t, *_ in _ZH2])).select("block_id", "action", "reason")


_LANG = ["胃窦部溃疡ab", "plain English text here", "胃镜检查所见 ESD x", "", "１２３"]


@query("detect_lang_zh", f"SELECT doc_id, {_constants(['zh', 'en', 'mix', 'mix', 'mix'])}[doc_id % 5 + 1] AS lang FROM documents")
def detect_lang_zh(spark, sf):
    return _planted(spark, sf, _LANG).select(F.col("block_id").alias("doc_id"), T.detect_lang(F.col("text")).alias("lang"))
