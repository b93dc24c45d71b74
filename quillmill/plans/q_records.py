"""Queries: record shaping and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import build as B
from ..operators import dataset as D
from ..operators import records as R
from .base import BLOCKS, blocks, query, table


@query("extract_doc_id", "SELECT page_id, substr(split_part(u, '__', len(string_split(u, '__'))), 1, 16) AS doc FROM (SELECT page_id, 'store__' || replace(url, '/', '__') AS u FROM pages)")
def extract_doc_id(spark, sf):
    u = F.concat(F.lit("store__"), F.replace("url", F.lit("/"), F.lit("__")))
    return table(spark, sf, "pages").select("page_id", R.doc_id_of(u).alias("doc"))


@query("canonicalize_type", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'discarded' WHEN contains(html, '<table') THEN 'table' WHEN page_id % 5 = 0 THEN 'equation' WHEN contains(html, '<img') THEN 'image' WHEN trim(html) <> '' THEN 'text' ELSE 'other' END AS kind FROM pages")
def canonicalize_type(spark, sf):
    html, k = F.col("html"), F.col("page_id")
    kind = F.when(k % 7 == 0, " Header ").otherwise("text")
    return table(spark, sf, "pages").select("page_id", R.block_type(kind, ("header", "footer"), ("list",), html.contains("<table"), k % 5 == 0, html.contains("<img"), html).alias("kind"))


@query("label_flags", "SELECT doc_id, list_contains(t, 'any') AS is_general, NOT list_contains(t, 'any') AND len(list_distinct(t)) >= 2 AS is_mixed, CASE WHEN list_contains(t, 'any') THEN 'any' ELSE t[1] END AS main FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN [lang, source] WHEN 1 THEN [source, 'any'] ELSE [lang, lang] END AS t FROM documents)")
def label_flags(spark, sf):
    m = F.col("doc_id") % 3
    t = F.when(m == 0, F.array("lang", "source")).when(m == 1, F.array(F.col("source"), F.lit("any"))).otherwise(F.array("lang", "lang"))
    general, mixed = R.tag_flags(F.col("t"), "any")
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", general.alias("is_general"), mixed.alias("is_mixed"), R.main_tag(F.col("t"), "any").alias("main"))


@query("dedup_tags", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source ELSE lang END AS tags FROM documents")
def dedup_tags(spark, sf):
    t = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source", "lang")).otherwise(F.array("lang", "lang"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_distinct(t), ",").alias("tags"))


@query("drop_null_options", "SELECT doc_id, 1 + (doc_id % 3 <> 0)::INT AS n, CASE WHEN doc_id % 3 = 0 THEN 'A' ELSE 'A,B' END AS letters FROM documents")
def drop_null_options(spark, sf):
    m = F.create_map(F.lit("A"), F.col("lang"), F.lit("B"), F.when(F.col("doc_id") % 3 == 0, " N/A ").otherwise("x"), F.lit("C"), F.lit(None).cast("string"))
    return table(spark, sf, "documents").select("doc_id", R.real_options(m).alias("o")).select("doc_id", F.size("o").alias("n"), F.array_join(F.map_keys("o"), ",").alias("letters"))


@query("format_evidence", "SELECT conv_id, string_agg('[' || rn || '] ' || left(text, 40), chr(10) ORDER BY rn) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) GROUP BY 1")
def format_evidence(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    lines = F.transform("t", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(x["text"], 1, 40)))
    return g.select("conv_id", F.array_join(lines, "\n").alias("evidence"))


@query("build_query_text", "SELECT item_id, text || chr(10) || 'A. x' || chr(10) || 'B. ' || item_id AS q FROM benchmark")
def build_query_text(spark, sf):
    o = F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.col("item_id").cast("string"))
    return table(spark, sf, "benchmark").select("item_id", B.question_text(F.col("text"), o).alias("q"))


@query("anchor_score", "SELECT doc_id, round(s, 6) AS score, least(r, CASE WHEN s >= 0.6 THEN 'A' WHEN s >= 0.35 THEN 'B' ELSE 'C' END) AS final FROM (SELECT doc_id, CASE WHEN a >= 1 AND l >= 1 AND d >= 1 THEN 'A' WHEN a >= 1 OR l >= 1 THEN 'B' ELSE 'C' END AS r, least(1.0, greatest(0.0, 0.4 * least(a / 2.0, 1) + 0.4 * least(l / 2.0, 1) + 0.2 * 0.5 - 0.1 * (doc_id % 2) - 0.05 * 0.0))::DOUBLE AS s FROM (SELECT doc_id, doc_id % 3 AS a, doc_id % 4 AS l, doc_id % 5 AS d FROM documents))")
def anchor_score(spark, sf):
    d, zero = F.col("doc_id"), F.lit(0)
    x = R.anchor_score({"anatomy": d % 3, "lesion": d % 4, "attribute": d % 5, "distribution": zero, "severity": zero, "context": zero}, {"specificity": F.lit(0.5), "generic_penalty": (d % 2).cast("double"), "deictic_penalty": F.lit(0.0)}, {"anatomy": 0.4, "lesion": 0.4, "specificity": 0.2, "generic_penalty": 0.1, "deictic_penalty": 0.05}, {"anatomy": 2, "lesion": 2}, 0.6, 0.35)
    return table(spark, sf, "documents").select("doc_id", F.round(x["score"], 6).alias("score"), x["final"].alias("final"))


@query("softmax", "SELECT vec_id, round(exp(embedding[1]::DOUBLE) / (exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE) + exp(embedding[3]::DOUBLE)), 6) AS p FROM embeddings")
def softmax(spark, sf):
    v = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.get(R.softmax(v), F.lit(0)), 6).alias("p"))


@query("update_labels", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def update_labels(spark, sf):
    """Labels filled in by key; repeated or unknown keys are errors."""
    rows = table(spark, sf, "documents").select("doc_id", F.lit(None).cast("long").alias("quality"))
    return D.backfilled(rows, table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"], "quality").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("first_n_nonblank", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE trim(text) <> '') WHERE rn <= 3")
def first_n_nonblank(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").where("trim(text) <> ''").select("conv_id", "turn", F.row_number().over(w).alias("rn")).where("rn <= 3").drop("rn")


@query("resume_progress", f"WITH {BLOCKS} SELECT page_idx % 4 AS shard, count(*) AS assigned, count(l.doc_id) AS done, count(*) - count(l.doc_id) AS remaining FROM blocks LEFT JOIN labels l ON block_id = l.doc_id GROUP BY 1")
def resume_progress(spark, sf):
    b = blocks(spark, sf).select("block_id", (F.col("page_idx") % 4).alias("shard"))
    x = b.join(table(spark, sf, "labels").select(F.col("doc_id").alias("block_id"), F.lit(1).alias("d")), "block_id", "left")
    return x.groupBy("shard").agg(F.count(F.lit(1)).alias("assigned"), F.count("d").alias("done")).withColumn("remaining", F.col("assigned") - F.col("done"))


@query("label_meta", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN 'any' ELSE '' END AS main FROM documents")
def label_meta(spark, sf):
    """The main site: the generic tag if it is there, else the first, else empty."""
    m = F.col("doc_id") % 3
    t = F.when(m == 0, F.array("lang", "source")).when(m == 1, F.array(F.col("source"), F.lit("any"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", R.main_tag(t, "any").alias("main"))


@query("text_functions", r"SELECT item_id, md5(trim(regexp_replace(text || chr(12288) || ' x', '[\s\x{3000}]+', ' ', 'g'))) AS clean, CASE WHEN length(text) > 30 THEN left(text, 30) || '...' ELSE text END AS cut, CASE WHEN length(text) > 30 THEN left(text, 27) || '...' ELSE text END AS within, regexp_extract('/a/b' || item_id || '/c.txt', '[^/]+$') AS base FROM benchmark")
def text_functions(spark, sf):
    """White space of all scripts collapsed; both ways to cut a text; a path's last part."""
    from ..functions import text as T

    t = F.concat("text", F.lit("\u3000 x"))
    return table(spark, sf, "benchmark").select("item_id", F.md5(T.normalize(t)).alias("clean"), T.truncate(F.col("text"), 30).alias("cut"), T.truncate_within(F.col("text"), 30).alias("within"), T.base_name(F.concat(F.lit("/a/b"), F.col("item_id").cast("string"), F.lit("/c.txt"))).alias("base"))
