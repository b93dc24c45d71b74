"""Queries: parsers of runs, judgements, caches and JSON columns; sinks' text forms; incremental summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import io
from ..streaming import ingest
from . import q_search as QS
from .base import query, table


@query("scan_benchmark", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') ORDER BY sha1('b:' || doc_id), doc_id LIMIT 50 OFFSET 10")
def scan_benchmark(spark, sf):
    d = table(spark, sf, "documents").where(F.col("lang").isin("en", "de")).select("doc_id")
    return d.orderBy(F.sha1(F.concat(F.lit("b:"), F.col("doc_id").cast("string"))), "doc_id").offset(10).limit(50)


@query("scan_replay", "SELECT a.item_id, b.first AS hit FROM benchmark a LEFT JOIN (SELECT lower(text) AS k, min(item_id) AS first FROM benchmark WHERE item_id % 2 = 0 GROUP BY 1) b ON lower(a.text) = b.k")
def scan_replay(spark, sf):
    b = table(spark, sf, "benchmark")
    rec = b.where("item_id % 2 = 0").select(F.col("text").alias("query"), F.col("item_id").alias("pos"), F.col("item_id").alias("results"))
    return io.replay(rec, b.select("item_id", F.upper("text").alias("query")).withColumn("query", F.lower("query"))).select("item_id", F.col("results").alias("hit"))


@query("scan_pdf_text", "SELECT doc_id, ['en', 'ja', 'ko', 'zh', 'en'][doc_id % 5 + 1] AS lang FROM documents")
def scan_pdf_text(spark, sf):
    """The language of a sample of the first pages, by its scripts."""
    texts = F.array(*map(F.lit, ("plain English words", "これはテストです", "한국어 문장", "这是中文文本", "mostly English with 中")))
    t = F.concat(F.get(texts, (F.col("doc_id") % 5).cast("int")), F.repeat(F.lit(" "), 3))
    return table(spark, sf, "documents").select("doc_id", io.language_of(F.substring(t, 1, 2000)).alias("lang"))


@query("first_answer_letter", "SELECT doc_id, nullif(upper(chr((65 + doc_id % 7)::INT)), 'G') AS letter FROM documents")
def first_answer_letter(spark, sf):
    t = F.concat(F.lit("thinking B\n\nThe answer: "), F.char(65 + F.col("doc_id") % 7), F.lit(".\n \n"))
    return table(spark, sf, "documents").select("doc_id", T.last_line_answer(t).alias("letter"))


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    return ingest.windowed_counts(table(spark, sf, "events"))
