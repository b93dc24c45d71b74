"""Registration of queries, and the stand-in tables that queries share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame, and the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as text blocks: block_id, doc, page_idx, text, content_hash, char_length."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("block_id"), F.col("source").alias("doc"), F.floor(F.col("doc_id") / 20).alias("page_idx"), "text", F.sha2("text", 256).alias("content_hash"), F.length(F.trim("text")).cast("long").alias("char_length"))


BLOCKS = "blocks AS (SELECT doc_id AS block_id, source AS doc, doc_id // 20 AS page_idx, text, sha256(text) AS content_hash, length(trim(text)) AS char_length FROM documents)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def fixture(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Stand-in rows by SQL that both engines read; T_name is the table name."""
    return spark.sql(re.sub(r"\bT_(\w+)\b", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", sql))


def plain(sql: str) -> str:
    """The same SQL for the engine that knows the tables by name."""
    return re.sub(r"\bT_(\w+)\b", r"\1", sql)
