"""Fusion of runs and reordering by verifier signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import fuse, minmax, top_k, zscore


def linear(a: DataFrame, b: DataFrame, wa: float, wb: float, k: int, normalize: bool = True, constant: float = 1.0) -> DataFrame:
    put = lambda r: minmax(r, constant) if normalize else r.withColumn("norm", F.col("score"))
    return fuse(put(a), put(b), wa, wb, k)


def rrf(a: DataFrame, b: DataFrame, k: int, depth: int, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over both runs, ranks to depth; the first rank of a repeated document counts."""
    part = lambda r: r.where(F.col("rank") <= depth).groupBy("qid", "docid").agg(F.min("rank").alias("rank"))
    both = part(a).unionByName(part(b)).groupBy("qid", "docid").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("score"))
    return top_k(both, k, ["qid"])


def with_signals(run: DataFrame, cache: DataFrame) -> DataFrame:
    """run with cls_prob and score_prob of cache(qid, docid, ...); 0 where the cache has none."""
    got = run.join(cache.select("qid", "docid", "cls_prob", "score_prob"), ["qid", "docid"], "left")
    return got.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("cls_prob", "score_prob")})


def partition(run: DataFrame, threshold: float, signal: str = "cls_prob") -> DataFrame:
    """Documents at or above the threshold first, both parts in the order they had."""
    w = Window.partitionBy("qid").orderBy((F.col(signal) < threshold).cast("int"), "rank")
    return run.withColumn("new_rank", F.row_number().over(w))


def pipeline(run: DataFrame, threshold: float, within: str = "score_prob", rest: str = "keep") -> DataFrame:
    """partition, then the first part by `within` (highest first), the rest by rank or by a score."""
    low = F.col("cls_prob") < threshold
    key = F.when(~low, -F.col(within)).otherwise(F.lit(0.0) if rest == "keep" else -F.col(rest))
    w = Window.partitionBy("qid").orderBy(low.cast("int"), key, "rank")
    return run.withColumn("new_rank", F.row_number().over(w))


def grid_fusion(run: DataFrame, grid: DataFrame, norm: str = "minmax") -> DataFrame:
    """For every row (lam, mu) of grid: norm + lam * score_prob + mu * cls_prob, ties by rank. One plan for the whole sweep."""
    base = zscore(run) if norm == "zscore" else minmax(run, 0.0) if norm == "minmax" else run.withColumn("norm", F.col("score"))
    x = base.crossJoin(F.broadcast(grid)).withColumn("final", F.col("norm") + F.col("lam") * F.col("score_prob") + F.col("mu") * F.col("cls_prob"))
    w = Window.partitionBy("lam", "mu", "qid").orderBy(F.desc(F.round("final", 9)), "rank")
    return x.withColumn("new_rank", F.row_number().over(w))


def three_signal(run: DataFrame, w_retr: float, w_score: float, w_cls: float, mode: str = "minmax", constant: int = 60) -> DataFrame:
    """Weighted sum of three signals, each min-max normalised or turned to 1 / (constant + rank)."""
    x = run
    for c in ("score", "score_prob", "cls_prob"):
        if mode == "minmax":
            x = minmax(x, 0.0, c, f"n_{c}")
        else:
            x = x.withColumn(f"n_{c}", 1.0 / (constant + F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(c), "docid"))))
    x = x.withColumn("final", w_retr * F.col("n_score") + w_score * F.col("n_score_prob") + w_cls * F.col("n_cls_prob"))
    return top_k(x, 1 << 30, ["qid"], "final", rank="new_rank")


def sev_rerank(run: DataFrame, mode: str = "fuse", alpha: float = 0.5, beta: float = 0.5, threshold: float = 0.5) -> DataFrame:
    """partition: score n - i + 1 in the new order; fuse: alpha * score_prob + beta * cls_prob."""
    if mode == "partition":
        n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
        return partition(run, threshold).withColumn("final", (n - F.col("new_rank") + 1).cast("double"))
    return top_k(run.withColumn("final", alpha * F.col("score_prob") + beta * F.col("cls_prob")), 1 << 30, ["qid"], "final", ties="rank", rank="new_rank")


def blend_top(run: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha * minmax(first stage) + (1 - alpha) * verifier, the best k."""
    x = minmax(run, 0.5).withColumn("final", alpha * F.col("norm") + (1 - alpha) * F.col("cls_prob"))
    return top_k(x, k, ["qid"], "final", rank="new_rank")
