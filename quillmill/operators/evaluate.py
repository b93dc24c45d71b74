"""Ranking metrics, grouped accuracies, paired outcomes and their tests."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ranking_metrics(run: DataFrame, qrels: DataFrame, k: int = 10, pos: str = "rank") -> DataFrame:
    """qid, ndcg, mrr, recall at k for every qid of qrels(qid, docid, rel); queries without hits score 0.

    Gain is 2^rel - 1, the ideal order comes from qrels, and pos is the order of the run's file.
    """
    discount = lambda c: F.log2(c + 1)
    gain = lambda c: F.pow(F.lit(2.0), c) - 1
    ideal_rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "docid"))
    ideal = qrels.withColumn("i", ideal_rank).groupBy("qid").agg(F.sum(F.when(F.col("i") <= k, gain(F.col("rel")) / discount(F.col("i")))).alias("idcg"), F.count_if(F.col("rel") > 0).alias("n_rel"))
    top = run.where(F.col(pos) <= k).join(qrels, ["qid", "docid"])
    got = top.groupBy("qid").agg(F.sum(gain(F.col("rel")) / discount(F.col(pos))).alias("dcg"), F.min(F.when(F.col("rel") > 0, F.col(pos))).alias("first"), F.count_if(F.col("rel") > 0).alias("found"))
    return ideal.join(got, "qid", "left").select(
        "qid",
        F.when(F.col("idcg") > 0, F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0))).otherwise(0.0).alias("ndcg"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("n_rel") > 0, F.coalesce(F.col("found") / F.col("n_rel"), F.lit(0.0))).otherwise(0.0).alias("recall"),
    )


def recall_at(run: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Share of qids of gold(qid, docid) whose one document has rank <= k, for each k."""
    best = gold.join(run, ["qid", "docid"], "left").groupBy("qid").agg(F.min("rank").alias("rank"))
    return best.agg(*[F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")).alias(f"recall_{k}") for k in ks])


def rank_shift(before: DataFrame, after: DataFrame, gold: DataFrame) -> DataFrame:
    x = gold.join(before.select("qid", "docid", F.col("rank").alias("rank_before")), ["qid", "docid"])
    x = x.join(after.select("qid", "docid", F.col("rank").alias("rank_after")), ["qid", "docid"])
    return x.withColumn("delta", F.col("rank_before") - F.col("rank_after"))


def by_sets(rows: DataFrame, sets: list[list[str]], aggs: list[Column]) -> DataFrame:
    """Aggregates over several grouping sets in one pass; `level` names the set's columns."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    cols = [F.col(c) for c in columns]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.grouping_id().alias("gid"), *aggs)
    level = F.lit(None).cast("string")
    for s in sets:
        gid = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s)
        level = F.when(F.col("gid") == gid, F.lit("|".join(s) or "overall")).otherwise(level)
    return out.withColumn("level", level).drop("gid")


def quadrants(a: Column, b: Column) -> list[Column]:
    return [F.count_if(a & b).alias("cc"), F.count_if(a & ~b).alias("cw"), F.count_if(~a & b).alias("wc"), F.count_if(~a & ~b).alias("ww")]


def mcnemar_chi2(b: Column, c: Column) -> Column:
    return F.when(b + c == 0, 0.0).otherwise(F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)).cast("double"), 2) / (b + c))


def exact_p(b: int, c: int) -> float:
    """Two-sided exact binomial p-value of discordant counts, at most 1."""
    n = int(b) + int(c)
    if n == 0:
        return 1.0
    # logs of the binomial coefficients up to the smaller count, each from the one before
    i = np.arange(1, min(b, c) + 1)
    log = np.append(0.0, np.cumsum(np.log(n - i + 1) - np.log(i))) - n * math.log(2)
    return min(1.0, 2 * float(np.exp(log).sum()))


@F.pandas_udf(DoubleType())
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([exact_p(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype=float)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def paired_bootstrap(pairs: DataFrame, resamples: int = 1000, seed: int = 7, strata: list[str] | None = None) -> DataFrame:
    """delta, low, high (2.5 and 97.5 percentiles) of mean(b) - mean(a) over resampled pairs.

    A resample of n pairs with replacement is a draw from the multinomial distribution of how many pairs gain, lose
    and stay; so only those counts are resampled, for each stratum with a generator of its own. pairs: key, a, b (booleans). With
    strata, each stratum's share of the mean is held fixed.
    """
    diff = F.col("b").cast("int") - F.col("a").cast("int")
    keys = strata or []
    counts = pairs.groupBy(*keys).agg(F.count_if(diff < 0).alias("less"), F.count_if(diff == 0).alias("same"), F.count_if(diff > 0).alias("more"))
    marked = counts.select(F.xxhash64(F.lit(seed), *keys).alias("mark"), "less", "same", "more")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for mark, *n in d.itertuples(index=False):
                total = sum(n)
                got = np.random.default_rng([seed, mark % (1 << 63)]).multinomial(total, np.array(n) / total, resamples)
                yield pd.DataFrame({"r": np.arange(resamples), "s": (got[:, 2] - got[:, 0]).astype(float), "m": total})

    means = marked.mapInPandas(draw, "r long, s double, m long").groupBy("r").agg((F.sum("s") / F.sum("m")).alias("x"))
    ci = means.agg(F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))
    return pairs.agg(F.avg(diff).alias("delta")).crossJoin(ci)


def macro_f1(rows: DataFrame, label: str, pred: str) -> DataFrame:
    """class, n, precision, recall, f1 of every class of either column."""
    cell = rows.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    long = cell.select(F.explode(F.array(F.struct(F.col("l").alias("class"), F.col("n").alias("of"), F.lit(0).cast("long").alias("as")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("of"), F.col("n").alias("as")))).alias("x"), "l", "p", "n")
    got = long.groupBy("x.class").agg(F.sum("x.of").alias("n"), F.sum("x.as").alias("n_pred"), F.sum(F.when((F.col("l") == F.col("p")) & (F.col("x.of") > 0), F.col("n")).otherwise(0)).alias("tp"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    got = got.withColumns({"precision": div(F.col("tp"), F.col("n_pred")), "recall": div(F.col("tp"), F.col("n"))})
    return got.withColumn("f1", div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("class", "n", "precision", "recall", "f1")


def order_statistics(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], cells: int = 1024) -> DataFrame:
    """keys and, for each name, the value at a rank from 0 (a column of n, the group's rows) in ascending order.

    Groups are cut to cells of equal width and counted; only the cell that holds a rank is ordered.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("n"))
    width = F.greatest((F.col("_hi") - F.col("_lo")).cast("double") / cells, F.lit(1e-300))
    x = rows.join(ends.drop("n"), keys).withColumn("_c", F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(cells - 1))).drop("_lo", "_hi")
    counts = x.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias("_m"))
    before = counts.withColumn("_b", F.sum("_m").over(Window.partitionBy(*keys).orderBy("_c")) - F.col("_m"))
    wanted = ends.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), r.cast("long").alias("r")) for k, r in ranks.items()])).alias("_w"))
    hit = before.join(wanted, keys).where((F.col("_b") <= F.col("_w.r")) & (F.col("_w.r") < F.col("_b") + F.col("_m"))).select(*keys, "_c", F.col("_w.k").alias("_k"), (F.col("_w.r") - F.col("_b")).alias("_r"))
    inside = x.join(hit, [*keys, "_c"]).withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_k").orderBy("_v")) - 1).where("_n = _r")
    return inside.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(k) for k in ranks])
