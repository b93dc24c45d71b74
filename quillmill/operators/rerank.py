"""Candidate graphs and selections: personalised PageRank, submodular, cluster medoids. One group is one query's candidates (tens of rows)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import dot, minmax


def pair_similarity(cands: DataFrame) -> DataFrame:
    """qid, i, j, sim (cosine, not below 0) of each ordered pair i != j of a query's candidates(qid, idx, emb unit vectors)."""
    a = cands.select("qid", F.col("idx").alias("i"), F.col("emb").alias("x"))
    b = cands.select("qid", F.col("idx").alias("j"), F.col("emb").alias("y"))
    return a.join(b, "qid").where("i <> j").select("qid", "i", "j", F.greatest(dot(F.col("x"), F.col("y")), F.lit(0.0)).alias("sim"))


def adjacency(cands: DataFrame, top_m: int = 8, boost: float = 0.15, least: float = 0.45) -> DataFrame:
    """qid, i, j, w: each candidate's top_m neighbours, made symmetric by the larger weight; pairs of different
    source and one group raised by boost, to at least `least` and at most 1."""
    sim = pair_similarity(cands)
    w = Window.partitionBy("qid", "i").orderBy(F.desc(F.round("sim", 9)), "j")
    near = sim.withColumn("r", F.row_number().over(w)).where("r <= {} and sim > 0".format(top_m)).select("qid", "i", "j", "sim")
    both = near.unionByName(near.select("qid", F.col("j").alias("i"), F.col("i").alias("j"), "sim")).groupBy("qid", "i", "j").agg(F.max("sim").alias("w"))
    a = cands.select("qid", F.col("idx").alias("i"), F.col("source").alias("sa"), F.col("group_id").alias("ga"))
    b = cands.select("qid", F.col("idx").alias("j"), F.col("source").alias("sb"), F.col("group_id").alias("gb"))
    paired = a.join(b, "qid").where("i <> j and sa <> sb and ga = gb").select("qid", "i", "j", F.lit(True).alias("paired"))
    out = both.join(paired, ["qid", "i", "j"], "full")
    raised = F.least(F.greatest(F.coalesce("w", F.lit(0.0)) + boost, F.lit(least)), F.lit(1.0))
    return out.select("qid", "i", "j", F.when(F.col("paired"), raised).otherwise(F.col("w")).alias("w"))


def unit(x: np.ndarray) -> np.ndarray:
    lo, hi = x.min(), x.max()
    return np.full(len(x), 0.5) if hi - lo < 1e-12 else (x - lo) / (hi - lo)


def restart(cands: DataFrame, beta: float = 0.5) -> DataFrame:
    """qid, idx, r: where walks begin anew: scaled first-stage scores and similarities to the query, mixed, summing to 1 for each query."""
    sim = cands.select("qid", "idx", "first", F.greatest(dot(F.col("emb"), F.col("qvec")), F.lit(0.0)).alias("sim"))
    x = minmax(minmax(sim, 0.5, "first", "_f"), 0.5, "sim", "_q")
    raw = beta * F.col("_f") + (1 - beta) * F.col("_q")
    return x.withColumn("r", raw / F.greatest(F.sum(raw).over(Window.partitionBy("qid")), F.lit(1e-8))).select("qid", "idx", "r")


def mmr(cands: DataFrame, k: int, redundancy: float = 0.2, bonus: float = 0.05, least_gain: float = 0.0) -> DataFrame:
    """qid, idx, pos: a greedy choice by score less redundancy, pairs across sources favoured; always k while there are k. cands: qid, idx, emb, source, group_id, score."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        got = greedy(g["score"].to_numpy(float), np.array(g["emb"].tolist(), float), g["source"].to_numpy(), g["group_id"].to_numpy(), k, redundancy, bonus, least_gain)
        return pd.DataFrame({"qid": g["qid"].iloc[0], "idx": g["idx"].to_numpy()[got], "pos": range(1, len(got) + 1)})

    return cands.select("qid", "idx", "emb", "source", "group_id", "score").groupBy("qid").applyInPandas(run, "qid long, idx long, pos long")


def graph(emb: np.ndarray, source: np.ndarray, group: np.ndarray, top_m: int, boost: float, least: float) -> np.ndarray:
    """The matrix form of adjacency()."""
    sim = np.maximum(emb @ emb.T, 0)
    np.fill_diagonal(sim, 0)
    order = np.argsort(-np.round(sim, 9), axis=1, kind="stable")[:, :top_m]
    keep = np.zeros_like(sim, bool)
    np.put_along_axis(keep, order, True, axis=1)
    out = np.where(keep, sim, 0)
    out = np.maximum(out, out.T)
    pair = (source[:, None] != source[None]) & (group[:, None] == group[None])
    return np.where(pair, np.minimum(np.maximum(out + boost, least), 1), out)


def walk(weights: np.ndarray, restart: np.ndarray, alpha: float, iters: int) -> np.ndarray:
    step = weights / np.maximum(weights.sum(axis=1, keepdims=True), 1e-8)
    s = restart.copy()
    for _ in range(iters):
        s = alpha * restart + (1 - alpha) * (step.T @ s)
    return s


def greedy(score: np.ndarray, emb: np.ndarray, source: np.ndarray, group: np.ndarray, k: int, redundancy: float, bonus: float, least_gain: float) -> list[int]:
    """By marginal gain: score less redundancy with what is chosen, plus a bonus for completing a pair. A gain below
    least_gain ends the search; the best scores then fill up to k."""
    order = [int(i) for i in np.argsort(-score, kind="stable")]
    chosen: list[int] = []
    left = order.copy()
    while left and len(chosen) < k:
        gains = []
        for i in left:
            far = max((float(emb[i] @ emb[j]) for j in chosen), default=0.0)
            pair = any(group[i] == group[j] and source[i] != source[j] for j in chosen)
            gains.append(float(score[i]) - redundancy * far + bonus * pair)
        best = int(np.argmax(gains))
        if chosen and gains[best] < least_gain:
            break
        chosen.append(left.pop(best))
    return (chosen + [i for i in order if i not in chosen])[:k]


def submodular(emb: np.ndarray, source: np.ndarray, support: np.ndarray, k: int, w_disc: float, w_cover: float, w_cross: float, threshold: float) -> list[int]:
    """Greedy on discriminability + capped option coverage + coherence of similar pairs across sources."""
    disc = discriminability(support)
    chosen: list[int] = []
    total = np.zeros(support.shape[1])
    while len(chosen) < min(k, len(emb)):
        best, gain = -1, -np.inf
        for i in range(len(emb)):
            if i in chosen:
                continue
            cross = sum(s for j in chosen if source[i] != source[j] and (s := float(emb[i] @ emb[j])) >= threshold)
            cover = np.minimum(total + support[i], 1).sum() - np.minimum(total, 1).sum()
            if (g := w_disc * disc[i] + w_cover * cover + w_cross * cross) > gain + 1e-12:
                best, gain = i, g
        chosen.append(best)
        total += support[best]
    return chosen


def discriminability(support: np.ndarray) -> np.ndarray:
    if support.shape[1] < 2:
        return support.max(axis=1, initial=0)
    top = -np.sort(-support, axis=1)
    return top[:, 0] - top[:, 1]


def ward(dist: np.ndarray, clusters: int) -> np.ndarray:
    """Labels of agglomerative clustering by Ward's update of squared distances."""
    n = len(dist)
    d = dist.astype(float) ** 2
    size, label, live = np.ones(n), np.arange(n), list(range(n))
    while len(live) > clusters:
        sub = d[np.ix_(live, live)] + np.diag(np.full(len(live), np.inf))
        a, b = np.unravel_index(np.argmin(sub), sub.shape)
        a, b = live[min(a, b)], live[max(a, b)]
        for c in live:
            if c not in (a, b):
                t = size[a] + size[b] + size[c]
                d[a, c] = d[c, a] = ((size[a] + size[c]) * d[a, c] + (size[b] + size[c]) * d[b, c] - size[c] * d[a, b]) / t
        size[a] += size[b]
        label[label == b] = a
        live.remove(b)
    return np.unique(label, return_inverse=True)[1]


def medoids(emb: np.ndarray, query: np.ndarray, first: np.ndarray, clusters: int = 3, top: int = 2, k: int = 3, first_weight: float = 0.3) -> list[int]:
    """Medoids of the best clusters, then the best of the rest with a bonus for clusters not yet shown."""
    n = len(emb)
    if n <= k:
        return list(range(n))
    sim = np.maximum(emb @ query, 0)
    dist = 1 - np.clip(emb @ emb.T, -1, 1)
    np.fill_diagonal(dist, 0)
    label = ward(dist, min(clusters, n))
    ranked = []
    for c in range(label.max() + 1):
        own = np.flatnonzero(label == c)
        stage = unit(first[own]).mean() if len(own) > 1 else float(first[own][0])
        medoid = int(own[np.argmin(dist[np.ix_(own, own)].mean(axis=1))])
        ranked.append((-((1 - first_weight) * sim[own].mean() + first_weight * stage), c, medoid))
    chosen = [m for _, _, m in sorted(ranked)[:top]]
    shown = {int(label[i]) for i in chosen}
    rest = 0.5 * unit(sim) + 0.5 * unit(first) + 0.1 * np.array([int(x) not in shown for x in label])
    return (chosen + [int(i) for i in np.argsort(-rest, kind="stable") if i not in chosen])[:k]


def rerank(cands: DataFrame, method: str, k: int = 3, top_m: int = 8, boost: float = 0.15, least: float = 0.45, alpha: float = 0.15, iters: int = 10, redundancy: float = 0.2, bonus: float = 0.05, least_gain: float = 0.0, beta: float = 0.5) -> DataFrame:
    """qid, idx, pos, score of each query's selection. method: ppr, odsc or vcms.

    cands(qid, idx, emb, source, group_id, first, qvec, options array of option vectors).
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        emb = np.array(g["emb"].tolist(), float)
        source, group, first = g["source"].to_numpy(), g["group_id"].to_numpy(), g["first"].to_numpy(float)
        query = np.array(g["qvec"].iloc[0], float)
        if method == "ppr":
            restart = beta * unit(first) + (1 - beta) * unit(np.maximum(emb @ query, 0))
            restart = restart / max(restart.sum(), 1e-8)
            score = walk(graph(emb, source, group, top_m, boost, least), restart, alpha, iters)
            picked = greedy(score, emb, source, group, k, redundancy, bonus, least_gain)
        elif method == "odsc":
            support = np.maximum(emb @ np.array(g["options"].iloc[0].tolist(), float).T, 0)
            score = discriminability(support)
            picked = submodular(emb, source, support, k, 1.0, 0.5, 0.2, 0.5)
        else:
            score = np.maximum(emb @ query, 0)
            picked = medoids(emb, query, first, k=k)
        idx = g["idx"].to_numpy()
        return pd.DataFrame({"qid": g["qid"].iloc[0], "idx": idx[picked], "pos": np.arange(1, len(picked) + 1), "score": score[picked]})

    return cands.groupBy("qid").applyInPandas(run, "qid long, idx long, pos long, score double")


def ppr_scores(cands: DataFrame, top_m: int = 8, boost: float = 0.15, least: float = 0.45, alpha: float = 0.15, iters: int = 10) -> DataFrame:
    """qid, idx, score after `iters` steps of the walk, restarting by query similarity."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        emb = np.array(g["emb"].tolist(), float)
        restart = np.maximum(emb @ np.array(g["qvec"].iloc[0], float), 0)
        restart = restart / max(restart.sum(), 1e-8)
        score = walk(graph(emb, g["source"].to_numpy(), g["group_id"].to_numpy(), top_m, boost, least), restart, alpha, iters)
        return pd.DataFrame({"qid": g["qid"], "idx": g["idx"], "score": score})

    return cands.groupBy("qid").applyInPandas(run, "qid long, idx long, score double")


def support(cands: DataFrame, options: DataFrame) -> DataFrame:
    """qid, idx, option, support: positive part of the product of each candidate with each option of its query."""
    return cands.join(options, "qid").select("qid", "idx", "option", F.greatest(dot(F.col("emb"), F.col("ovec")), F.lit(0.0)).alias("support"))


def top_two_gap(supports: DataFrame) -> DataFrame:
    """qid, idx, disc: the best less the second support; the best alone where there is one option."""
    got = supports.groupBy("qid", "idx").agg(F.sort_array(F.collect_list("support"), asc=False).alias("s"))
    return got.select("qid", "idx", F.when(F.size("s") < 2, F.get("s", F.lit(0))).otherwise(F.get("s", F.lit(0)) - F.get("s", F.lit(1))).alias("disc"))
