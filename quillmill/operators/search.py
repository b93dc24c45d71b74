"""Corpus statistics, BM25 vectors, sparse, dense, hybrid and filtered top-k search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that are broadcast at a time; more are searched in further blocks.
QUERY_BYTES = 64 << 20
#: Bytes of a product of queries and vectors that a task holds at a time; it makes about four arrays of that size. Few queries reach it.
PRODUCT_BYTES = 4 << 20


def top_k(hits: DataFrame, k: int, keys: list[str], score: str = "score", ties: str = "docid", rank: str = "rank") -> DataFrame:
    """The k best of each group with their rank from 1; equal scores (to 9 decimals) in order of `ties`."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 9)), ties)
    return hits.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def term_counts(tokens: DataFrame) -> DataFrame:
    """docid, token, tf of tokens(docid, token): what all statistics and postings are made from. Written once, it spares them the texts."""
    return tokens.groupBy("docid", "token").agg(F.count(F.lit(1)).alias("tf"))


def text_terms(texts: DataFrame, cut) -> DataFrame:
    """docid, token, tf, dl (all tokens of the docid) of texts(docid, text); cut: the array of a text's tokens.

    Texts go to where their docid is counted, in place of their tokens; lengths are known there, so no join has to bring them.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = texts.repartition(parts, "docid").groupBy("docid").agg(F.collect_list("text").alias("texts"))
    own = own.select("docid", F.flatten(F.transform("texts", cut)).alias("tokens"))
    each = own.select("docid", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("token"))
    return each.groupBy("docid", "dl", "token").agg(F.count(F.lit(1)).alias("tf")).select("docid", "token", "tf", "dl")


def corpus_stats(terms: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row n, avgdl; token, df) of terms(docid, token, tf); docs: all docids, also those without tokens."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    stats = n.crossJoin(terms.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))
    return stats, terms.groupBy("token").agg(F.count("docid").alias("df"))


def idf(df: DataFrame, stats: DataFrame, least_df: int = 1, floor: float = 0.0) -> DataFrame:
    """token, idf: ln((n - df + 0.5) / (df + 0.5)), not below floor; tokens under least_df go."""
    value = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.where(F.col("df") >= least_df).crossJoin(F.broadcast(stats.select("n"))).select("token", "df", F.greatest(value, F.lit(floor)).alias("idf"))


def bm25_vectors(terms: DataFrame, weights: DataFrame, stats: DataFrame, k1: float = 1.2, b: float = 0.75, extra: list[str] | None = None) -> DataFrame:
    """docid, token, weight, and extra columns of weights; zero weights go, which drops the postings of the most frequent tokens before any join. terms may have dl, the lengths of their documents."""
    # one weight a token: its side is hashed, so that the terms need no sorting
    x = terms.where("docid is not null").join(weights.where("idf > 0").hint("shuffle_hash"), "token")
    if "dl" not in terms.columns:
        x = x.join(terms.groupBy("docid").agg(F.sum("tf").alias("dl")), "docid")
    x = x.crossJoin(F.broadcast(stats.select("avgdl")))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    return x.select("docid", "token", (F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("weight"), *(extra or []))


def query_vectors(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """qid, token, weight (the idf) of the distinct known tokens of queries(qid, token)."""
    return tokens.distinct().join(weights.where("idf > 0"), "token").select("qid", "token", F.col("idf").alias("weight"))


def sparse_search(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """qid, docid, score, rank by inner product."""
    hits = queries.withColumnRenamed("weight", "wq").join(postings, "token").groupBy("qid", "docid").agg(F.sum(F.col("wq") * F.col("weight")).alias("score"))
    return top_k(hits, k, ["qid"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(eps)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def query_blocks(queries: DataFrame, block: int) -> Iterator[DataFrame]:
    """The queries in parts of about `block` rows."""
    parts = max(1, -(-queries.count() // block))
    for k in range(parts):
        yield queries if parts == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == k)


def nearest(ids: np.ndarray, asked: np.ndarray, docs: np.ndarray, v: np.ndarray, k: int, metric: str, not_self: bool = False, same: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries, places of vectors and scores of the k best vectors for each query, a bounded product at a time.

    Equal scores (to 9 decimals) are in order of docs. same: a value of each query and of each vector that have to be equal.
    """
    size = (v * v).sum(axis=1)
    step = max(1, PRODUCT_BYTES // (8 * max(1, len(v))))
    for a in range(0, len(ids) if len(v) else 0, step):
        part = asked[a : a + step]
        score = part @ v.T
        if metric == "L2":
            score *= 2
            score -= (part * part).sum(axis=1)[:, None]
            score -= size
        if not_self:
            score[ids[a : a + step, None] == docs] = -np.inf
        if same is not None:
            score[same[0][a : a + step, None] != same[1]] = -np.inf
        rounded = np.round(score, 9)
        # all that tie with the k-th stay until the ties are settled by id
        near = rounded >= np.partition(rounded, -k, axis=1)[:, -k, None] if len(v) > k else np.ones_like(rounded, bool)
        q, d = np.nonzero(near & np.isfinite(rounded))
        order = np.lexsort((docs[d], -rounded[q, d], q))
        q, d = q[order], d[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        q, d = q[best], d[best]
        yield a + q, d, score[q, d]


def _best(sent, k: int, metric: str, not_self: bool):
    """Of each batch of vectors the k best for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, wanted = sent.value
        for b in batches:
            if b.num_rows and len(ids):
                docs = b.column(0).to_numpy(zero_copy_only=False)
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                same = None if wanted is None else (wanted, np.asarray(b.column(2).to_pylist(), object))
                for q, d, score in nearest(ids, matrix, docs, v, k, metric, not_self, same):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(docs[d]), pa.array(score)], ["qid", "docid", "score"])

    return run


def dense_search(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "IP", not_self: bool = False, same: str | None = None) -> DataFrame:
    """qid, docid, score, rank of queries(qid, qvec) over vectors(docid, vec): exact, by matrix products of a block of queries at a time.

    A block has at most QUERY_BYTES of vectors. Each batch of vectors gives its k best for each query, so what is
    shuffled grows with batches and not with pairs. not_self: a query does not find its own id; same: a column that must be
    equal on both sides. L2 distances are squared and negated, so that more is better. Rows without a vector match nothing.
    """
    out = None
    spark = vectors.sparkSession
    width = queries.agg(F.max(F.size("qvec"))).first()[0] or 1
    extra = [same] if same else []
    rows = vectors.where("vec is not null").select("docid", "vec", *extra)
    kinds = dict(queries.dtypes)["qid"], dict(rows.dtypes)["docid"]
    for own in query_blocks(queries.where("qvec is not null"), max(1, QUERY_BYTES // (8 * width))):
        got = own.select("qid", "qvec", *extra).toArrow().combine_chunks()
        matrix = np.array(got["qvec"].to_pylist(), np.float64).reshape(got.num_rows, -1)
        wanted = np.array(got[same].to_pylist(), object) if same else None
        sent = spark.sparkContext.broadcast((got["qid"].to_numpy(), matrix, wanted))
        hits = rows.mapInArrow(_best(sent, k, metric, not_self), f"qid {kinds[0]}, docid {kinds[1]}, score double")
        out = hits if out is None else out.unionByName(hits)
    return top_k(out, k, ["qid"])


def zscore(hits: DataFrame, score: str = "score", out: str = "norm", key: str = "qid") -> DataFrame:
    """(x - mean) / population deviation of each query; unchanged where the deviation is under 1e-6."""
    w = Window.partitionBy(key)
    sd = F.stddev_pop(score).over(w)
    return hits.withColumn(out, F.when(sd < 1e-6, F.col(score)).otherwise((F.col(score) - F.avg(score).over(w)) / sd))


def minmax(hits: DataFrame, constant: float | None, score: str = "score", out: str = "norm", key: str = "qid") -> DataFrame:
    """Scores of each query mapped to 0..1; `constant` where all are equal."""
    w = Window.partitionBy(key)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return hits.withColumn(out, F.when(hi - lo < 1e-12, F.lit(constant).cast("double")).otherwise((F.col(score) - lo) / (hi - lo)))


def fuse(a: DataFrame, b: DataFrame, wa: Column | float, wb: Column | float, k: int) -> DataFrame:
    """Full outer join of two scored runs (qid, docid, norm): wa * a + wb * b, a missing side counts 0 after normalising."""
    x = a.select("qid", "docid", F.col("norm").alias("na"))
    y = b.select("qid", "docid", F.col("norm").alias("nb"))
    both = x.join(y, ["qid", "docid"], "full").select("qid", "docid", F.coalesce("na", F.lit(0.0)).alias("a_score"), F.coalesce("nb", F.lit(0.0)).alias("b_score"))
    as_col = lambda w: w if isinstance(w, Column) else F.lit(float(w))
    return top_k(both.withColumn("score", as_col(wa) * F.col("a_score") + as_col(wb) * F.col("b_score")), k, ["qid"])


def hybrid_search(dense: DataFrame, sparse: DataFrame, k: int, w_dense: float = 0.6, w_sparse: float = 0.4, dense_norm: str = "none", sparse_norm: str = "zscore") -> DataFrame:
    """Fuse per-side top-k hits; queries without sparse hits take the dense side alone."""
    put = lambda h, how: zscore(h) if how == "zscore" else minmax(h, 0.0) if how == "minmax" else h.withColumn("norm", F.col("score"))
    has = sparse.select("qid").distinct().withColumn("has", F.lit(True))
    a = put(dense, dense_norm).join(has, "qid", "left").withColumn("norm", F.when(F.col("has"), F.col("norm") * w_dense).otherwise(F.col("norm")))
    b = put(sparse, sparse_norm).withColumn("norm", F.col("norm") * w_sparse)
    return fuse(a, b, 1.0, 1.0, k)


def rescore(pool: DataFrame, queries: DataFrame, vectors: DataFrame, lexical_queries: DataFrame, lexical: DataFrame, w_dense: float, w_sparse: float, k: int) -> DataFrame:
    """Exact scores of both kinds over the union of candidates (qid, docid), weights made to sum to 1, not normalised."""
    wd, ws = normalize_weights(w_dense, w_sparse)
    d = pool.select("qid", "docid").distinct().join(queries, "qid").join(vectors, "docid").select("qid", "docid", dot(F.col("qvec"), F.col("vec")).alias("dense"))
    s = d.select("qid", "docid").join(lexical_queries.withColumnRenamed("weight", "wq"), "qid").join(lexical, ["docid", "token"]).groupBy("qid", "docid").agg(F.sum(F.col("wq") * F.col("weight")).alias("sparse"))
    both = d.join(s, ["qid", "docid"], "left").withColumn("sparse", F.coalesce("sparse", F.lit(0.0)))
    return top_k(both.withColumn("score", wd * F.col("dense") + ws * F.col("sparse")), k, ["qid"])


def normalize_weights(a: float, b: float) -> tuple[float, float]:
    a, b = max(0.0, a), max(0.0, b)
    return (1.0, 0.0) if a + b == 0 else (a / (a + b), b / (a + b))


def dedup_hits(hits: DataFrame, by: str, k: int) -> DataFrame:
    """The best hit of each (qid, by), ranked anew, at most k of each query."""
    w = Window.partitionBy("qid", by).orderBy("rank", "docid")
    first = hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    again = Window.partitionBy("qid").orderBy("rank", "docid")
    return first.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)


def leak_free(hits: DataFrame, banned: DataFrame, on: list[str]) -> DataFrame:
    """Hits that no row of banned(qid, *on) names; blank values never match."""
    clean = banned.where(" and ".join(f"coalesce(cast({c} as string), '') <> ''" for c in on)).select("qid", *on).distinct()
    return hits.join(clean, ["qid", *on], "left_anti")


def attach(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, hits: the hits of each request in order of rank, an empty array where there are none."""
    got = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "docid"))).alias("hits"))
    return requests.select("qid").join(got, "qid", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<rank:int,docid:bigint>>")))


def leak_filter(hits: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits left, qid with n_self and n_book) of hits(qid, docid, sample_id, image_path, doc_id, ...): those of the query's own
    sample or image go first and are counted as its own, then those of its own document. own: qid, sample_id, image_path, doc_id; blanks match nothing."""
    k = own.select("qid", *[F.col(c).cast("string").alias(f"_{c}") for c in ("sample_id", "image_path", "doc_id")])
    hit = lambda c: F.coalesce((F.coalesce(F.col(c).cast("string"), F.lit("")) != "") & (F.col(c).cast("string") == F.col(f"_{c}")), F.lit(False))
    x = hits.join(k, "qid", "left").withColumn("_self", hit("sample_id") | hit("image_path"))
    x = x.withColumn("_book", ~F.col("_self") & hit("doc_id"))
    counts = x.groupBy("qid").agg(F.count_if("_self").alias("n_self"), F.count_if("_book").alias("n_book"))
    return x.where("not _self and not _book").select(*hits.columns), counts


def hybrid_batch(dense: DataFrame, sparse: DataFrame, queries: DataFrame, k: int, mode: str = "hybrid", weights: tuple[float, float] = (0.6, 0.4), override: tuple[float, float] | None = None, adapt: dict[str, float] | None = None) -> DataFrame:
    """Top k of each query by a mode (dense, sparse or hybrid) over side hits of their own depths; queries: qid, lang, has_terms.

    The mode, or an override, gives the weights; adapt (language to sparse weight) replaces the sparse one, and the dense one by its
    complement only in hybrid mode without an override. A query without known terms takes the dense side alone. Only a
    mode's own sides bring candidates; the sparse side is standardised.
    """
    wd, ws = override or {"dense": (1.0, 0.0), "sparse": (0.0, 1.0)}.get(mode, weights)
    own = F.lit(None).cast("double")
    for lang, w in (adapt or {}).items():
        own = F.coalesce(own, F.when(F.col("lang") == lang, F.lit(float(w))))
    q = queries.withColumn("_ws", F.coalesce(own, F.lit(float(ws))))
    q = q.withColumn("_wd", F.when(own.isNotNull(), 1 - F.col("_ws")).otherwise(float(wd)) if mode == "hybrid" and override is None else F.lit(float(wd)))
    q = q.select("qid", F.when(F.col("has_terms"), F.col("_wd")).otherwise(1.0).alias("_wd"), F.when(F.col("has_terms"), F.col("_ws")).otherwise(0.0).alias("_ws"))
    a = dense.select("qid", "docid", F.col("score").alias("dense")) if mode != "sparse" else dense.limit(0).select("qid", "docid", F.col("score").alias("dense"))
    s = zscore(sparse).select("qid", "docid", F.col("norm").alias("sparse"))
    s = s if mode != "dense" else s.limit(0)
    both = a.join(s, ["qid", "docid"], "full").join(q, "qid").fillna(0.0, ["dense", "sparse"])
    return top_k(both.withColumn("score", F.col("_wd") * F.col("dense") + F.col("_ws") * F.col("sparse")), k, ["qid"]).drop("_wd", "_ws")


def norm_select(hits: DataFrame, method: str, constant: float = 0.0) -> DataFrame:
    """hits with norm by a named method: none, minmax or zscore; constant where a query's scores are all equal."""
    if method == "none":
        return hits.withColumn("norm", F.col("score"))
    if method == "minmax":
        return minmax(hits, constant)
    w = Window.partitionBy("qid")
    sd = F.stddev_pop("score").over(w)
    return hits.withColumn("norm", F.when(sd < 1e-12, F.lit(constant)).otherwise((F.col("score") - F.avg("score").over(w)) / sd))


def over_fetched(hits: DataFrame, k: int, by: str, times: int = 5, cap: int = 16384) -> DataFrame:
    """The best k of each query after only the first times * k hits (cap at most) are thinned to one for each `by`; so fewer than k may be left."""
    return dedup_hits(hits.where(F.col("rank") <= min(times * k, cap)), by, k)
