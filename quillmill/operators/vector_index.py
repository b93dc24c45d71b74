"""An inverted-file index of vectors, kept as Parquet lists.

Centroids come from k-means over a bounded sample, by sums that are added up along a tree. Every vector is then put in the list of
its nearest centroid; lists are partitions of a Parquet table, so that the lists a search probes are all it reads. A long list
is many files, which many tasks read. How many lists to probe is calibrated on the sample when the index is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import io
from .search import QUERY_BYTES, dense_search, nearest, top_k

#: Vectors that centroids are fitted on at most, rounds of fitting, and bytes of centroids at most (they are broadcast).
SAMPLE, ROUNDS, CENTROID_BYTES = 65_536, 8, 64 << 20
#: Rows of a file of a list at most.
FILE_ROWS = 100_000
#: Sampled vectors that the number of probes is calibrated with, neighbours of each, and the share of them to be found.
ASKED, NEIGHBOURS, TARGET = 256, 10, 0.97
#: Rows whose distances to all centroids a task holds at a time, in bytes.
DISTANCE_BYTES = 32 << 20


@dataclass(frozen=True)
class VectorIndex:
    """path of the lists, what they hold, and the centroids by list number."""

    path: str
    width: int
    metric: str
    nprobe: int
    centroids: np.ndarray

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def rows(self, spark: SparkSession, kind: str = "long") -> DataFrame:
        """docid, vec, list of all rows; kind: the type of docid."""
        return spark.read.schema(f"docid {kind}, vec array<float>, list int").parquet(f"{self.path}/lists")


def matrix(vectors: pa.Array) -> np.ndarray:
    n = len(vectors)
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def affinity(v: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """Of rows and centroids, more is nearer: the inner product, or the squared distance short of the row's own square, negated."""
    product = v @ centroids.T
    return product if metric == "IP" else 2 * product - (centroids * centroids).sum(axis=1)


def nearest_list(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The list each vector belongs to: that of the centroid at least distance, the first of equals."""
    step = max(1, DISTANCE_BYTES // (8 * len(centroids)))
    parts = [affinity(v[a : a + step], centroids, "L2").argmax(axis=1) for a in range(0, len(v), step)]
    return np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)


def _sums(sent):
    """Of a partition, one row: sums of the vectors nearest each centroid, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        found = np.zeros((len(centroids), centroids.shape[1] + 1))
        for b in batches:
            v = matrix(b.column(0))
            if len(v):
                own = nearest_list(v, centroids)
                order = np.argsort(own, kind="stable")
                cells, first = np.unique(own[order], return_index=True)
                found[cells, :-1] += np.add.reduceat(v[order], first)
                found[cells, -1] += np.diff(np.append(first, len(v)))
        yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], ["sums"])

    return run


def fit(sample: DataFrame, width: int, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of at most so many lists for sample(docid, vec), a bounded and stored table. Starts from its first distinct vectors by a hash of their ids."""
    spark = sample.sparkSession
    first = sample.orderBy(F.xxhash64("docid"), "docid").limit(lists).toArrow()["vec"].combine_chunks()
    centroids = np.unique(matrix(first), axis=0) if len(first) else np.zeros((0, width))
    for _ in range(rounds if len(centroids) else 0):
        sent = spark.sparkContext.broadcast(centroids)
        parts = sample.select("vec").mapInArrow(_sums(sent), "sums binary").rdd.map(lambda r: np.frombuffer(r[0]))
        total = parts.treeReduce(np.add).reshape(len(centroids), width + 1)
        many = total[:, -1:]
        centroids = np.where(many > 0, total[:, :-1] / np.maximum(many, 1), centroids)
        sent.destroy()
    return centroids


def _assigned(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = nearest_list(matrix(b.column(1)), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32())], ["docid", "vec", "list"])

    return run


def _probes(sent, nprobe: int, metric: str):
    """Of each query the lists to probe, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, found = matrix(b.column(1)), []
            step = max(1, DISTANCE_BYTES // (8 * len(sent.value)))
            for a in range(0, len(v), step):
                found.append(np.argsort(-affinity(v[a : a + step], sent.value, metric), axis=1, kind="stable")[:, :nprobe])
            flat = np.concatenate(found).astype(np.int32).ravel() if found else np.zeros(0, np.int32)
            ends = np.arange(0, len(flat) + 1, nprobe, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(flat))], ["qid", "qvec", "lists"])

    return run


def probes(queries: DataFrame, centroids: np.ndarray, nprobe: int, metric: str) -> DataFrame:
    """queries(qid, qvec) with lists, the numbers of the lists they probe, best first."""
    sent = queries.sparkSession.sparkContext.broadcast(centroids)
    kind = dict(queries.dtypes)["qid"]
    return queries.where("qvec IS NOT NULL").select("qid", F.col("qvec").cast("array<float>").alias("qvec")).mapInArrow(_probes(sent, nprobe, metric), f"qid {kind}, qvec array<float>, lists array<int>")


def _calibrated(sample: DataFrame, centroids: np.ndarray, metric: str) -> int:
    """Lists that hold the target share of the sampled vectors' neighbours in the sample, from the best list on.

    Neighbours in a sample are farther away than in the whole, so the whole needs no more probes.
    """
    asked = sample.orderBy(F.xxhash64(F.lit("asked"), "docid"), "docid").limit(ASKED).select(F.col("docid").alias("qid"), F.col("vec").alias("qvec"))
    hits = dense_search(asked, sample, NEIGHBOURS, metric, not_self=True).select("qid", "docid")
    own = sample.mapInArrow(_assigned(sample.sparkSession.sparkContext.broadcast(centroids)), sample.schema.simpleString()[7:-1].replace(":", " ", 1).replace(",vec:", ", vec ") + ", list int")
    order = probes(asked, centroids, len(centroids), metric).select("qid", "lists")
    place = hits.join(own.select("docid", "list"), "docid").join(order, "qid").select(F.array_position("lists", F.col("list")).alias("place"))
    found = place.agg(F.percentile("place", F.lit(TARGET))).first()[0]
    return int(np.ceil(found)) if found else len(centroids)


def build(vectors: DataFrame, path: str, width: int, metric: str = "IP", lists: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> VectorIndex:
    """Write the index of vectors(docid, vec) to a path and return it. metric is IP (inner product) or L2 (squared distance).

    lists: how many, the root of the number of vectors unless given, and no more than CENTROID_BYTES of centroids. Centroids are
    fitted on at most about `sample` vectors, picked by a hash of docid; every vector is indexed. Rows without a vector or an id are left out; a vector of
    another width is an error. Repeated ids and copies are rows of their own. No vectors make an index without lists.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec IS NOT NULL AND docid IS NOT NULL").select("docid", F.col("vec").cast("array<float>").alias("vec"))
    n, other = rows.agg(F.count(F.lit(1)), F.count_if(F.size("vec") != width)).first()
    if other:
        raise ValueError(f"{other} vectors are not of width {width}")
    picked = rows if n <= sample else rows.where(F.pmod(F.xxhash64(F.lit("sample"), "docid"), F.lit(1 << 30)) < F.lit(int((1 << 30) * (sample / n))))
    kept = io.written(picked, "sample")
    lists = max(1, min(lists or round(n**0.5), CENTROID_BYTES // (8 * width)))
    centroids = fit(kept, width, lists, rounds)
    nprobe = _calibrated(kept, centroids, metric) if len(centroids) else 0
    kind = dict(rows.dtypes)["docid"]
    if len(centroids):
        placed = rows.mapInArrow(_assigned(spark.sparkContext.broadcast(centroids)), f"docid {kind}, vec array<float>, list int")
        # ranges of list and hash are of even size: a long list is dealt to many tasks, and to many files
        tasks = max(1, -(-n // FILE_ROWS))
        dealt = io.written(placed, "placed").repartitionByRange(tasks, "list", F.xxhash64("docid")).sortWithinPartitions("list")
        dealt.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("list").parquet(f"{path}/lists")
    found = [(k, c.tolist()) for k, c in enumerate(centroids)]
    spark.createDataFrame(found, "list int, vec array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    # written last: what has no description is no index
    spark.createDataFrame([(width, metric, nprobe, n)], "width int, metric string, nprobe int, n long").coalesce(1).write.parquet(f"{path}/about")
    return VectorIndex(path, width, metric, nprobe, centroids)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/about/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load(spark: SparkSession, path: str) -> VectorIndex:
    about = spark.read.parquet(f"{path}/about").first()
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()["vec"].combine_chunks()
    return VectorIndex(path, about["width"], about["metric"], about["nprobe"], matrix(rows) if len(rows) else np.zeros((0, about["width"])))


def ensure(vectors: DataFrame, path: str, width: int, metric: str = "IP", **options: int) -> VectorIndex:
    """The index at a path if there is one, which must have this width and metric; else a new one."""
    spark = vectors.sparkSession
    if not exists(spark, path):
        return build(vectors, path, width, metric, **options)
    found = load(spark, path)
    if (found.width, found.metric) != (width, metric):
        raise ValueError(f"the index at {path} is of width {found.width} and metric {found.metric}, not {width} and {metric}")
    return found


def _in_lists(sent, k: int, metric: str, not_self: bool):
    """Of each batch of list rows, the k best for each query that probes their list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked, cells, who = sent.value
        for b in batches:
            docs, v, own = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1)), b.column(2).to_numpy()
            for cell in np.unique(own):
                mine = np.flatnonzero(own == cell)
                a, z = np.searchsorted(cells, [cell, cell + 1])
                if z > a:
                    q = who[a:z]
                    for one, other, score in nearest(ids[q], asked[q], docs[mine], v[mine], k, metric, not_self):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q][one]), pa.array(docs[mine][other]), pa.array(score)], ["qid", "docid", "score"])

    return run


def search(index: VectorIndex, queries: DataFrame, k: int, nprobe: int | None = None, not_self: bool = False, kind: str = "long", block_bytes: int = QUERY_BYTES) -> DataFrame:
    """qid, docid, score, rank of queries(qid, qvec): the k best of the nprobe nearest lists (all of them: exact).

    Queries go out in blocks of at most block_bytes; those whose best list is the same go together, and a block reads only the
    lists it probes. Equal scores are in order of docid. Queries without a vector find nothing. kind: the type of docid.
    """
    spark = queries.sparkSession
    nprobe = max(1, min(nprobe or index.nprobe, index.lists))
    types = f"qid {dict(queries.dtypes)['qid']}, docid {kind}, score double"
    if not index.lists:
        return top_k(spark.createDataFrame([], types), k, ["qid"])
    probing = io.written(probes(queries, index.centroids, nprobe, index.metric).withColumn("home", F.col("lists")[0]), "probing")
    most = max(1, block_bytes // (8 * index.width + 8 * nprobe))
    # whole homes share a block; a home with more queries than a block has is split by hash
    homes, block, used = [], 0, 0
    for r in probing.groupBy("home").agg(F.count(F.lit(1)).alias("n")).orderBy("home").toLocalIterator():
        if used + r["n"] > most and used:
            block, used = block + 1, 0
        pieces = -(-r["n"] // most)
        homes.append((r["home"], block, pieces))
        block, used = (block, used + r["n"]) if pieces == 1 else (block + pieces, 0)
    blocks = block + (used > 0)
    dealt = probing
    if blocks > 1:
        of = F.broadcast(spark.createDataFrame(homes, "home int, first int, pieces int"))
        dealt = io.written(probing.join(of, "home").withColumn("block", F.col("first") + F.pmod(F.xxhash64("qid"), F.col("pieces")).cast("int")), "blocks")
    out: DataFrame | None = None
    for b in range(blocks):
        got = (dealt.where(F.col("block") == b) if blocks > 1 else dealt).select("qid", "qvec", "lists").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        lists = got["lists"].combine_chunks().flatten().to_numpy()
        order = np.argsort(lists, kind="stable")
        sent = spark.sparkContext.broadcast((got["qid"].to_numpy(), matrix(got["qvec"].combine_chunks()), lists[order], (order // nprobe).astype(np.int32)))
        wanted = np.unique(lists).tolist()
        there = index.rows(spark, kind)
        hits = (there if len(wanted) == index.lists else there.where(F.col("list").isin(wanted))).mapInArrow(_in_lists(sent, k, index.metric, not_self), types)
        if blocks > 1:
            hits = io.written(top_k(hits, k, ["qid"]).drop("rank"), "hits")
            sent.destroy()
        out = hits if out is None else out.unionByName(hits)
    return top_k(out if out is not None else spark.createDataFrame([], types), k, ["qid"])
