"""What the operators of this package share: reading, staging, tiling, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that ends a word, as characters and as a regex class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text whose words a task holds at once.
PART_BYTES = 4_000_000
#: Stands for a null doc_id inside operators, so that all nulls count as one last document.
NO_ID = (1 << 63) - 1
#: Paths that this application has staged.
_staged: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_or_last(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def id_back(c: Column) -> Column:
    return F.when(c != NO_ID, c)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a single machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts lineage and survives lost executors.

    The files go when the application ends, or earlier by unstage() or released().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillmill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged DataFrame that nothing will read again."""
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/quillmill/" in path:
            fs, at = _hadoop(df.sparkSession, path)
            fs.delete(at, True)


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Afterwards deletes all that was staged inside, but for the frames put into the list it gives."""
    before, kept = len(_staged), []
    try:
        yield kept
    finally:
        keep = {x.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in kept for x in df.inputFiles()}
        for path in _staged[before:]:
            if path.rsplit("/", 1)[-1] not in keep:
                fs, at = _hadoop(spark, path)
                fs.delete(at, True)
                _staged.remove(path)


def held(c: Column) -> Column:
    """c, computed once: a caller's filter on it is not pushed down into what it is made of.

    Catalyst moves a filter below deterministic projections by substituting their expressions, which would compute an
    array again for each of its elements. A condition that counts as non-deterministic, and always holds, ends that.
    """
    return F.when(F.monotonically_increasing_id() >= 0, c)


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct, so that no column of the caller's clashes with a working column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))


def parts(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to rows whose texts (of that column) have about `most` bytes, one row at least."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False))
        ends = np.append(np.flatnonzero(np.diff(size // most)) + 1, b.num_rows)
        for a, z in zip(np.append(0, ends[:-1]), ends, strict=True):
            yield b.slice(int(a), int(z - a))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges(u, v), u != v.

    Alternates the large-star and small-star steps of Kiveris et al. (2014). Each round's edges and
    least neighbours are staged; nothing but a count and a checksum reaches the driver. Least neighbours come
    from a partial aggregation; joins with them have an exchange on either side, so that Spark can split
    a node with very many links. Empty edges give an empty result.
    """
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        for done in (now, low, large, least):
            unstage(done)
        now = after
        if seen is not None and tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def tiled(df: DataFrame, key: str, order: list[str], tile: int, least: int = 1) -> DataFrame:
    """Deal rows of each key into pairs of tiles of at most `tile` rows: adds _a, _b (the pair) and _side.

    A key with no more than `tile` rows has the one pair (0, 0). A larger one is split: every pair of
    its tiles (a <= b) becomes a group of its own, so any two rows of a key meet in some group and no
    group holds more than two tiles. Tile sizes come from a partial count, ranks from a hash of the
    row, so no key is ever gathered in one task. Keys of under `least` rows go.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    spread = df.join(counts, key).withColumn("_t", F.ceil(F.col("_n") * F.lit(2.0) / tile).cast("int"))
    one = F.col("_n") <= tile
    mine = F.pmod(F.xxhash64(*order), F.greatest(F.col("_t"), F.lit(1))).cast("int")
    spread = spread.withColumn("_m", F.when(one, F.lit(0)).otherwise(mine))
    other = F.when(one, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.col("_t") - 1, F.lit(0))))
    return (
        spread.withColumn("_o", F.explode(other))
        .withColumn("_a", F.least("_m", "_o"))
        .withColumn("_b", F.greatest("_m", "_o"))
        .drop("_n", "_t", "_o")
    )
