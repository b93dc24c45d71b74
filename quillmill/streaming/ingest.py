"""Incremental ingest: a directory of files as a stream, merged by key; and windowed summaries with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def merge_stream(spark: SparkSession, source: str, schema: str, key: str, order: str, target: str, checkpoint: str, compact: int = 20) -> StreamingQuery:
    """Ingest JSON files that arrive in `source` into Parquet parts under `target`; the latest row of a key (by order, then batch) wins.

    A batch writes its own rows alone, as delta=<batch id>, so its cost grows with the batch and not with the table; run again, it
    replaces its own part. Every `compact` batches the parts are merged to base=<batch id>, and those before the base before it go.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        _latest(batch.withColumn("_part", F.lit(batch_id)), key, order).drop("_part").write.mode("overwrite").parquet(f"{target}/delta={batch_id}")
        if (batch_id + 1) % compact == 0:
            bases = [b for b in _parts(spark, target, "base") if b < batch_id]
            current(spark, target, key, order, batch_id).write.mode("overwrite").parquet(f"{target}/base={batch_id}")
            if bases:
                _drop(spark, target, max(bases))

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str, key: str, order: str, upto: int | None = None) -> DataFrame | None:
    """The merged rows: the newest base and the deltas after it, the latest row of each key; None if nothing was written."""
    inside = lambda x: upto is None or x <= upto
    base = max((b for b in _parts(spark, target, "base") if upto is None or b < upto), default=-1)
    deltas = [d for d in _parts(spark, target, "delta") if d > base and inside(d)]
    parts = [(f"{target}/base={base}", base)] * (base >= 0) + [(f"{target}/delta={d}", d) for d in deltas]
    if not parts:
        return None
    # one scan of all parts, each known by its path
    rows = spark.read.parquet(*[p for p, _ in parts]).withColumn("_part", F.regexp_extract(F.col("_metadata.file_path"), "(?:base|delta)=([0-9]+)/", 1).cast("long"))
    return _latest(rows, key, order).drop("_part")


def _latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order, "_part")).alias("r")).select("r.*")


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _parts(spark: SparkSession, target: str, kind: str) -> list[int]:
    """The numbers of the parts of a kind that were written whole."""
    fs, at = _fs(spark, target)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    done = [int(n.split("=")[1]) for n in names if n.startswith(kind + "=")]
    return [d for d in done if _fs(spark, f"{target}/{kind}={d}/_SUCCESS")[0].exists(_fs(spark, f"{target}/{kind}={d}/_SUCCESS")[1])]


def _drop(spark: SparkSession, target: str, upto: int) -> None:
    """Delete parts that a base has taken over: bases before it, deltas up to it."""
    for kind, last in (("base", upto - 1), ("delta", upto)):
        for d in _parts(spark, target, kind):
            if d <= last:
                fs, at = _fs(spark, f"{target}/{kind}={d}")
                fs.delete(at, True)


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their values by window and type; works alike on a table and on a stream with a watermark."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
