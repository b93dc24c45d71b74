"""Keyed maintenance of a stored table: a change rewrites only the hash buckets that its keys are in.

The table is Parquet in folders by bucket. Upserts, deletes and updates read the buckets that they touch, write what these are to be to
the shared folder, and put it in their place by dynamic partition overwrite. There is no log: every operation gives the same table
when it is run again, so one that was broken off is repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import io

BUCKETS = 64
_BUCKET = "_bucket"


@dataclass(frozen=True)
class StoredTable:
    """A table at a path with one row for each value of a key, in so many buckets. schema: its columns as DDL."""

    path: str
    key: str
    schema: str
    buckets: int = BUCKETS

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, {_BUCKET} int").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(_BUCKET)

    def _columns(self, spark: SparkSession) -> list[str]:
        return [c for c in self._stored(spark).columns if c != _BUCKET]

    def _write(self, rows: DataFrame, mode: str) -> None:
        """One task a bucket, files by bucket: dynamic, so that folders without new rows stay as they are."""
        dealt = rows.withColumn(_BUCKET, self.bucket()).repartition(_BUCKET)
        dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)

    def _touched(self, changes: DataFrame) -> list[int]:
        return [r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect()]

    def _replace(self, spark: SparkSession, touched: list[int], rows: DataFrame) -> None:
        """rows become all of the touched buckets; a bucket left without rows loses its folder."""
        kept = io.written(rows, "bucket")
        self._write(kept, "overwrite")
        full = {r[0] for r in kept.select(self.bucket()).distinct().collect()}
        fs = None
        for b in set(touched) - full:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{_BUCKET}={b}")
            fs = fs or at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(at, True)
        spark.catalog.refreshByPath(self.path)

    def _single(self, changes: DataFrame) -> DataFrame:
        """One change for each key; of several the one with the greatest hash of its columns, whatever their order. Null keys go."""
        names = [c for c in changes.columns if c != self.key]
        best = F.max_by(F.struct(F.lit(True).alias("_there"), *names), F.xxhash64(*names) if names else F.lit(0)).alias("_r")
        return changes.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(best).select(self.key, *[F.col(f"_r.`{c}`").alias(c) for c in names])

    def create(self, rows: DataFrame) -> None:
        """Write the table anew."""
        self._write(self._single(rows), "overwrite")

    def upsert(self, changes: DataFrame) -> None:
        """Rows of changes in place of those with the same key; the others are new."""
        spark = changes.sparkSession
        new = io.written(self._single(changes.select(*self._columns(spark))), "changes")
        touched = self._touched(new)
        if touched:
            old = self._stored(spark).where(F.col(_BUCKET).isin(touched)).drop(_BUCKET)
            self._replace(spark, touched, old.join(new.select(self.key), self.key, "left_anti").unionByName(new))

    def delete(self, keys: DataFrame) -> None:
        """Without the rows of these keys."""
        spark = keys.sparkSession
        gone = io.written(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), "keys")
        touched = self._touched(gone)
        if touched:
            old = self._stored(spark).where(F.col(_BUCKET).isin(touched)).drop(_BUCKET)
            self._replace(spark, touched, old.join(gone, self.key, "left_anti"))

    def update(self, changes: DataFrame, set_: dict[str, Column]) -> None:
        """Columns set to expressions, in the rows whose key is in changes; columns of changes are named new.c, those of the row old.c. Other keys are ignored."""
        spark = changes.sparkSession
        new = io.written(self._single(changes), "changes")
        touched = self._touched(new)
        if touched:
            old = self._stored(spark).where(F.col(_BUCKET).isin(touched)).drop(_BUCKET).alias("old")
            both = old.join(new.withColumn("_hit", F.lit(True)).alias("new"), F.col(f"old.{self.key}") == F.col(f"new.{self.key}"), "left")
            columns = [F.when(F.col("new._hit"), set_[c]).otherwise(F.col(f"old.{c}")).alias(c) if c in set_ else F.col(f"old.{c}") for c in self._columns(spark)]
            self._replace(spark, touched, both.select(*columns))
