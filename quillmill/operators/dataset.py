"""Splits, samplers, quotas and pair builders. Random choices are by a hash of (seed, key): repeatable, in any order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unit_hash
from .running import ranked_by_hash, same


def seeded(seed: str, key: Column) -> Column:
    """The order in which a seeded shuffle takes keys."""
    return F.sha1(F.concat_ws(":", F.lit(seed), key.cast("string")))


def split_by_hash(key: Column, seed: str, train: float = 0.8, dev: float = 0.9) -> Column:
    u = unit_hash(F.concat_ws(":", F.lit(seed), key.cast("string")))
    return F.when(u < train, "train").when(u < dev, "dev").otherwise("internal_test")


def split_by_digest(digest: Column) -> Column:
    """By the first 8 hex digits modulo 10: 0-7 train, 8 val, 9 test; blank is train."""
    n = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10
    return F.when(F.coalesce(F.trim(digest), F.lit("")) == "", "train").when(n < 8, "train").when(n == 8, "val").otherwise("test")


def ranked(rows: DataFrame, by: list[str], key: str, seed: str, out: str = "rn") -> DataFrame:
    """rows with their place from 1 in their group's seeded order; a large group is ranked in cells of its hashes."""
    return ranked_by_hash(rows.withColumn("_h", seeded(seed, F.col(key))), "_h", [key], out, by).drop("_h")


def sample_per(rows: DataFrame, by: list[str], key: str, n: int, seed: str) -> DataFrame:
    """The first n of each group; the limit holds before the shuffle."""
    w = Window.partitionBy(*by).orderBy(seeded(seed, F.col(key)), key)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def split_stratified(rows: DataFrame, by: list[str], key: str, seed: str, share: float = 0.1) -> DataFrame:
    """Adds split: of each stratum round-half-even(share * n), 1 at least, to test and to val; strata under 3 rows all train."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    d = ranked(rows, by, key, seed).alias("x").join(n.alias("n"), same("x", "n", by)).select("x.*", "_n")
    k = F.greatest(F.bround(F.col("_n") * share), F.lit(1))
    split = F.when(F.col("_n") < 3, "train").when(F.col("rn") <= k, "test").when(F.col("rn") <= 2 * k, "val").otherwise("train")
    return d.withColumn("split", split).drop("rn", "_n")


def split_keys(rows: DataFrame, key: str, seed: str, share: float) -> DataFrame:
    """key, split: max(1, floor(share * n)) keys to val. Keys are cut at a hash threshold found by counting hash cells."""
    keys = rows.select(key).distinct().withColumn("_h", seeded(seed, F.col(key)))
    cells = keys.groupBy(F.substring("_h", 1, 3).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))  # at most 4096
    before = cells.withColumn("_b", F.sum("_n").over(Window.orderBy("_c")) - F.col("_n"))
    total = cells.agg(F.greatest(F.floor(F.sum("_n") * share), F.lit(1)).alias("_k"))
    own = Window.partitionBy("_c").orderBy("_h", key)
    d = keys.withColumn("_c", F.substring("_h", 1, 3)).withColumn("_r", F.row_number().over(own)).join(F.broadcast(before), "_c").crossJoin(F.broadcast(total))
    return d.select(key, F.when(F.col("_b") + F.col("_r") <= F.col("_k"), "val").otherwise("train").alias("split"))


def allocate(counts: DataFrame, key: str, total: int, least: int = 1) -> DataFrame:
    """key, k: `least` each, the rest in proportion to n, leftovers to the largest fractions (ties: key, descending)."""
    s = counts.agg(F.sum("n").alias("_s"), F.count(F.lit(1)).alias("_g"))
    d = counts.crossJoin(F.broadcast(s)).withColumn("_share", (total - least * F.col("_g")) * (F.col("n") / F.col("_s")))
    d = d.withColumn("_whole", F.floor("_share")).withColumn("_frac", F.col("_share") - F.col("_whole"))
    rest = (total - least * F.col("_g")) - F.sum("_whole").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("_frac"), F.desc(key)))
    return d.withColumn("_rest", rest).withColumn("_place", place).select(key, (least + F.col("_whole") + (F.col("_place") <= F.col("_rest")).cast("int")).cast("long").alias("k"))


def pairs_of_levels(rows: DataFrame, group: str, level: str, score: str) -> DataFrame:
    """group, low, high, gap of each ordered pair of levels of a group."""
    a = rows.select(group, F.col(level).alias("low"), F.col(score).alias("_a"))
    b = rows.select(group, F.col(level).alias("high"), F.col(score).alias("_b"))
    return a.join(b, group).where("low < high").select(group, "low", "high", (F.col("_b") - F.col("_a")).alias("gap"))


def conflicts(rows: DataFrame, text: str, label: str, key: str) -> DataFrame:
    """text, first key, n, conflict: whether rows of one text have different labels."""
    return rows.groupBy(text).agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n"), (F.count_distinct(label) > 1).alias("conflict"))


def consensus(a: DataFrame, b: DataFrame, key: str, label_a: str, label_b: str) -> DataFrame:
    """Rows of a whose label another source gives as well."""
    return a.join(b.select(key, label_b), key).where(F.col(label_a) == F.col(label_b)).drop(label_b)


def largest_first(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Shard of each item of a bounded list: the largest first, each to the least loaded."""
    load, out = [0] * shards, {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        k = min(range(shards), key=lambda s: (load[s], s))
        out[name], load[k] = k, load[k] + n
    return out


def greedy_parts(rows: DataFrame, group: str, order: str, size: str, most: int) -> DataFrame:
    """Adds part: rows of a group in order, a new part whenever the next row would exceed `most` (a part has one row at least).

    A sum that begins anew is sequential in a group; a sorted partition is streamed through once, holding a batch at a time.
    """
    names = rows.columns
    at = [names.index(c) for c in (group, size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, used = None, 0, 0
        for b in batches:
            out = []
            for g, n in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist(), strict=True):
                if now is None or now[0] != g:
                    now, part, used = (g,), 0, 0
                if used > 0 and used + n > most:
                    part, used = part + 1, 0
                used += n
                out.append(part)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*names, "part"])

    dealt = rows.repartition(group).sortWithinPartitions(group, order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInArrow(run, f"{schema}, part long")


def oversample(rows: DataFrame, times: Column) -> DataFrame:
    """rows repeated `times` times, with their copy from 0."""
    n = F.greatest(times.cast("long"), F.lit(0))
    return rows.withColumn("copy", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))))


def adjusted_k(level: Column, text_k: int, image_k: int, step: int = 2, least: int = 2) -> tuple[Column, Column]:
    """(text_k, image_k) by dependency level: R3 takes from text for images, R1 the other way, neither under `least`."""
    up, down = lambda k: F.lit(k + step), lambda k: F.lit(max(k - step, least))
    return F.when(level == "R3", down(text_k)).when(level == "R1", up(text_k)).otherwise(text_k), F.when(level == "R3", up(image_k)).when(level == "R1", down(image_k)).otherwise(image_k)


def density_score(level: Column, raw: Column, bases: dict[str, float], factor: float = 0.16, most: float = 0.08) -> Column:
    """A level's base moved by what a raw score is above or below a half, within limits."""
    base = F.lit(None).cast("double")
    for k, v in bases.items():
        base = F.when(level == k, v).otherwise(base)
    return base + F.greatest(F.lit(-most), F.least(F.lit(most), factor * (raw - 0.5)))


def support_label(u: Column, margin: float = 0.2) -> Column:
    return F.when(u > margin, "pos").when(u < -margin, "neg").otherwise("neutral")


def backfilled(rows: DataFrame, labels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with labels' value filled in by key; fails if a label's key repeats, or names no row, as a whole count of both."""
    many = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    if not many.isEmpty():
        raise ValueError("a key has several labels")
    if not labels.join(rows.select(*keys), keys, "left_anti").isEmpty():
        raise ValueError("a label has no row")
    return rows.drop(value).join(labels.select(*keys, value), keys, "left")
