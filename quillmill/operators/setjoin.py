"""Exact joins of sets by similarity: prefix, length and position filters over items in order of frequency.

Two sets that share enough must share one of the rarest items of either, so sets meet only by those. Frequent
items are in few prefixes; one that is in many is split. Pairs that pass the filters are verified once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import io

#: Right-hand sets that meet at one item in one task at most (about).
TILE = 20_000
#: Below this share of an item a bound counts as met, for products of thresholds and sizes are not exact.
SLACK = 1e-9


def _needed(measure: str, least: float, n: Column, m: Column) -> Column:
    """Items that sets of n and m items have to share."""
    if measure == "containment":
        return F.ceil(n * least - SLACK)
    return F.ceil((n + m) * (least / (1 + least)) - SLACK)


def _ordered(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """id, items in order of frequency (then text), n of sets that are not empty."""
    one = sets.select("id", F.explode(F.array_distinct(F.array_compact("items"))).alias("item"))
    ranked = one.join(counts, "item").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("s"))
    return io.written(ranked.select("id", F.col("s.item").alias("items"), F.size("s").alias("n")), "sets")


def _prefix(sets: DataFrame, length: Column) -> DataFrame:
    """id, n, at (from 1), item of the first items of each set."""
    return sets.select("id", "n", F.posexplode(F.slice("items", F.lit(1), length)).alias("at", "item")).withColumn("at", F.col("at") + 1)


def similar(left: DataFrame, right: DataFrame, least: float, measure: str = "jaccard", tile: int = TILE) -> DataFrame:
    """left_id, right_id, shared, left_n, right_n, score of all pairs of left(id, items) and right(id, items) with at least that score.

    jaccard: shared items by all items of both; containment: by the left set's. Items count once; nulls among them, and null ids, are left out, as
    are empty sets, which are similar to nothing. Ids are distinct on either side. least is above 0 and at most 1.
    """
    if not 0 < least <= 1:
        raise ValueError("least is not in (0, 1]")
    sides = [d.where("id IS NOT NULL").select("id", "items") for d in (left, right)]
    both = sides[0].select("items").unionByName(sides[1].select("items"))
    counts = both.select(F.explode(F.array_distinct(F.array_compact("items"))).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    counts = io.written(counts, "items")
    x, y = (_ordered(d, counts) for d in sides)
    size = F.col("n")
    ours = size - F.ceil(size * least - SLACK).cast("int") + 1
    # a set that is contained may lie anywhere in the other's order
    a, b = _prefix(x, ours), _prefix(y, size if measure == "containment" else ours)
    b = b.join(a.select("item").distinct(), "item", "left_semi")
    pieces = b.groupBy("item").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("pieces")).where("pieces > 1")
    dealt = b.join(pieces, "item", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("id"), "pieces").cast("int"), F.lit(0)))
    asked = a.join(pieces, "item", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
    n, m = F.col("a.n"), F.col("b.n")
    need = _needed(measure, least, n, m)
    can = (F.least(n, m) >= need) & (F.least(n - F.col("a.at"), m - F.col("b.at")) + 1 + F.least("a.at", "b.at") - 1 >= need)
    met = asked.alias("a").join(dealt.alias("b"), (F.col("a.item") == F.col("b.item")) & (F.col("a.piece") == F.col("b.piece")) & can)
    pairs = io.written(met.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct(), "pairs")
    named = lambda d, side: d.select(F.col("id").alias(f"{side}_id"), F.col("items").alias(f"{side}_items"), F.col("n").alias(f"{side}_n"))
    held = pairs.join(named(x, "left"), "left_id").join(named(y, "right"), "right_id")
    shared = held.withColumn("shared", F.size(F.array_intersect("left_items", "right_items")))
    whole = F.col("left_n") if measure == "containment" else F.col("left_n") + F.col("right_n") - F.col("shared")
    scored = shared.withColumn("score", F.col("shared") / whole)
    return scored.where(F.col("shared") >= _needed(measure, least, F.col("left_n"), F.col("right_n"))).select("left_id", "right_id", "shared", "left_n", "right_n", "score")
