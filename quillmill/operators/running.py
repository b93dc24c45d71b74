"""Ranks and running totals over whole tables and large groups, without one task that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 4096


def same(left: str, right: str, keys: list[str]):
    """The condition of a join on keys, nulls being equal."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def running_total(rows: DataFrame, key: str, value: str, out: str, by: list[str] | None = None, cells: int = CELLS) -> DataFrame:
    """rows with the sum of value over the rows (of their group) with a key up to their own (a number; null keys come first).

    Keys are dealt to cells of equal width. Sums of the cells, at most `cells` a group, are added up; within a
    cell a window adds up its rows. Keys that crowd into few cells make large cells; equal keys are always one.
    """
    by = by or []
    ends = rows.groupBy(*by).agg(F.min(key).cast("double").alias("_lo"), F.max(key).cast("double").alias("_hi"))
    with_ends = rows.alias("x").join(ends.alias("e"), same("x", "e", by)).select("x.*", "_lo", "_hi") if by else rows.crossJoin(F.broadcast(ends))
    width = F.greatest((F.col("_hi") - F.col("_lo")) / cells, F.lit(1e-300))
    dealt = with_ends.withColumn("_cell", F.coalesce(F.least(F.floor((F.col(key).cast("double") - F.col("_lo")) / width), F.lit(cells - 1)), F.lit(-1))).drop("_lo", "_hi")
    return _summed(dealt, [F.col(key)], value, out, by, rows_apart=False)


def ranked_by_hash(rows: DataFrame, digest: str, ties: list[str], out: str, by: list[str]) -> DataFrame:
    """rows with their rank from 1 in their group, in order of a hex digest and then ties; cells are its first three digits."""
    dealt = rows.withColumn("_cell", F.substring(digest, 1, 3)).withColumn("_one", F.lit(1))
    return _summed(dealt, [F.col(digest), *map(F.col, ties)], "_one", out, by, rows_apart=True).drop("_one")


def total_by_hash(rows: DataFrame, digest: str, ties: list[str], value: str, out: str, by: list[str]) -> DataFrame:
    """rows with the sum of value over the rows of their group up to their own, in order of a hex digest and then ties."""
    return _summed(rows.withColumn("_cell", F.substring(digest, 1, 3)), [F.col(digest), *map(F.col, ties)], value, out, by, rows_apart=True)


def _summed(dealt: DataFrame, order: list, value: str, out: str, by: list[str], rows_apart: bool) -> DataFrame:
    sums = dealt.groupBy(*by, "_cell").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(*by).orderBy("_cell")) - F.col("_s")).drop("_s")
    own = Window.partitionBy(*by, "_cell").orderBy(*order)
    inside = F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow) if rows_apart else own)
    names = [c for c in dealt.columns if c != "_cell"]
    both = dealt.withColumn("_in", inside).alias("x").join(before.alias("b"), same("x", "b", [*by, "_cell"]))
    return both.select(*[F.col(f"x.`{c}`") for c in names], (F.col("_before") + F.col("_in")).alias(out))
