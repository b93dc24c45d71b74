"""Summaries that merge: quantile sketches over grouping sets, distributions of many columns in one pass, most common values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size parameter of the quantile sketches; the error of a rank is about 1.33 % for 200, and less for more.
SKETCH = 400


def sketched(rows: DataFrame, keys: list[str], value: str, size: int = SKETCH) -> DataFrame:
    """keys, n, lo, hi and sketch (KLL, of bounded size) of each group's values; nulls are not counted. What is shuffled is a sketch a group and task."""
    v = F.col(value).cast("double")
    return rows.where(v.isNotNull()).groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """sketched() of coarser groups, from the sketches of finer ones: no value is read again."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The sketches' values at shares of the ranks, in place of the sketches."""
    found = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(share)) for name, share in shares.items()}
    return sketches.withColumns(found).drop("sketch")


def over_sets(rows: DataFrame, keys: list[str], sets: list[list[str]], value: str, shares: dict[str, float], size: int = SKETCH) -> DataFrame:
    """keys, n, lo, hi and quantiles for each grouping set; keys outside of a set are null. Rows are read once, the sets merge sketches of the finest groups."""
    fine = sketched(rows, keys, value, size)
    kinds = dict(rows.dtypes)
    out: DataFrame | None = None
    for own in sets:
        part = quantiles(merged(fine, own), shares)
        part = part.select(*[F.col(k) if k in own else F.lit(None).cast(kinds[k]).alias(k) for k in keys], "n", "lo", "hi", *shares)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no grouping sets")
    return out


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """name, value (as text, null for nulls), n of each column's values, all in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))
    return rows.select(each.alias("d")).groupBy("d.name", "d.value").agg(F.count(F.lit(1)).alias("n"))


def most_common(rows: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The k most frequent values of a column and their counts; of equals the first in order. Nulls are not counted."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)
