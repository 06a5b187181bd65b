"""Vector and percentile expressions. Components are widened to double before they are summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(a: Column) -> Column:
    """Divided by its norm, or by 1e-12 where that is less."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(1e-12)))


def _ranked(counts_first: Column, index: Column) -> Column:
    n = F.size(counts_first)
    return F.element_at(counts_first, F.least(F.greatest(index, F.lit(0)), n - 1).cast("int") + 1)


def nearest_rank(values: Column, percent: float) -> Column:
    """Aggregate: the value at the half-even rounded position percent/100 * (n-1) of the sorted values."""
    s = F.sort_array(F.collect_list(values))
    return F.when(F.size(s) > 0, _ranked(s, F.bround(F.lit(percent / 100.0) * (F.size(s) - 1))))


def lower_rank(values: Column, percent: float) -> Column:
    """Aggregate: as `nearest_rank`, at the position percent/100 * n - 1."""
    s = F.sort_array(F.collect_list(values))
    return F.when(F.size(s) > 0, _ranked(s, F.bround(F.lit(percent / 100.0) * F.size(s) - 1)))


def ranked_values(rows: DataFrame, by: list[str], value: str, picks: dict[str, tuple[str, float]]) -> DataFrame:
    """(*by, *picks): for each group the values at the positions of `nearest_rank` ("nearest") or `lower_rank` ("lower").

    Values are counted where they lie and cumulated over a group's distinct values, which the window reads in order and may
    spill, so no group is held whole. Nulls are left out; a group of nulls alone is missing.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*by)
    upto = counts.withColumn("__upto", F.sum("__n").over(w.orderBy("__v"))).withColumn("__total", F.sum("__n").over(w))
    total = F.col("__total")

    def at(rule: str, percent: float) -> Column:
        place = F.bround(F.lit(percent / 100.0) * (total - 1)) if rule == "nearest" else F.bround(F.lit(percent / 100.0) * total - 1)
        return F.min(F.when(F.col("__upto") > F.least(F.greatest(place, F.lit(0)), total - 1), F.col("__v")))

    return upto.groupBy(*by).agg(*[at(*pick).alias(name) for name, pick in picks.items()])


def interpolated(values: Column, share: float) -> Column:
    """Aggregate: linear interpolation between neighbours; null without values."""
    return F.percentile(values, F.lit(share))
