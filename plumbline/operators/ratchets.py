"""Measures that may not get worse, and places where many changes meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import value_at


def max_baseline(df: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """The highest value per key, so that a key met twice can only excuse more."""
    return df.groupBy(*keys).agg(F.max(metric).alias(metric))


def ratchet(before: DataFrame, after: DataFrame, keys: Sequence[str], metric: str, allowed: float = 0) -> DataFrame:
    """Rows of ``after`` above the baseline of their key by more than ``allowed``, with ``before`` and ``after``."""
    base = max_baseline(before, keys, metric).withColumnRenamed(metric, "before")
    joined = after.withColumnRenamed(metric, "after").join(base, list(keys))
    return joined.filter(F.col("after") > F.col("before") + allowed)


def churn(df: DataFrame, keys: Sequence[str], since: Column | None = None) -> DataFrame:
    """n changes per key, optionally only those for which ``since`` holds."""
    return (df if since is None else df.filter(since)).groupBy(*keys).agg(F.count("*").alias("n"))


def percentile_threshold(counts: DataFrame, n: str, percentile: int = 90, floor: int = 3) -> DataFrame:
    """One row ``threshold``: the nearest-rank percentile of ``n``, ``floor`` at least.

    The counts are summed by value before anything is ordered, so what one task sorts are distinct values.
    """
    histogram = counts.groupBy(F.col(n).alias("value")).agg(F.count("*").alias("rows"))
    upto = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = histogram.select(
        "value", F.sum("rows").over(upto).alias("through"), F.sum("rows").over(Window.partitionBy()).alias("all")
    )
    rank = F.floor((F.col("all") * percentile + 99) / 100)
    return ranked.filter(F.col("through") >= rank).agg(F.greatest(F.min("value"), F.lit(floor)).alias("threshold"))


def hotspot(counts: DataFrame, n: str, percentile: int = 90, floor: int = 3, many_values: bool = False) -> DataFrame:
    """Rows of ``counts`` whose ``n`` reaches the percentile, with ``threshold``; none if there are no counts.

    ``many_values``: ``n`` may have about as many values as there are rows; then no task sorts them all.
    """
    if many_values:
        place = F.greatest(F.expr(f"(n * {percentile} + 99) div 100"), F.lit(1))
        threshold = value_at(counts, n, place).select(F.greatest("value", F.lit(floor)).alias("threshold"))
    else:
        threshold = percentile_threshold(counts, n, percentile, floor)
    threshold = threshold.withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(threshold), "_one").drop("_one").filter(F.col(n) >= F.col("threshold"))


def ratchet_hotspot(
    worse: DataFrame, hot: DataFrame, key: str, n: str, usual: str, severe: str
) -> DataFrame:
    """``worse`` with ``n`` (0 if the key isn't hot) and ``level``: ``severe`` at a hot key, ``usual`` elsewhere."""
    joined = worse.join(hot.select(key, n), key, "left")
    return joined.withColumn("level", F.when(F.col(n).isNull(), usual).otherwise(severe)).withColumn(n, F.coalesce(n, F.lit(0)))
