"""Growth budgets, their gauge, and ratio gates; all in whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent_budget, usage_percent


def with_budget(df: DataFrame, percent: int, baseline: str = "baseline") -> DataFrame:
    """``df`` (a row per scope) with ``budget``: ``percent`` of the baseline, rounded up, 1 at least; 0 means off."""
    return df.withColumn("budget", percent_budget(F.col(baseline), percent))


def over_budget(df: DataFrame, percent: int, baseline: str = "baseline", added: str = "added") -> DataFrame:
    return with_budget(df, percent, baseline).filter((F.col("budget") > 0) & (F.col(added) > F.col("budget")))


def gauge(df: DataFrame, percent: int, baseline: str = "baseline", added: str = "added") -> DataFrame:
    """Every scope with budget, usage (percent, halves to even) and over."""
    rows = with_budget(df, percent, baseline)
    return rows.withColumn("usage", usage_percent(F.col(added), F.col("budget"))).withColumn(
        "over", (F.col("budget") > 0) & (F.col(added) > F.col("budget"))
    )


def ratio_gate(df: DataFrame, part: str, whole: str, min_percent: int, floor: int = 50) -> DataFrame:
    """Rows with ``whole`` of ``floor`` or more whose truncated percentage ``part * 100 / whole`` is below the minimum."""
    if min_percent <= 0:
        return df.withColumn("percent", F.lit(None).cast("long")).limit(0)
    percent = F.floor(F.col(part) * 100 / F.nullif(F.col(whole), F.lit(0))).cast("long")
    return df.withColumn("percent", percent).filter((F.col(whole) >= floor) & (F.col("percent") < min_percent))
