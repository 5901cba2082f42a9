"""Operators on rows in order: order checks, change logs, layers, chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_violation(df: DataFrame, part: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows whose ``name`` is smaller than the one just before, with ``previous``."""
    previous = F.lag(name).over(Window.partitionBy(*part).orderBy(*order))
    return df.withColumn("previous", previous).filter(F.col(name) < F.col("previous"))


def change_log_dedup(df: DataFrame, part: Sequence[str], order: Sequence[str], key: str) -> DataFrame:
    """Rows whose ``key`` differs from that of the row just before."""
    previous = F.lag(F.struct(key)).over(Window.partitionBy(*part).orderBy(*order))
    changed = previous.isNull() | ~previous[key].eqNullSafe(F.col(key))
    return df.withColumn("_changed", changed).filter("_changed").drop("_changed")


def steps_ago(df: DataFrame, part: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``ago``: 1 for the newest step of a part, 2 for the one before; rows of one step share it."""
    return df.withColumn("ago", F.dense_rank().over(Window.partitionBy(*part).orderBy(*order)))


def layered_config(df: DataFrame, key: str = "key", value: str = "value", depth: str = "depth", ordinal: str = "ord") -> DataFrame:
    """key, value: the deepest layer wins, in a layer the last line."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(depth, ordinal)).alias(value))


def chain_top(hits: DataFrame, id_: Sequence[str], parent: Sequence[str]) -> DataFrame:
    """Hits whose parent isn't a hit."""
    above = hits.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(id_)])
    on = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(parent)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return hits.join(above, condition, "left_anti")


def running_position(sign: Column, part: Window) -> Column:
    """Lines of the new side before and with this one: added and context lines count, removed ones don't."""
    return F.sum(F.when(sign.isin("+", " "), 1).otherwise(0)).over(part)
