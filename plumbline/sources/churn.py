"""Counts per key over a window of days that are kept from day to day: a new day costs the work of a day.

A store is a folder with two tables.  ``days/day=<d>`` holds the counts of one day, ``state/upto=<d>`` those of the window that
ends with a day.  A state is the one before, plus the days that came, minus the days that left; counts add up, so nothing else
is read again.  Both tables are written by overwriting their own partition alone, and a state is made from one of an earlier
day, so an advance that is repeated gives the same files.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .history import there

_PUT = {"partitionOverwriteMode": "dynamic"}


def age_minutes(since: Column, now: Column) -> Column:
    """Whole minutes from ``since`` to ``now``; null if either is."""
    return F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 60_000_000).cast("long")


def _counts(spark: SparkSession, folder: str, keys: StructType, by: str) -> DataFrame | None:
    return spark.read.schema(StructType([*keys.fields]).add("n", "long").add(by, "date")).parquet(folder) if there(spark, folder) else None


def advance(changes: DataFrame, folder: str, today: date, window: int, keys: Sequence[str], at: str) -> None:
    """Takes the state on to ``today``: counts ``changes`` of the days since the state before, of those in the window.

    ``changes`` may hold more; only the days after the last state, up to today, are looked at, so what comes late for a day
    that has been counted doesn't count.  Rows with a null time count nowhere; null keys are keys.
    """
    spark, keys = changes.sparkSession, list(keys)
    kinds = changes.select(*keys).schema
    states = _counts(spark, f"{folder}/state", kinds, "upto")
    last = None if states is None else states.filter(F.col("upto") < F.lit(today)).agg(F.max("upto")).first()[0]
    begin = today - timedelta(days=window)
    day = F.to_date(at)
    new = changes.filter((day > F.lit(max(last or begin, begin))) & (day <= F.lit(today))).groupBy(*keys, day.alias("day")).agg(F.count("*").alias("n"))
    new.write.mode("overwrite").options(**_PUT).partitionBy("day").parquet(f"{folder}/days")
    days = _counts(spark, f"{folder}/days", kinds, "day")
    parts = days.filter((F.col("day") > F.lit(max(last or begin, begin))) & (F.col("day") <= F.lit(today))).select(*keys, "n") if days is not None else new.select(*keys, "n")
    if last is not None and last > begin:
        left = days.filter((F.col("day") <= F.lit(begin)) & (F.col("day") > F.lit(last - timedelta(days=window))))
        kept = states.filter(F.col("upto") == F.lit(last)).select(*keys, "n")
        parts = parts.unionByName(kept).unionByName(left.select(*keys, (-F.col("n")).alias("n")))
    state = parts.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 0").withColumn("upto", F.lit(today))
    state.write.mode("overwrite").options(**_PUT).partitionBy("upto").parquet(f"{folder}/state")


def current(spark: SparkSession, folder: str, today: date, keys: StructType, most_days: int = 0) -> DataFrame | None:
    """keys, n of the newest state up to ``today``, if it isn't more than ``most_days`` days old; else None: it is to be advanced."""
    states = _counts(spark, f"{folder}/state", keys, "upto")
    if states is None:
        return None
    last = states.filter(F.col("upto") <= F.lit(today)).agg(F.max("upto")).first()[0]
    if last is None or (today - last).days > most_days:
        return None
    return states.filter(F.col("upto") == F.lit(last)).drop("upto")
