"""Order over a whole table without a window over it: ranges of the order, work inside them, one row carried from each.

Rows are dealt over partitions by ranges of their order and numbered inside them; what crosses a border is one row per
partition (its size or its last row), and there are no more of these than partitions.  ``order`` should tell rows apart: rows of
equal order stay in one partition, however many they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def range_parts(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``_part``: a row of a smaller ``_part`` comes before one of a larger; empty parts have no number of their own."""
    by = [F.col(c) for c in order]
    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return written(dealt.withColumn("_part", F.spark_partition_id()))


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "number", parts: int | None = None) -> DataFrame:
    """``df`` with the place of each row in the order of the whole table, from 1."""
    dealt = range_parts(df, order, parts)
    offsets, through = [], 0
    for part, rows in sorted((r["_part"], r["count"]) for r in dealt.groupBy("_part").count().collect()):
        offsets.append((part, through))
        through += rows
    before = df.sparkSession.createDataFrame(offsets, "_part int, _before long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn(name, inside).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def numbers_within(df: DataFrame, within: Sequence[str], order: Sequence[str], name: str = "number", parts: int | None = None) -> DataFrame:
    """``df`` with the place of each row in the order of its group ``within``, from 1; nulls are a group.

    A large group lies in many ranges and is numbered in each of them, so no task holds it whole.
    """
    dealt = range_parts(df.withColumn("_group", F.struct(*within)), [*within, *order], parts)
    # Only the first group of a range can have begun before it, so what is carried is at most one row per range.
    first = dealt.groupBy("_part").agg(F.min("_group").alias("_group"))
    sizes = dealt.join(F.broadcast(first.select("_group").distinct()), "_group").groupBy("_group", "_part").agg(F.count("*").alias("_rows"))
    earlier = F.sum("_rows").over(Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("_group", "_part", earlier.alias("_before")).filter("_before IS NOT NULL")
    inside = F.row_number().over(Window.partitionBy("_part", *within).orderBy(*order)).cast("long")
    numbered = dealt.withColumn(name, inside).join(F.broadcast(before), ["_group", "_part"], "left")
    return numbered.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_part", "_group", "_before")


def change_log(df: DataFrame, order: Sequence[str], key: str, before: tuple | None = None, parts: int | None = None) -> DataFrame:
    """Rows whose ``key`` differs from that of the row just before in the whole table; nulls are equal to each other.

    ``before`` is (key,) of a row that comes before all of them, if there is one.
    """
    dealt = range_parts(df, order, parts)
    ends = dealt.groupBy("_part").agg(F.max_by(F.struct(F.col(key).alias("key")), F.struct(*order)).alias("last")).collect()
    carried, last = [], before
    for r in sorted(ends, key=lambda r: r["_part"]):
        carried.append((r["_part"], last is not None, last[0] if last else None))
        last = (r["last"]["key"],)
    kind = df.schema[key].dataType.simpleString()
    borders = df.sparkSession.createDataFrame(carried, f"_part int, _some boolean, _carried {kind}")
    inside = Window.partitionBy("_part").orderBy(*order)
    previous = F.lag(F.struct(F.col(key).alias("key"))).over(inside)
    same = F.when(F.col("_previous").isNotNull(), F.col("_previous.key").eqNullSafe(F.col(key))).otherwise(F.col("_some") & F.col("_carried").eqNullSafe(F.col(key)))
    marked = dealt.withColumn("_previous", previous).join(F.broadcast(borders), "_part")
    return marked.filter(~same).drop("_part", "_previous", "_some", "_carried")


def value_at(df: DataFrame, value: str, place: Column, parts: int | None = None) -> DataFrame:
    """One row ``value``, the one at ``place`` (from 1) in the order of all values of ``df``; ``place`` may use ``n``, their number.

    Values are counted first; ranges of them tell which one holds the place, and only that range is gone through.  Nulls don't
    count; without any value there is no row.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("rows"))
    dealt = range_parts(counted, ["value"], parts)
    sizes = sorted((r["_part"], r["rows"]) for r in dealt.groupBy("_part").agg(F.sum("rows").alias("rows")).collect())
    spark, n = df.sparkSession, sum(rows for _, rows in sizes)
    wanted = spark.range(1).select(F.lit(n).cast("long").alias("n")).select(place.cast("long").alias("place")).first()["place"] if n else 0
    for part, rows in sizes:
        if wanted <= rows:
            upto = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
            inside = dealt.filter(F.col("_part") == part).withColumn("_through", F.sum("rows").over(upto))
            return inside.filter(F.col("_through") >= wanted).agg(F.min("value").alias("value"))
        wanted -= rows
    return counted.select("value").limit(0)


_FOLDS = {"sum": (F.sum, lambda a, b: a + b), "max": (F.max, max), "min": (F.min, min)}


def running(df: DataFrame, order: Sequence[str], value: Column, how: str, name: str, exclusive: bool = False, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum, max or min (``how``) of ``value`` over all rows up to this one, or before it (``exclusive``).

    Nulls don't count; where there is no value yet the result is null.
    """
    of, fold = _FOLDS[how]
    dealt = range_parts(df.withColumn("_value", value), order, parts)
    totals = {r["_part"]: r["total"] for r in dealt.groupBy("_part").agg(of("_value").alias("total")).collect()}
    carried, so_far = [], None
    for part in sorted(totals):
        carried.append((part, so_far))
        if totals[part] is not None:
            so_far = totals[part] if so_far is None else fold(so_far, totals[part])
    kind = dealt.select(of("_value").alias("v")).schema["v"].dataType.simpleString()
    before = df.sparkSession.createDataFrame(carried, f"_part int, _before {kind}")
    inside = of("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
    joined = dealt.withColumn("_inside", inside).join(F.broadcast(before), "_part")
    both = {"sum": F.col("_inside") + F.col("_before"), "max": F.greatest("_inside", "_before"), "min": F.least("_inside", "_before")}[how]
    return joined.withColumn(name, F.coalesce(both, "_inside", "_before")).drop("_part", "_value", "_inside", "_before")
