"""The state that held at a time: the last row of a key at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ranges import range_parts


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, columns: Sequence[str], parts: int | None = None) -> DataFrame:
    """``left`` with ``columns`` of the last row of ``right`` that has the same keys and is not later; nulls where there is none.

    Both sides are put in one order of keys and time and cut into ranges, so the work is linear and a key with very many rows is
    many ranges; a range begins with the state that the ranges before it leave, one row each.  Of rows of ``right`` with equal keys
    and time the one with the greatest ``columns`` counts.  A null key equals a null key; a row of ``left`` without a time has no
    state, nor is a row of ``right`` without one a state.
    """
    keys = list(keys)
    states = right.filter(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max(F.struct(*columns)).alias("_state"))
    kind = states.schema["_state"].dataType
    timed = left.filter(F.col(at).isNotNull()).select(*keys, at, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(kind).alias("_state"))
    rows = states.select(*keys, at, F.lit(0).alias("_side"), F.lit(None).cast(timed.schema["_row"].dataType).alias("_row"), "_state")
    order = [*keys, at, "_side"]
    dealt = range_parts(timed.unionByName(rows), order, parts)
    same_key = Window.partitionBy("_part", *keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    stated = dealt.withColumn("_held", F.last("_state", ignorenulls=True).over(same_key))
    carried = _carried(dealt, keys, order, kind)
    met = stated.filter("_side = 1").join(F.broadcast(carried), "_part", "left")
    one = F.lit(True)
    for k in keys:
        one = one & F.col(k).eqNullSafe(F.col(f"_carried.{k}"))
    held = F.when(F.col("_held").isNotNull(), F.col("_held")).when(one, F.col("_before"))
    named = met.select("_row.*", held.alias("_state")).select(*left.columns, *[F.col(f"_state.{c}").alias(c) for c in columns])
    untimed = left.filter(F.col(at).isNull()).select(*left.columns, *[F.lit(None).cast(kind[c].dataType).alias(c) for c in columns])
    return named.unionByName(untimed)


def _carried(dealt: DataFrame, keys: list[str], order: list[str], kind: StructType) -> DataFrame:
    """_part, _carried (keys) and _before: the state that holds where a range begins, and whose it is."""
    place, key = F.struct(*order), F.struct(*keys)
    last = dealt.groupBy("_part").agg(F.max_by(key, place).alias("key"), F.min_by(key, place).alias("first"))
    state = F.max_by(F.when(F.col("_state").isNotNull(), F.struct("_state")), F.when(F.col("_state").isNotNull(), place))
    same = [dealt[k].eqNullSafe(F.col(f"key.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    ends = dealt.join(F.broadcast(last), "_part").filter(condition).groupBy("_part").agg(F.first("key").alias("key"), F.first("first").alias("first"), state.alias("state"))
    out, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):
        out.append((r["_part"], before[0] if before else None, before[1] if before else None))
        own = r["state"]["_state"] if r["state"] is not None else None
        if own is None and before is not None and tuple(before[0]) == tuple(r["key"]):
            own = before[1]  # the whole range is of one key and has no state of its own
        before = (r["key"], own)
    schema = StructType().add("_part", "integer").add("_carried", dealt.select(key.alias("k")).schema["k"].dataType).add("_before", kind)
    return dealt.sparkSession.createDataFrame(out, schema)
