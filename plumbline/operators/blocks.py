"""Blocks of lines that come back after they were removed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import any_of
from ..functions.text import is_trivial, normalize_line


def line_windows(df: DataFrame, keep: Sequence[str], lines: Column, first_line: Column | None = None, k: int = 3) -> DataFrame:
    """keep…, line, window: every ``k`` consecutive normalised lines of a row none of which is trivial.

    A trivial line ends a run, so runs need no numbering and no shuffle: a window is wherever ``k`` lines in a row carry
    meaning.  ``window`` is a SHA-256 of the lines, ``line`` the first line's number from 1 (or ``first_line``).
    """
    normal = df.select(*keep, F.transform(lines, normalize_line).alias("_l"), (F.lit(1) if first_line is None else first_line).alias("_f"))
    starts = F.when(F.size("_l") >= k, F.sequence(F.lit(0), F.size("_l") - k)).otherwise(F.array().cast("array<int>"))
    meant = F.filter(starts, lambda i: ~any_of([is_trivial(F.get(F.col("_l"), i + j)) for j in range(k)]))
    return normal.select(*keep, "_f", "_l", F.explode(meant).alias("_i")).select(
        *keep, (F.col("_i") + F.col("_f")).cast("long").alias("line"),
        F.sha2(F.array_join(F.slice(F.col("_l"), F.col("_i") + 1, k), "\n"), 256).alias("window"),
    )


def newest_windows(removed: DataFrame, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per window: the origin that comes first in ``order``."""
    first = F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("_o")
    return removed.groupBy("window").agg(first).select("window", *[F.col(f"_o.{c}").alias(c) for c in keep])


def reappearing_blocks(newest: DataFrame, added: DataFrame) -> DataFrame:
    """Added windows that were removed before, with the columns of their newest removal."""
    return added.join(newest, "window")


def greedy_suppress(df: DataFrame, part: Sequence[str], position: str, gap: int = 3) -> DataFrame:
    """part…, position: from the first position on, only those ``gap`` or more after the last one kept.

    The kept positions depend on each other, so each part's sorted positions are folded; a part is a file.
    """
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        far = acc["last"].isNull() | (x >= acc["last"] + gap)
        return F.when(far, F.struct(x.alias("last"), F.array_append(acc["out"], x).alias("out"))).otherwise(acc)

    ordered = F.array_sort(F.collect_list(F.col(position).cast("long")))
    kept = F.aggregate(ordered, zero, step)["out"]
    return df.groupBy(*part).agg(kept.alias("_kept")).select(*part, F.explode("_kept").alias(position))
