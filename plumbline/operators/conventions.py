"""Conventions inferred from what most rows of a group do."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: So many conventions are sent to all tasks.
CONVENTIONS_SENT = 100_000


def modal_values(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The most frequent ``value`` of each group with its count ``matching`` and the group's ``total``; ties: smallest."""
    counts = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    # One row per group and value is left; the largest count and, of equal ones, the smallest value is the first in order.
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(value).alias("v")))
    return counts.groupBy(*group).agg(best.alias("b"), F.sum("n").alias("total")).select(
        *group, F.col("b.v").alias("expected"), (-F.col("b.less")).alias("matching"), "total"
    )


def modal_convention(
    df: DataFrame,
    entity: Sequence[str],
    groups: Sequence[str],
    traits: Sequence[str],
    min_support: int = 5,
    min_ratio: int = 90,
    ignore: Iterable[tuple[str, str]] = (),
    changed: DataFrame | None = None,
    meaningful: Callable[[Column, Column], Column] | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """Rows that break a convention of their group.

    ``groups`` are columns from the most to the least specific; the most specific group with a convention decides a
    trait, whether the row follows it or not.  A convention needs ``min_support`` rows in the group and with the value,
    and ``min_ratio`` percent of the group.  ``changed`` (columns ``entity``) restricts who is judged, not who counts.
    ``within``, some of ``entity``, keeps groups apart: only rows that agree in it are compared.
    Result: entity, group, trait, actual, expected, matching, total.
    """
    value = F.col("actual")
    per_trait = F.explode(
        F.array(*[F.struct(F.lit(t).alias("trait"), F.coalesce(F.col(t).cast("string"), F.lit("")).alias("actual")) for t in traits])
    )
    per_group = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(g).cast("string").alias("group")) for i, g in enumerate(groups)]))

    def spread(df: DataFrame) -> DataFrame:
        traits_of = df.select(*entity, *groups, *traits).select(*entity, per_trait.alias("t"), *groups)
        return traits_of.select(*entity, "t.*", per_group.alias("g")).select(*entity, "trait", "actual", "g.*").filter("group IS NOT NULL")

    conventions = modal_values(spread(df), [*within, "level", "group", "trait"], "actual").filter(
        (F.col("total") >= min_support)
        & (F.col("matching") >= min_support)
        & (F.col("matching") * 100 >= F.col("total") * min_ratio)
    )
    if ignored := list(ignore):
        conventions = conventions.filter(
            ~F.struct("group", "trait").isin([F.struct(F.lit(g), F.lit(t)) for g, t in ignored])
        )
    if meaningful is not None:
        conventions = conventions.filter(meaningful(F.col("trait"), F.col("expected")))
    conventions = written(conventions)
    # Who is judged is settled before rows are spread over traits and groups.  A frequent ending has its rows in all tasks, as the
    # conventions go to them; only very many conventions are brought together with their rows by a shuffle.
    judged = spread(df if changed is None else df.join(changed.select(*entity).distinct(), list(entity), "left_semi"))
    found = judged.join(F.broadcast(conventions) if conventions.count() <= CONVENTIONS_SENT else conventions, [*within, "level", "group", "trait"])
    if len(groups) > 1:
        first = Window.partitionBy(*entity, "trait").orderBy("level")
        found = found.withColumn("first", F.row_number().over(first)).filter("first = 1").drop("first")
    return found.filter(value != F.col("expected")).select(
        *entity, "group", "trait", "actual", "expected", "matching", "total"
    )


def telling_trait(trait: Column, value: Column) -> Column:
    """A boolean trait tells something if true, a name trait if not empty, any other always."""
    return (
        F.when(trait.isin("sealed", "static"), value == "true")
        .when(trait.isin("base", "folder", "namespace"), value != "")
        .otherwise(True)
    )
