"""Gates and barriers: what must exist, what must not refer to what, and which rule applies.

Rules are configuration: they are compiled into one expression (first or best match wins), so judging rows needs no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import any_of, exempt_file, first_match, module_match, name_pattern


def required_group(required: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Required combinations that don't exist."""
    return required.join(existing, list(keys), "left_anti")


def name_collision(own: DataFrame, known: DataFrame, name: str, owner: str, exceptions: Sequence[str] = (), simple: str | None = None) -> DataFrame:
    """Rows of ``own`` whose name is known elsewhere, with the first ``owner``; exceptions (by ``simple`` name) are left out."""
    first = known.groupBy(name).agg(F.min(owner).alias(owner))
    kept = own.filter(~F.col(simple or name).isin(list(exceptions))) if exceptions else own
    return kept.join(first, name)


def barrier(refs: DataFrame, source: str, target: str, rules: Sequence[tuple[str, str]], path: str | None = None, exempt: Sequence[str] = ()) -> DataFrame:
    """References from a rule's source module to its forbidden one, with ``rule`` (``A>B``); the first rule wins."""
    rows = refs.filter(~exempt_file(F.col(path), exempt)) if path and exempt else refs
    tests = [module_match(F.col(source), a) & module_match(F.col(target), b) for a, b in rules]
    return _ruled(rows, tests, rules)


def pattern_barrier(df: DataFrame, owner: str, types: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of an owner (pattern) that use, among ``types`` (array), one that a rule forbids it; the first rule wins."""
    def uses(pattern: str) -> Column:
        return F.exists(F.col(types), lambda t: name_pattern(t, pattern))

    return _ruled(df, [name_pattern(F.col(owner), a) & uses(b) for a, b in rules], rules)


def _ruled(df: DataFrame, tests: Sequence[Column], rules: Sequence[tuple[str, str]]) -> DataFrame:
    rule = first_match(tests, [f"{a}>{b}" for a, b in rules]).cast("string")
    return df.withColumn("rule", rule).filter("rule IS NOT NULL")


def best_match(df: DataFrame, rules: Sequence[dict], test: Callable[[dict], Column], rank: Callable[[dict], int], name: str = "rule") -> DataFrame:
    """``df`` with the number of the best rule that matches (highest ``rank``, first of equals), null if none does."""
    order = sorted(range(len(rules)), key=lambda i: (-rank(rules[i]), i))
    return df.withColumn(name, first_match([test(rules[i]) for i in order], order).cast("int"))


def accountable_members(members: DataFrame, head: DataFrame, keys: Sequence[str], floor: int) -> DataFrame:
    """Members that are new with ``body_lines`` of ``floor`` or more, or changed and grown by as much.

    ``head`` keeps, of several members with one key, the longest (of equals the smallest hash).
    """
    longest = F.max_by(F.struct("body_hash", "body_lines"), F.struct("body_lines", F.hash("body_hash"))).alias("h")
    before = head.groupBy(*keys).agg(longest).select(*keys, F.col("h.body_hash").alias("_hash"), F.col("h.body_lines").alias("_lines"))
    joined = members.join(before, list(keys), "left")
    grown = F.when(F.col("_hash").isNull(), F.col("body_lines") >= floor).otherwise(
        (F.col("_hash") != F.col("body_hash")) & (F.col("body_lines") - F.col("_lines") >= floor)
    )
    return joined.filter(grown).drop("_hash", "_lines")


def link_gate(accountable: DataFrame, evidence: DataFrame, owner: str, member: str, called: str, test: str) -> DataFrame:
    """Members that no evidence for their owner calls, with ``evidences``: how many tests there are for the owner.

    ``evidence`` has a row per test (``test``), owner it refers to and array ``called``.
    """
    calls = evidence.select(owner, F.explode(called).alias(member)).distinct()
    tests = evidence.groupBy(owner).agg(F.countDistinct(test).alias("evidences"))
    missing = accountable.join(calls, [owner, member], "left_anti")
    return missing.join(tests, owner, "left").withColumn("evidences", F.coalesce("evidences", F.lit(0)))


def none_of(value: Column, patterns: Sequence[str]) -> Column:
    return ~any_of([name_pattern(value, p) for p in patterns])
