"""Sizes, growth and the share of tests in a change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import change_key, csv_line, usage_percent
from ..operators.budgets import over_budget, ratio_gate, with_budget
from ..operators.ranges import change_log
from ..plans.diagnostics import report
from ..sources.config import bounded_int


def large_types(facts: dict, options: dict) -> DataFrame:
    most = bounded_int(options, "loc_max_lines_per_class", 20, 1)
    big = facts["type_decl"].filter(F.col("kind").isin("class", "record", "record struct") & (F.col("non_blank_lines") > most))
    return report(big, "ARCH006", F.col("name"), F.col("path"), F.col("start_line"), F.col("project"), lines=F.col("non_blank_lines"), max=F.lit(most))


def large_methods(facts: dict, options: dict) -> DataFrame:
    most = bounded_int(options, "loc_max_lines_per_method", 20, 1)
    big = facts["member"].filter((F.col("kind") == "method") & (F.col("non_blank_lines") > most))
    return report(big, "ARCH007", F.col("name"), F.col("path"), F.col("line"), F.col("project"), lines=F.col("non_blank_lines"), max=F.lit(most))


def growth(facts: dict, *scope: str) -> DataFrame:
    """baseline and added lines per scope."""
    base = facts["baseline"].groupBy(*scope).agg(F.sum("lines").alias("baseline"))
    added = facts["numstat"].groupBy(*scope).agg(F.sum("added").alias("added"))
    joined = base.join(added, list(scope), "left") if scope else base.withColumn("_", F.lit(1)).join(F.broadcast(added.withColumn("_", F.lit(1))), "_")
    return joined.withColumn("added", F.coalesce("added", F.lit(0)))


def solution_growth(facts: dict, options: dict) -> DataFrame | None:
    percent = bounded_int(options, "loc_budget_percent_global", 0, 1)
    if not percent:
        return None
    return report(over_budget(growth(facts), percent), "ARCH008", F.lit("solution"), added=F.col("added"), budget=F.col("budget"))


def project_growth(facts: dict, options: dict) -> DataFrame | None:
    percent = bounded_int(options, "loc_budget_percent_project", 0, 1)
    if not percent:
        return None
    over = over_budget(growth(facts, "project"), percent)
    return report(over, "ARCH009", F.col("project"), None, None, F.col("project"), added=F.col("added"), budget=F.col("budget"))


def _shares(facts: dict) -> DataFrame:
    test = F.coalesce("is_test", F.lit(False))
    return facts["numstat"].agg(
        F.coalesce(F.sum(F.when(test, F.col("added"))), F.lit(0)).alias("tests"),
        F.coalesce(F.sum(F.when(~test, F.col("added"))), F.lit(0)).alias("production"),
    )


def test_share(facts: dict, options: dict) -> DataFrame | None:
    least = bounded_int(options, "min_test_lines_percent", 0, 0)
    if not least:
        return None
    found = ratio_gate(_shares(facts), "tests", "production", least, bounded_int(options, "test_ratio_min_added_lines", 50, 0))
    return report(found, "ARCH021", F.lit("tests"), percent=F.col("percent"), min=F.lit(least))


def gauge(facts: dict, options: dict) -> DataFrame:
    """scope, baseline, added, budget, usage, over: the solution and every project, budgeted or not."""
    whole = with_budget(growth(facts), bounded_int(options, "loc_budget_percent_global", 0, 1)).withColumn("scope", F.lit("solution"))
    each = with_budget(growth(facts, "project"), bounded_int(options, "loc_budget_percent_project", 0, 1)).withColumnRenamed("project", "scope")
    columns = ["scope", "baseline", "added", "budget"]
    rows = whole.select(*columns).unionByName(each.select(*columns))
    return rows.withColumn("usage", usage_percent(F.col("added"), F.col("budget"))).withColumn(
        "over", (F.col("budget") > 0) & (F.col("added") > F.col("budget"))
    )


def history(builds: DataFrame) -> DataFrame:
    """ts, line (CSV) of builds (ts, prompt, paths, production, tests, budget, usage, over) whose change is a new one."""
    keyed = builds.withColumn("key", change_key(F.col("prompt"), F.col("paths"), F.col("production"), F.col("tests")))
    new = change_log(keyed, ["ts"], "key")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = [stamp, F.col("prompt"), F.size("paths"), F.col("production"), F.col("tests"), F.col("budget"), F.col("usage"), F.col("over")]
    return new.select("ts", csv_line(*fields).alias("line"))


RULES = {
    "ARCH006": (("type_decl",), large_types),
    "ARCH007": (("member",), large_methods),
    "ARCH008": (("baseline", "numstat"), solution_growth),
    "ARCH009": (("baseline", "numstat"), project_growth),
    "ARCH021": (("numstat",), test_share),
}
