"""Names that are too short; each kind is judged only if its minimum is set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import chain_ends
from ..plans.diagnostics import report
from ..sources.config import bounded_int


def _short(rows: DataFrame, rule: str, least: int, line: str) -> DataFrame | None:
    found = rows.filter(F.length("name") < least)
    return report(found, rule, F.col("name"), F.col("path"), F.col(line), F.col("project"), min=F.lit(least))


def variables(facts: dict, options: dict) -> DataFrame | None:
    least = bounded_int(options, "min_variable_name_length", 0, 1)
    return _short(facts["member"].filter("kind = 'variable'"), "ARCH013", least, "line") if least else None


def classes(facts: dict, options: dict) -> DataFrame | None:
    least = bounded_int(options, "min_class_name_length", 0, 1)
    return _short(facts["type_decl"].filter("kind = 'class'"), "ARCH014", least, "start_line") if least else None


def imposed(facts: dict) -> DataFrame:
    """project, member_id of members whose name comes from elsewhere.

    An override has the name of the member that its chain of overrides ends at; another member that of the interface members
    it implements.  A name comes from elsewhere if the project doesn't declare that member.  A chain that runs in a circle has
    no end and imposes nothing.
    """
    declared = facts["member"].select("project", F.col("member_id").alias("end")).distinct()
    overrides, implements = facts["overrides"], facts["implements"]
    ends = chain_ends(overrides, "member_id", "overridden", ["project"])
    direct = implements.join(overrides, ["member_id", "project"], "left_anti").select("project", "member_id", F.col("interface_member").alias("end"))
    named = ends.select("project", "member_id", "end").unionByName(direct)
    # Spark would push an anti join into each of the tables that ``named`` is the union of, and sort what is declared for each.
    known = named.join(declared.withColumn("_declared", F.lit(True)), ["end", "project"], "left")
    return known.filter("_declared IS NULL").select("project", "member_id").distinct()


def methods(facts: dict, options: dict) -> DataFrame | None:
    """Names that an external base or interface imposes are nobody's choice: by the members' edges, or else by their flag."""
    least = bounded_int(options, "min_method_name_length", 0, 1)
    if not least:
        return None
    own = facts["member"].filter(F.col("kind") == "method")
    if "overrides" in facts and "implements" in facts:
        short = own.filter(F.length("name") < least)
        return _short(short.join(imposed(facts), ["member_id", "project"], "left_anti"), "ARCH015", least, "line")
    return _short(own.filter(~F.coalesce("imposed_externally", F.lit(False))), "ARCH015", least, "line")


RULES = {"ARCH013": (("member",), variables), "ARCH014": (("type_decl",), classes), "ARCH015": (("member",), methods)}
