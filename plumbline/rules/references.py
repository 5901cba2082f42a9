"""What may not refer to what, and names that exist elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import any_of, name_pattern, scope_match
from ..functions.types import may_name, nominal_names
from ..operators.gates import barrier, name_collision, pattern_barrier
from ..plans.diagnostics import report
from ..sources.config import items, pairs


def module_barrier(facts: dict, options: dict) -> DataFrame | None:
    """One row per use."""
    rules = pairs(options.get("module_reference_barrier"), ">", ";,")
    if not rules:
        return None
    exempt = items(options.get("module_reference_barrier_exceptions"))
    rows = facts["reference"].select("project", "path", "line", "to_symbol", "to_assembly")
    found = barrier(rows, "project", "to_assembly", rules, "path", exempt)
    return report(found, "ARCH012", F.col("to_symbol"), F.col("path"), F.col("line"), F.col("project"), rule=F.col("rule"))


def parameter_barrier(facts: dict, options: dict) -> DataFrame | None:
    rules = [(a, b) for a, bs in pairs(options.get("method_argument_type_barrier")) for b in items(bs, ",")]
    if not rules:
        return None
    judged = facts["parameter"].filter((F.col("type_kind") == "class") & ~F.coalesce("is_error", F.lit(False)))
    if "type_text" in judged.columns:
        # Reading a type's names costs far more than to see that its text has none that a rule forbids the owner.
        may = [name_pattern(F.col("type_name"), a) & may_name(F.col("type_text"), b) for a, b in rules]
        judged = judged.filter(any_of(may))
        judged = judged.withColumn("nominal_names", nominal_names(F.col("type_text"), F.col("type_parameters")))
    found = pattern_barrier(judged, "type_name", "nominal_names", rules)
    subject = F.concat_ws(".", "type_name", "method")
    return report(found, "ARCH016", subject, F.col("path"), F.col("line"), F.col("project"), rule=F.col("rule"))


def known_types(facts: dict, options: dict) -> DataFrame | None:
    """Top-level types whose metadata name is public in another assembly of the scope (by default the first segment)."""
    own = facts["type_decl"].filter(~F.coalesce("is_nested", F.lit(False)))
    own = own.withColumn("_tail", F.when(F.col("arity") > 0, F.concat_ws("`", "name", "arity")).otherwise(F.col("name")))
    known = facts["assembly_type"].filter("accessibility = 'public'").withColumn("_tail", F.element_at(F.split("metadata_name", r"\.", -1), -1))
    if scope := options.get("duplicate_type_name_scope"):
        known = known.filter(scope_match(F.col("assembly"), scope)).withColumn("_scope", F.lit(""))
        own = own.withColumn("_scope", F.lit(""))
    else:
        first = lambda c: F.upper(F.split_part(c, F.lit("."), F.lit(1)))
        known, own = known.withColumn("_scope", first("assembly")), own.withColumn("_scope", first("project"))
    keyed = lambda df: df.withColumn("_key", F.concat_ws("|", "_scope", "_tail"))
    except_ = items(options.get("duplicate_type_name_exceptions"))
    found = name_collision(keyed(own), keyed(known).select("_key", "assembly"), "_key", "assembly", except_, "name")
    return report(found, "ARCH020", F.col("name"), F.col("path"), F.col("start_line"), F.col("project"), assembly=F.col("assembly"))


RULES = {
    "ARCH012": (("reference",), module_barrier),
    "ARCH016": (("parameter",), parameter_barrier),
    "ARCH020": (("type_decl", "assembly_type"), known_types),
}
