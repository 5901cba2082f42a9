"""Where types, files and members belong, and in what order they stand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..operators.gates import best_match
from ..operators.sequences import order_violation
from ..operators.closure import closure
from ..plans.diagnostics import report
from ..sources.config import assignments, pairs

_PLACED = ("class", "enum", "record", "record struct")
#: The folder of provider interfaces, the suffix of module projects, and the models whose properties are ordered.
PROVIDERS = "Models/Data/Providers"
MODULE = "Module"
MODELS = ("BusinessModel", "DataModel", "ViewModel")


def _placed(facts: dict) -> DataFrame:
    return facts["type_decl"].filter(F.col("kind").isin(*_PLACED)).withColumn("dirs", X.dir_parts(F.col("path")))


def _any_suffix(suffixes: list[str], name: str = "name"):
    return P.any_of([F.endswith(F.col(name), F.lit(s)) for s in suffixes])


def type_folder(facts: dict, options: dict) -> DataFrame | None:
    """The longest matching suffix says the folder; the file must lie directly in it."""
    conventions = pairs(options.get("model_conventions"), "=") or [
        (options.get("model_suffix", "BusinessModel"), options.get("model_folder", "Models>Business"))
    ]
    rules = [{"suffix": s, "folder": f} for s, f in conventions]
    types = best_match(_placed(facts), rules, lambda r: F.endswith("name", F.lit(r["suffix"])), lambda r: len(r["suffix"]))
    misplaced = P.first_match([F.col("rule") == i for i in range(len(rules))], [r["folder"] for r in rules])
    fits = P.any_of([(F.col("rule") == i) & P.folder_suffix(F.col("dirs"), r["folder"]) for i, r in enumerate(rules)])
    return report(
        types.filter(F.col("rule").isNotNull() & ~fits), "ARCH001", F.col("name"), F.col("path"), F.col("start_line"),
        F.col("project"), folder=misplaced,
    )


def type_file(facts: dict, options: dict) -> DataFrame:
    wrong = _placed(facts).filter(X.file_stem(F.col("path")) != F.col("name"))
    return report(wrong, "ARCH002", F.col("name"), F.col("path"), F.col("start_line"), F.col("project"))


def folder_suffixes(facts: dict, options: dict) -> DataFrame | None:
    """In a folder with a rule (the deepest that matches) names end with one of its suffixes."""
    rules = [{"folder": f, "suffixes": s} for f, s in assignments(options.get("model_folder_allowed_suffixes"))]
    if not rules:
        return None
    types = best_match(_placed(facts), rules, lambda r: P.folder_suffix(F.col("dirs"), r["folder"]), lambda r: len(P.folder_parts(r["folder"])))
    fits = P.any_of([(F.col("rule") == i) & _any_suffix(r["suffixes"]) for i, r in enumerate(rules)])
    expected = P.first_match([F.col("rule") == i for i in range(len(rules))], [", ".join(r["suffixes"]) for r in rules])
    return report(
        types.filter(F.col("rule").isNotNull() & ~fits), "ARCH003", F.col("name"), F.col("path"), F.col("start_line"),
        F.col("project"), expected=expected,
    )


def project_files(facts: dict, options: dict) -> DataFrame | None:
    """Every file of a project (first rule whose pattern matches) matches one of the rule's globs."""
    rules = assignments(options.get("project_allowed_files"))
    if not rules:
        return None
    root = options.get("project_dir")
    path = X.relative_path(F.col("path"), root) if root else F.col("path")
    files = facts["source_file"].filter(~F.coalesce("is_generated", F.lit(False))).withColumn("_rel", F.coalesce(path, F.col("path")))
    at = P.first_match([P.name_pattern(F.col("project"), p) for p, _ in rules], list(range(len(rules))))
    ruled = files.withColumn("rule", at.cast("int")).filter("rule IS NOT NULL")
    name = X.file_name(F.col("path"))
    fits = [(F.col("rule") == i) & P.any_of([P.glob_match(F.col("_rel"), name, g, bool(root)) for g in globs]) for i, (_, globs) in enumerate(rules)]
    expected = P.first_match([F.col("rule") == i for i in range(len(rules))], [", ".join(g) for _, g in rules])
    return report(ruled.filter(~P.any_of(fits)), "ARCH003", name, F.col("path"), None, F.col("project"), expected=expected)


def _providers(facts: dict) -> DataFrame:
    types = facts["type_decl"].filter(F.endswith("project", F.lit(MODULE)))
    return types.filter("kind = 'interface'").filter(P.folder_suffix(X.dir_parts(F.col("path")), PROVIDERS))


def module_without_provider(facts: dict, options: dict) -> DataFrame:
    modules = facts["type_decl"].filter(F.endswith("project", F.lit(MODULE))).select("project").distinct()
    bare = modules.join(_providers(facts), "project", "left_anti")
    return report(bare, "ARCH003", F.col("project"), None, None, F.col("project"), expected=F.lit(f"an interface in {PROVIDERS}"))


def supertypes(facts: dict) -> DataFrame:
    """project, name, parent: the is-a edges that types declare, and those of ``supertype`` if that fact is there."""
    types = facts["type_decl"]
    own = types.select("project", "name", F.explode("interfaces").alias("parent")).unionByName(types.select("project", "name", F.col("base").alias("parent")))
    return own.unionByName(facts["supertype"].select("project", "name", "parent")) if "supertype" in facts else own


def provider_in_module(facts: dict, options: dict) -> DataFrame:
    """A type that implements a provider interface of its own module, itself or over its bases; one row per type, the first interface by name."""
    provided = _providers(facts).select("project", F.col("name").alias("parent")).distinct()
    types = facts["type_decl"].filter(F.endswith("project", F.lit(MODULE)) & (F.col("kind") != "interface"))
    edges = supertypes(facts).filter(F.endswith("project", F.lit(MODULE)))
    implemented = closure(edges, "name", "parent", ["project"], provided).groupBy("project", "name").agg(F.min("parent").alias("interface"))
    hits = types.select("project", "path", "name", "start_line").distinct().join(implemented, ["project", "name"])
    return report(hits, "ARCH004", F.col("name"), F.col("path"), F.col("start_line"), F.col("project"), interface=F.col("interface"))


def _members_in_order(facts: dict, kind: str, rule: str) -> DataFrame:
    members = facts["member"].filter((F.col("kind") == kind) & (F.col("type_kind") == "class"))
    if kind == "property":
        members = members.filter(_any_suffix(list(MODELS), "type_name") & ~P.identifier_like(F.col("name")))
    wrong = order_violation(members, ["project", "path", "type_name"], ["ordinal"], "name")
    return report(wrong, rule, F.col("name"), F.col("path"), F.col("line"), F.col("project"), previous=F.col("previous"))


def property_order(facts: dict, options: dict) -> DataFrame:
    return _members_in_order(facts, "property", "ARCH005")


def method_order(facts: dict, options: dict) -> DataFrame:
    return _members_in_order(facts, "method", "ARCH011")


def required_folders(facts: dict, options: dict) -> DataFrame | None:
    """A project (exact name) needs a file directly in each of its folders."""
    rules: dict[str, list[str]] = {}
    for project, folders in assignments(options.get("required_project_folders")):
        rules.setdefault(project, folders)
    if not rules:
        return None
    path = F.col("path")
    user = facts["source_file"].filter(F.endswith(path, F.lit(".cs")) & ~F.contains(F.lower(path), F.lit("/obj/")))
    files = user.withColumn("dirs", X.dir_parts(path))
    rows = []
    for project, folders in rules.items():
        own = files.filter(F.col("project") == project)
        for folder in folders:
            there = own.groupBy("project").agg(F.bool_or(P.folder_suffix(F.col("dirs"), folder)).alias("there"))
            rows.append(there.filter(~F.coalesce("there", F.lit(False))).select("project", F.lit(folder).alias("folder")))
    missing = reduce(DataFrame.unionByName, rows)
    return report(missing, "ARCH010", F.col("project"), None, None, F.col("project"), folder=F.col("folder"))


RULES = {
    "ARCH001": (("type_decl",), type_folder),
    "ARCH002": (("type_decl",), type_file),
    "ARCH003a": (("type_decl",), folder_suffixes),
    "ARCH003b": (("source_file",), project_files),
    "ARCH003c": (("type_decl",), module_without_provider),
    "ARCH004": (("type_decl",), provider_in_module),
    "ARCH005": (("member",), property_order),
    "ARCH010": (("source_file",), required_folders),
    "ARCH011": (("member",), method_order),
}
