"""The one shape every rule returns, and its messages in English and French."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "rule_id string, severity string, project string, path string, line int, subject string, args map<string,string>"

#: rule_id: (English, French); ``{name}`` stands for an argument.
MESSAGES = {
    "ARCH001": ("{subject} belongs in {folder}", "{subject} doit se trouver dans {folder}"),
    "ARCH002": ("{subject} is not named like its file", "{subject} ne porte pas le nom de son fichier"),
    "ARCH003": ("{subject} does not fit here: {expected}", "{subject} n'a pas sa place ici : {expected}"),
    "ARCH004": ("{subject} implements {interface} in the module that declares it", "{subject} implémente {interface} dans le module qui la déclare"),
    "ARCH005": ("property {subject} comes after {previous}", "la propriété {subject} vient après {previous}"),
    "ARCH006": ("type {subject} has {lines} lines, {max} allowed", "le type {subject} a {lines} lignes, {max} permises"),
    "ARCH007": ("method {subject} has {lines} lines, {max} allowed", "la méthode {subject} a {lines} lignes, {max} permises"),
    "ARCH008": ("the solution grew by {added} lines, {budget} allowed", "la solution a grandi de {added} lignes, {budget} permises"),
    "ARCH009": ("project {subject} grew by {added} lines, {budget} allowed", "le projet {subject} a grandi de {added} lignes, {budget} permises"),
    "ARCH010": ("project {subject} has no file in {folder}", "le projet {subject} n'a aucun fichier dans {folder}"),
    "ARCH011": ("method {subject} comes after {previous}", "la méthode {subject} vient après {previous}"),
    "ARCH012": ("{subject} must not be used here: {rule}", "{subject} ne doit pas être utilisé ici : {rule}"),
    "ARCH013": ("variable name {subject} is shorter than {min}", "le nom de variable {subject} a moins de {min} caractères"),
    "ARCH014": ("class name {subject} is shorter than {min}", "le nom de classe {subject} a moins de {min} caractères"),
    "ARCH015": ("method name {subject} is shorter than {min}", "le nom de méthode {subject} a moins de {min} caractères"),
    "ARCH016": ("{subject} takes a forbidden type: {rule}", "{subject} reçoit un type interdit : {rule}"),
    "ARCH017": ("string concatenation", "concaténation de chaînes"),
    "ARCH018": ("string interpolation", "interpolation de chaîne"),
    "ARCH019": ("{subject} repeats {original} ({similarity} %)", "{subject} répète {original} ({similarity} %)"),
    "ARCH020": ("type {subject} exists in {assembly}", "le type {subject} existe dans {assembly}"),
    "ARCH021": ("{percent} % of the added lines are tests, {min} % required", "{percent} % des lignes ajoutées sont des tests, {min} % exigés"),
    "ARCH022": ("complexity of {subject} rose from {before} to {after}", "la complexité de {subject} est passée de {before} à {after}"),
    "ARCH023": ("complexity of {subject} rose from {before} to {after} in a file changed {churn} times", "la complexité de {subject} est passée de {before} à {after} dans un fichier modifié {churn} fois"),
    "ARCH024": ("{subject}: {trait} is {actual}, {matching} of {total} have {expected}", "{subject} : {trait} vaut {actual}, {matching} sur {total} ont {expected}"),
    "ARCH025": ("{subject} changed and none of {evidences} tests calls it", "{subject} a changé et aucun des {evidences} tests ne l'appelle"),
    "ARCH027": ("this block was removed in {sha} ({subject_line}), {ago} commits ago", "ce bloc a été retiré dans {sha} ({subject_line}), il y a {ago} commits"),
}

WARNINGS = ("ARCH022", "ARCH024", "ARCH027")


def report(
    df: DataFrame, of: str | Column, subject: Column, path: Column | None = None, line: Column | None = None,
    project: Column | None = None, **args: Column,
) -> DataFrame:
    """``df``'s rows as diagnostics of the rule ``of``."""
    none = F.lit(None)
    rule_id = F.lit(of) if isinstance(of, str) else of
    entries = [x for k, v in args.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        rule_id.alias("rule_id"),
        F.when(rule_id.isin(*WARNINGS), "warning").otherwise("error").alias("severity"),
        (none if project is None else project).cast("string").alias("project"),
        (none if path is None else path).cast("string").alias("path"),
        (none if line is None else line).cast("int").alias("line"),
        subject.cast("string").alias("subject"),
        (F.create_map(*entries) if entries else F.create_map()).cast("map<string,string>").alias("args"),
    )


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def with_message(diagnostics: DataFrame, language: str = "en") -> DataFrame:
    """``message`` in a language: the rule's template with subject and arguments filled in."""
    column = 1 if language == "fr" else 0
    text = F.lit(None).cast("string")
    for rule, templates in MESSAGES.items():
        filled = F.lit(templates[column])
        for name in _names(templates[column]):
            value = F.col("subject") if name == "subject" else F.try_element_at(F.col("args"), F.lit(name))
            filled = F.replace(filled, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
        text = F.when(F.col("rule_id") == rule, filled).otherwise(text)
    return diagnostics.withColumn("message", text)


def _names(template: str) -> list[str]:
    import re

    return re.findall(r"{(\w+)}", template)
