"""Scalar text, path and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_line(line: Column) -> Column:
    """White space inside the line becomes one space, at its ends it goes."""
    return F.trim(F.regexp_replace(line, r"[ \t\r\n\f\x0B]+", " "))


def is_trivial(normalized: Column) -> Column:
    """Nothing but brackets and punctuation that carries no meaning of its own."""
    return F.rlike(normalized, F.lit(r"^[{}();,]*$"))


def is_blank(line: Column) -> Column:
    return F.rlike(line, F.lit(r"^\s*$"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def non_blank_lines(text: Column) -> Column:
    return F.size(F.filter(lines_of(text), lambda x: ~is_blank(x))).cast("long")


def camel_words(name: Column) -> Column:
    """Words of a CamelCase name, an acronym being one word; what stands before the first capital is left out."""
    cut = F.split(name, r"(?<=\P{Lu})(?=\p{Lu})|(?<=.)(?=\p{Lu}\p{Ll})", -1)
    return F.filter(cut, lambda w: F.rlike(w, F.lit(r"^\p{Lu}")))


def camel_suffixes(name: Column) -> Column:
    """Last two words (of three or more), then the last word (of two or more)."""
    w = camel_words(name)
    one = F.when(F.size(w) >= 2, F.array(F.element_at(w, -1))).otherwise(F.array().cast("array<string>"))
    two = F.when(F.size(w) >= 3, F.array(F.concat(F.element_at(w, -2), F.element_at(w, -1)))).otherwise(
        F.array().cast("array<string>")
    )
    return F.concat(two, one)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def dir_parts(path: Column) -> Column:
    parts = F.filter(F.split(path, r"[/\\]+", -1), lambda p: p != "")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def folder_display(parts: Column) -> Column:
    """The last two directories, the only one, or ``(none)``."""
    return (
        F.when(F.size(parts) >= 2, F.concat_ws("/", F.slice(parts, -2, 2)))
        .when(F.size(parts) == 1, F.element_at(parts, 1))
        .otherwise("(none)")
    )


def relative_path(path: Column, root: str) -> Column:
    """``path`` below ``root``, whatever the case; null elsewhere."""
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(F.upper(path), F.lit(top.upper())), F.substring(path, len(top) + 1, 1 << 30))


def short_sha(sha: Column) -> Column:
    return F.left(sha, F.lit(7))


def percent_budget(baseline: Column, percent: int) -> Column:
    """max(1, ceil(baseline * percent / 100)); 0 where nothing is budgeted."""
    exact = F.expr("div(0, 1)") if percent <= 0 else F.floor((baseline * percent + 99) / F.lit(100))
    return F.when((F.lit(percent) > 0) & (baseline > 0), F.greatest(F.lit(1), exact)).otherwise(0).cast("long")


def usage_percent(added: Column, budget: Column) -> Column:
    """added * 100 / budget with halves rounded to even; null without a budget."""
    return F.bround(added * 100 / F.nullif(budget, F.lit(0)), 0).cast("long")


def csv_line(*fields: Column) -> Column:
    """RFC 4180: fields with a comma, a quote or a line break are quoted, quotes doubled."""
    quoted = [
        F.when(F.rlike(f, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(f)
        for f in (F.coalesce(x.cast("string"), F.lit("")) for x in fields)
    ]
    return F.concat_ws(",", *quoted)


def change_key(prompt: Column, paths: Column, *counts: Column) -> Column:
    """A key of a change: its prompt, its paths (any order, any case) and its counts."""
    sorted_paths = F.array_join(F.array_sort(F.transform(paths, F.upper)), "|")
    return F.sha2(F.concat_ws("|", F.coalesce(prompt, F.lit("")), sorted_paths, *[c.cast("string") for c in counts]), 256)


def display_name(owner: Column, member: Column) -> Column:
    return F.concat_ws(".", F.nullif(owner, F.lit("")), member)


#: Node kinds that add one branch each.
BRANCHES = (
    "if", "while", "do", "for", "foreach", "foreach_variable", "case", "case_pattern", "switch_arm", "catch", "when",
    "conditional", "and", "or", "coalesce", "coalesce_assignment",
)


def cyclomatic(node_kinds: Column) -> Column:
    """1 + the number of branching nodes of a body; 0 without a body (null)."""
    kinds = F.array(*map(F.lit, BRANCHES))
    return F.coalesce(F.size(F.filter(node_kinds, lambda k: F.array_contains(kinds, k))) + 1, F.lit(0)).cast("long")
