"""Name, path and module patterns compiled on the driver into Column predicates (no join, no UDF)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_name_pattern(raw: str) -> tuple[str, str] | None:
    """(kind, token) of ``x``, ``*x``, ``x*`` or ``*x*``; None if nothing is left without the stars at its ends."""
    raw = raw.strip()
    token = raw.strip("*")
    if not token:
        return None
    starts, ends = raw.startswith("*"), raw.endswith("*")
    return {(False, False): "exact", (True, False): "suffix", (False, True): "prefix", (True, True): "contains"}[
        (starts, ends)
    ], token


def name_pattern(name: Column, raw: str) -> Column:
    """Whether ``name`` matches; a null or empty name never does, nor does an empty pattern."""
    parsed = parse_name_pattern(raw)
    if parsed is None:
        return F.lit(False)
    kind, token = parsed
    test = {"exact": lambda: name == token, "suffix": lambda: F.endswith(name, F.lit(token)),
            "prefix": lambda: F.startswith(name, F.lit(token)), "contains": lambda: F.contains(name, F.lit(token))}[kind]()
    return F.coalesce(test & (name != ""), F.lit(False))


def is_named(name: str, raw: str) -> bool:
    """The same of a name that the driver knows."""
    kind, token = parse_name_pattern(raw) or ("exact", "")
    test = {"exact": name.__eq__, "suffix": name.endswith, "prefix": name.startswith, "contains": name.__contains__}[kind]
    return bool(token and test(token))


def glob_regex(glob: str, anchored: bool) -> str:
    """A full-match regex: ``*`` stays in a segment, ``**`` spans any number of segments; not anchored means a path suffix."""
    out = "^" if anchored else "^(?:.*/)?"
    parts = [p for p in glob.replace("\\", "/").split("/") if p]
    pending = ""  # the slash that the next segment needs before it
    for i, part in enumerate(parts):
        if part == "**":
            if i == len(parts) - 1:
                out += "(?:/[^/]+)*" if pending else "(?:[^/]+/)*[^/]*"
                pending = ""
            else:
                out += pending + "(?:[^/]+/)*"
                pending = ""
            continue
        out += pending + "[^/]*".join(re.escape(x) for x in part.split("*"))
        pending = "/"
    return out + "$"


def glob_match(path: Column, file_name: Column, glob: str, anchored: bool = True) -> Column:
    """A glob without a slash is held against the file name, one with a slash against the path."""
    if "/" not in glob and "\\" not in glob:
        return F.rlike(file_name, F.lit(glob_regex(glob, True)))
    return F.rlike(path, F.lit(glob_regex(glob, anchored)))


def folder_parts(folder: str) -> list[str]:
    return [p.strip() for p in re.split(r"[>/\\]+", folder) if p.strip()]


def folder_suffix(parts: Column, folder: str) -> Column:
    """Whether the last directories equal ``folder`` (``>``, ``/`` and ``\\`` separate), whatever the case."""
    expected = [p.upper() for p in folder_parts(folder)]
    if not expected:
        return F.lit(False)
    k = len(expected)
    return F.transform(F.slice(parts, -k, k), F.upper) == F.array(*map(F.lit, expected))


def module_match(name: Column, module: str) -> Column:
    """``name`` is the module, lies below it or ends with it, whatever the case."""
    n, m = F.upper(name), module.upper()
    return (n == m) | F.startswith(n, F.lit(m + ".")) | F.endswith(n, F.lit("." + m))


def scope_match(name: Column, scope: str) -> Column:
    n, s = F.upper(name), scope.upper()
    return (n == s) | F.startswith(n, F.lit(s + "."))


def exempt_file(path: Column, entries: Sequence[str]) -> Column:
    """The path or its file name is an entry, or the path ends with one, whatever the case."""
    p = F.upper(path)
    tests = [(p == e.upper()) | F.endswith(p, F.lit("/" + e.upper())) for e in entries]
    return any_of(tests)


def any_of(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def contains_any(path: Column, fragments: Sequence[str]) -> Column:
    """Whether the lower-cased path with a slash before it contains a fragment."""
    low = F.lower(F.concat(F.lit("/"), path))
    return any_of([F.contains(low, F.lit(f.lower())) for f in fragments])


def first_match(tests: Sequence[Column], values: Sequence) -> Column:
    """The value of the first test that holds, else null: rules in order, first wins."""
    out = F.lit(None)
    for t, v in reversed(list(zip(tests, values))):
        out = F.when(F.coalesce(t, F.lit(False)), F.lit(v)).otherwise(out)
    return out


#: Path fragments of test files.
TEST_FILES = ("/tests/", ".tests/", "tests.cs", "test.cs", "spec.cs")


def identifier_like(name: Column) -> Column:
    return F.rlike(name, F.lit("(Id|Ids|IDs)$"))
