"""Layered ini-style settings and the small rule strings in them; read on the driver, they are configuration."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

CONFIG = "key string, value string, depth int, ord int"


def relevant_section(section: str | None) -> bool:
    """Settings before any section, in ``*``, in ``*.cs``, or in braces with ``cs``."""
    return section is None or section in ("*", "*.cs") or ("{" in section and "cs" in section)


def parse_settings(text: str) -> tuple[list[tuple[str, str, int]], bool]:
    """(key, value, line) of the relevant sections, and whether the file says ``root = true``."""
    section, out, root = None, [], False
    for number, raw in enumerate(text.splitlines()):
        line = raw.strip()
        if not line or line[0] in "#;":
            continue
        if line[0] == "[" and line[-1] == "]":
            section = line[1:-1].strip()
        elif "=" in line:
            key, value = (x.strip() for x in line.split("=", 1))
            if section is None and key.lower() == "root":
                root = value.lower() == "true"
            elif relevant_section(section):
                out.append((key.lower(), value, number))
    return out, root


def config_rows(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """Rows of settings files given from the nearest to the outermost; those beyond a root file don't count."""
    rows = []
    for depth, text in enumerate(files):
        found, root = parse_settings(text)
        rows += [(k, v, -depth, n) for k, v, n in found]
        if root:
            break
    return spark.createDataFrame(rows, CONFIG)


def bounded_int(options: Mapping[str, str], key: str, default: int, low: int, high: int = 1 << 31) -> int:
    """A whole number from ``low`` to ``high``, else the default."""
    raw = (options.get(key) or "").strip()
    return int(raw) if re.fullmatch(r"[+-]?\d+", raw) and low <= int(raw) <= high else default


def items(raw: str | None, separators: str = ";,") -> list[str]:
    return [x.strip() for x in re.split(f"[{re.escape(separators)}]", raw or "") if x.strip()]


def pairs(raw: str | None, between: str = ">", separators: str = ";") -> list[tuple[str, str]]:
    """``A>B;C>D`` as pairs; an item without both sides is skipped."""
    cut = [x.split(between, 1) for x in items(raw, separators) if between in x]
    return [(a.strip(), b.strip()) for a, b in cut if a.strip() and b.strip()]


def assignments(raw: str | None) -> list[tuple[str, list[str]]]:
    """``k=v1,v2;…`` as (k, [v1, v2])."""
    return [(k, v) for k, right in pairs(raw, "=") if (v := items(right, ","))]


def current_prompt(file_text: str | None, environment: str | None) -> str:
    """The prompt file's text if the file is there, even if empty, else the environment's, else nothing."""
    return (file_text if file_text is not None else environment or "").strip()
