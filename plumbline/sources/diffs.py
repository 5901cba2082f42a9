"""Facts from the text that version control prints: numstat, logs and patches, one row of text per command output."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIFF_LINE = "sha string, subject string, ago int, path string, run int, new_line int, sign string, text string, seq int"
DIFF_RUN = "sha string, subject string, ago int, path string, run int, first_line int, sign string, lines array<string>"
#: Rows and characters of a batch that a parser returns.
BATCH_ROWS, BATCH_CHARS = 1 << 13, 1 << 22
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def numstat(lines: DataFrame, line: str = "value") -> DataFrame:
    """path, added of ``added<tab>deleted<tab>path`` lines; lines with fewer columns or no count (binary) are skipped."""
    c = F.split(line, "\t", 3)
    rows = lines.filter(F.size(c) >= 3).select(c[2].alias("path"), F.expr(f"try_cast(split({line}, '\\t', 3)[0] AS bigint)").alias("added"))
    return rows.filter("added IS NOT NULL")


def changed_paths(lines: DataFrame, line: str = "value") -> DataFrame:
    """path per line of a log that prints names only."""
    return lines.select(F.trim(line).alias("path")).filter("path <> ''")


def side_table(lines: DataFrame, fields: list[str], line: str = "value") -> DataFrame:
    """Rows of ``a|b|c`` lines; lines with another number of fields are skipped."""
    c = F.split(line, r"\|", -1)
    return lines.filter(F.size(c) == len(fields)).select(*[c[i].alias(f) for i, f in enumerate(fields)])


def removed_table(lines: DataFrame, line: str = "value") -> DataFrame:
    """hash, sha, subject, ago of ``hash|sha|subject|ago``, where a subject may hold ``|``; an unreadable ago is 0."""
    pattern = r"^([^|]*)\|([^|]*)\|(.*)\|([^|]*)$"
    part = lambda i: F.regexp_extract(line, pattern, i)
    ago = F.expr(f"coalesce(try_cast(regexp_extract({line}, '{pattern}', 4) AS int), 0)".replace("\\", "\\\\"))
    return lines.filter(F.rlike(line, F.lit(pattern))).select(part(1).alias("hash"), part(2).alias("sha"), part(3).alias("subject"), ago.alias("ago"))


def diff_lines(texts: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """A row per added or removed line of every patch text, in ``DIFF_LINE``'s columns after ``source``.

    ``run`` numbers stretches of neighbouring lines of one sign in one hunk, ``seq`` the rows of a text; ``new_line`` is the line
    on the new side.  Commits are announced by ``commit <sha> <subject>`` lines or by records of the log (a record separator,
    the hash, a unit separator, the subject), newest first, and count ``ago`` from 1.
    """
    return _parsed(texts, source, text, _numbered, DIFF_LINE)


def diff_runs(texts: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """A row per run of ``diff_lines`` with its lines as an array, in ``DIFF_RUN``'s columns after ``source``.

    ``first_line`` is the place of its first line.  A run lies in one text, so nothing is shuffled to bring it together.
    """
    return _parsed(texts, source, text, _gathered, DIFF_RUN)


def _parsed(texts: DataFrame, source: str, text: str, rows: Callable[[str], Iterator[tuple[int, tuple]]], schema: str) -> DataFrame:
    """``source`` and the ``rows`` (each after its number of characters) of every text."""
    fields = [f.split() for f in schema.split(", ")]

    def batch(sources: pa.Array, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(zip(*found), fields)]
        return pa.RecordBatch.from_arrays([sources.take(pa.array(at)), *columns], [source, *[name for name, _ in fields]])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for read in batches:
            # Making a batch costs far more than a row, so short texts share one and a long one takes several.
            at, found, size = [], [], 0
            for n, t in enumerate(read.column(1)):
                for chars, row in rows(t.as_py() or ""):
                    at.append(n), found.append(row)
                    size += chars
                    if len(found) >= BATCH_ROWS or size >= BATCH_CHARS:
                        yield batch(read.column(0), at, found)
                        at, found, size = [], [], 0
            if found:
                yield batch(read.column(0), at, found)

    kind = texts.schema[source].dataType.simpleString()
    return texts.select(source, text).mapInArrow(parse, f"{source} {kind}, {schema}")


def _numbered(patch: str) -> Iterator[tuple[int, tuple]]:
    for i, r in enumerate(_tagged(patch)):
        yield len(r[-1]), (*r, i)


def _gathered(patch: str) -> Iterator[tuple[int, tuple]]:
    for _, of in groupby(_tagged(patch), key=lambda r: r[4]):
        run = list(of)
        yield sum(len(r[-1]) for r in run), (*run[0][:-1], [r[-1] for r in run])


_NEW_START = re.compile(r"@@[^+]*\+(\d+)")


def _tagged(patch: str) -> Iterator[tuple]:
    sha = subject = path = None
    ago = run = new = 0
    before = ""
    for line in patch.split("\n"):
        line = line.removesuffix("\r")
        if line.startswith(("commit ", "\x1e")):
            sha, _, subject = line[1:].partition("\x1f") if line[0] == "\x1e" else line[7:].partition(" ")
            sha, ago, path, before = sha[:7], ago + 1, None, ""
        elif line.startswith("+++ "):
            target = line[4:].strip()
            path, before = None if target == "/dev/null" else target.removeprefix("b/"), ""
        elif line.startswith("@@"):
            start = _NEW_START.match(line)
            new, before = int(start.group(1)) if start else 0, ""
        elif line.startswith(("---", "diff ", "index ", "\\")):
            before = ""  # neither side has such a line
        elif line[:1] in ("+", "-"):
            run += line[0] != before
            before = line[0]
            yield sha, subject, ago, path, run, new, line[0], line[1:]
            new += line[0] == "+"
        else:
            new, before = new + 1, ""


def _runs(lines: DataFrame, sign: str, keys: list[str], source: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("seq", "new_line", "text")))
    runs = lines.filter(F.col("sign") == sign).groupBy(source, *keys, "run").agg(ordered.alias("r"))
    return runs.select(*keys, F.col("r")[0]["new_line"].cast("int").alias("first_line"), F.col("r.text").alias("lines"))


def removed_runs(lines: DataFrame, source: str = "source", newest: int | None = None) -> DataFrame:
    """sha, subject, ago, lines per run of removed lines of ``diff_lines``, of the ``newest`` commits if that is given."""
    kept = lines if newest is None else lines.filter(F.col("ago") <= newest)
    return _runs(kept.filter("sha <> ''"), "-", ["sha", "subject", "ago"], source).drop("first_line")


def added_runs(lines: DataFrame, source: str = "source") -> DataFrame:
    """path, first_line, lines per run of added lines of ``diff_lines``; lines of no file are left out."""
    return _runs(lines.filter("path IS NOT NULL"), "+", ["path"], source)


def whole_files(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The same for files that version control doesn't know: all their lines are added."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    return files.select(F.col(path).alias("path"), F.lit(1).alias("first_line"), lines.alias("lines"))


def line_counts(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path and lines of files (an end of line at the end begins no further one); an absent file (null text) has none."""
    ends = F.regexp_count(text, F.lit("\n")) + F.when(F.endswith(text, F.lit("\n")) | (F.col(text) == ""), 0).otherwise(1)
    return files.select(F.col(path).alias("path"), F.coalesce(ends, F.lit(0)).cast("long").alias("lines"))


def added_counts(tracked: DataFrame, untracked: DataFrame) -> DataFrame:
    """path, added: of ``numstat`` rows and of untracked files (path, text), whose lines are all added."""
    return tracked.select("path", "added").unionByName(line_counts(untracked).select("path", F.col("lines").alias("added")))


def in_project(rows: DataFrame, members: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` of files that a project lists (members: project, path), with ``project``; whatever the case of paths."""
    of = members.select("project", F.upper("path").alias("_key")).distinct()
    return rows.withColumn("_key", F.upper(path)).join(of, "_key").drop("_key")
