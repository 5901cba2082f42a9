"""Licence scan: fuzzy search for short notices.

A notice of up to k edits is split into k + 1 pieces; by the pigeonhole principle one of them stands unchanged in every
match.  One Aho-Corasick automaton finds the pieces of all notices in the whole text; around each hit the regex library's
bounded-error matching verifies the notice, counts its edits and gives its span.  Matches begin and end at words.

Texts are matched as words ``[0-9a-z and non-ASCII]+`` of the text lower-cased in A-Z, joined by one space and read as
bytes, so an edit is a byte.

Defined cases: a null text counts as empty; an empty text has no words, no span and score 0; equal rows give equal rows;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty


class Notice(NamedTuple):
    label: str
    phrase: str
    edits: int
    base: bool = False


#: The base phrases and their labels, then further short notices.
NOTICES = (
    Notice("mit", "mit license", 1, True),
    Notice("apache", "apache license", 1, True),
    Notice("gpl", "general public license", 2, True),
    Notice("agpl", "affero general public license", 2),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("cc", "creative commons attribution", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("lgpl", "lesser general public license", 2),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("mpl", "mozilla public license", 2),
    Notice("public-domain", "released into the public domain", 2),
)
SPANS = "array<struct<label:string,base:boolean,first_word:bigint,last_word:bigint,edits:int,score:double,text:string>>"


def pieces(phrase: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of the edits + 1 nearly equal parts of ``phrase``."""
    cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:])]


def normalise(text: str) -> tuple[str, int]:
    """The words of ``text`` between single spaces, one character a byte, and their number."""
    table = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256))
    words = text.encode("utf-8").translate(table).split()
    return f" {b' '.join(words).decode('latin-1')} ", len(words)


class Scanner:
    def __init__(self, notices: Sequence[Notice]):
        import ahocorasick
        import regex

        self.notices, seeds = notices, {}
        for n, notice in enumerate(notices):
            for offset, piece in pieces(notice.phrase, notice.edits):
                seeds.setdefault(piece, []).append((n, offset))
        self.seeds = ahocorasick.Automaton()
        for piece, places in seeds.items():
            self.seeds.add_word(piece, (len(piece), places))
        self.seeds.make_automaton()
        self.patterns = [
            regex.compile(rf"(?b)(?<= )(?:{regex.escape(n.phrase, literal_spaces=True)}){{e<={n.edits}}}(?= )")
            for n in notices
        ]

    def spans(self, line: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) of the matches in a normalised text, in order."""
        found, tried = set(), set()
        for end, (length, places) in self.seeds.iter(line):
            for n, offset in places:
                start = end - length + 1 - offset
                if (n, start) not in tried:
                    tried.add((n, start))
                    if hit := self._verify(line, n, start):
                        found.add(hit)
        exact = {(a, b, n) for a, b, n, e in found if e == 0}
        # A looser match over words of an exact match of the same notice says nothing new.
        covered: dict[int, list[tuple[int, int]]] = {}
        for a, b, n in sorted(exact):
            covered.setdefault(n, []).append((a, b))
        kept = [h for h in found if h[3] == 0 or not _overlaps(covered.get(h[2], []), h[0], h[1])]
        return sorted(kept)

    def _verify(self, line: str, n: int, start: int) -> tuple[int, int, int, int] | None:
        phrase, k = self.notices[n].phrase, self.notices[n].edits
        stop = start + len(phrase)
        if line.startswith(f" {phrase} ", start - 1) and start > 0:
            return start, stop, n, 0
        m = self.patterns[n].search(line, max(0, start - k - 1), min(len(line), stop + k + 1))
        return (m.start(), m.end(), n, sum(m.fuzzy_counts)) if m else None

    def scan(self, text: str) -> tuple[int, list[dict]]:
        line, n_words = normalise(text)
        out, at, word = [], 1, 0
        for a, b, n, edits in self.spans(line):
            word, at = word + line.count(" ", at, a), a
            notice = self.notices[n]
            out.append(
                {
                    "label": notice.label,
                    "base": notice.base and edits == 0,
                    "first_word": word,
                    "last_word": word + line.count(" ", a, b),
                    "edits": edits,
                    "score": 1.0 - edits / len(notice.phrase),
                    "text": line[a:b].encode("latin-1").decode("utf-8", "replace"),
                }
            )
        return n_words, out


def _overlaps(sorted_spans: list[tuple[int, int]], a: int, b: int) -> bool:
    import bisect

    i = bisect.bisect_left(sorted_spans, (b, -1))
    return i > 0 and sorted_spans[i - 1][1] > a


def scan(df: DataFrame, notices: Sequence[Notice] = NOTICES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and spans (label, base, first_word, last_word, edits, score, text) of every row of ``df``."""
    rows = df.select(F.col(doc_id).cast("string").alias("doc_id"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(notices)
        for pdf in batches:
            for part in slices(pdf):
                got = [scanner.scan(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_words": [g[0] for g in got], "spans": [g[1] for g in got]})

    found = rows.mapInPandas(run, f"doc_id string, n_words long, spans {SPANS}")
    return found.withColumn("doc_id", F.col("doc_id").cast(df.schema[doc_id].dataType))


def summary(spans: DataFrame) -> DataFrame:
    """Counts, first and last place, labels and score per document from ``scan``'s rows."""
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["first_word"])
    return spans.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
