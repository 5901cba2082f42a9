"""Benchmark decontamination: Wu-Manber search for word windows of test items.

A window is ``WINDOW`` consecutive words of an item, or the whole of a shorter one.  Its bytes with a space on either side are
a pattern; patterns are searched in classes by length, so that a short item doesn't shorten the shifts of the others.  Per
class, m is the shortest length and only the first m bytes of a pattern decide where to look: the shift table says for every
block of bytes how far its last place in any of these prefixes is from their end, so positions that no pattern can end at are
skipped; where it says 0, the block's bucket and the first bytes select the patterns that are compared in full.

The shift loop runs over many stretches of the text at a time, one numpy step for all of them.  Texts are read as words
``[0-9a-z and non-ASCII]+`` of the text lower-cased in A-Z, joined by one space.

Items are broadcast in blocks of at most ``BLOCK_BYTES`` of text, which is measured first (a longer item is a block of its
own).  One block, the usual case, is one pass over the documents without a shuffle; for more, every block is a pass over the
same written table and what the passes find is merged per row.

Defined cases: a null text has no words; an item without words is never found; items of one item_id count once, and a null
item_id is one item with an empty name; equal rows give equal rows; windows never cross rows; an empty table gives an empty
result, no items give no hits; other columns are not looked at; a very long text is searched ``SEARCH_BYTES`` at a time, with
overlap, its words numbered through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, text_or_empty

WINDOW = 10
BLOCK_BYTES = 4 << 20
SEARCH_BYTES = 4 << 20
STRETCH = 512
#: Lower ends of the classes by pattern length, in bytes.
CLASSES = (3, 6, 12, 24, 48)

U = np.uint64
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_BREAK = 10  # stands as a word of its own between texts
SPANS = "array<struct<first:bigint,last:bigint>>"


def joined_words(texts: Iterable[str]) -> np.ndarray:
    """The words of all texts between single spaces as bytes, with a line break as a word between two texts."""
    data = np.frombuffer(b" %s " % b" \n ".join(t.encode("utf-8").translate(_TABLE) for t in texts), dtype=np.uint8)
    space = data == 32
    keep = np.ones(len(data), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return data[keep]


def windows(words: list[bytes], size: int) -> list[tuple[bytes, int]]:
    """The patterns of an item's words, and the number of words in each."""
    k = min(size, len(words))
    return [(b" %s " % b" ".join(words[i : i + k]), k) for i in range(len(words) - k + 1)] if k else []


class PatternClass:
    """Wu-Manber tables of patterns that have at least ``m`` bytes."""

    def __init__(self, patterns: list[tuple[bytes, int]]):
        self.m = m = min(len(p) for p, _ in patterns)
        self.block = b = min(8, max(2, m // 3))
        self.longest = max(len(p) for p, _ in patterns)
        self.mask = U((1 << (8 * b)) - 1)
        heads = np.frombuffer(b"".join(p[:m] for p, _ in patterns) + bytes(8), dtype=np.uint8)
        self.bits = min(22, max(12, (len(patterns) * (m - b + 1) * 4).bit_length()))
        at = (np.arange(len(patterns)) * m)[:, None] + np.arange(m - b + 1)
        hashed = self.hashes(blocks_of(heads), at)
        self.shift = np.full(1 << self.bits, m - b + 1, dtype=np.int32)
        for j in range(m - b + 1):  # later places last: they have the smaller shifts
            self.shift[hashed[:, j]] = m - b - j
        self.buckets: dict[int, dict[bytes, list[tuple[bytes, int]]]] = {}
        for h, p in zip(hashed[:, -1].tolist(), patterns):
            self.buckets.setdefault(h, {}).setdefault(p[0][: min(m, 8)], []).append(p)

    def hashes(self, blocks: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (((blocks[at] & self.mask) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def candidates(self, data: np.ndarray) -> np.ndarray:
        """Places in ``data`` where a prefix may start: those whose last block has no shift."""
        last = len(data) - self.m  # the last place where a prefix fits
        if last < 0:
            return np.zeros(0, dtype=np.int64)
        blocks, ahead = blocks_of(np.concatenate([data, np.zeros(8, dtype=np.uint8)])), self.m - self.block
        at = np.arange(0, last + 1, STRETCH)
        stop = np.minimum(at + STRETCH, last + 1)
        found = []
        while len(at):
            step = self.shift[self.hashes(blocks, at + ahead)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate(found)

    def occurrences(self, data: np.ndarray, text: bytes) -> Iterator[tuple[int, tuple[bytes, int]]]:
        """(place, pattern) of every occurrence."""
        at = self.candidates(data)
        blocks = blocks_of(np.concatenate([data, np.zeros(8, dtype=np.uint8)]))
        head = min(self.m, 8)
        for a, h in zip(at.tolist(), self.hashes(blocks, at + (self.m - self.block)).tolist()):
            for p in self.buckets.get(h, {}).get(text[a : a + head], ()):
                if text.startswith(p[0], a):
                    yield a, p


def blocks_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``data`` on as a number."""
    return np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))


class Searcher:
    """The windows of a block of items; tables are made where they are first used, once a worker."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.items, self.size, self.classes = items, size, None

    def __getstate__(self):
        return {"items": self.items, "size": self.size, "classes": None}

    def prepare(self) -> None:
        groups: dict[bytes, set[str]] = {}  # names of the items of equal words
        for name, text in self.items:
            groups.setdefault(joined_words([text]).tobytes(), set()).add(name)
        self.names = [sorted(g) for g in groups.values()]
        self.owners: dict[bytes, set[int]] = {}
        lengths: dict[bytes, int] = {}
        for g, words in enumerate(groups):
            for p, k in windows(words.split(), self.size):
                self.owners.setdefault(p, set()).add(g)
                lengths[p] = k
        of_class: dict[int, list[tuple[bytes, int]]] = {}
        for p, k in lengths.items():
            of_class.setdefault(sum(len(p) >= c for c in CLASSES), []).append((p, k))
        self.classes = [PatternClass(ps) for ps in of_class.values()]

    def occurrences(self, data: np.ndarray) -> Iterator[tuple[int, tuple[bytes, int]]]:
        for c in self.classes:
            for begin in range(0, max(1, len(data) - c.m + 1), SEARCH_BYTES):
                part = data[begin : begin + SEARCH_BYTES + c.longest]
                for a, p in c.occurrences(part, part.tobytes()):
                    if a < SEARCH_BYTES:  # what starts later belongs to the next part
                        yield begin + a, p

    def search(self, texts: list[str]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        """Per text: its number of words, the maximal runs (first, last) of hit words, and the items that were found."""
        if self.classes is None:
            self.prepare()
        data = joined_words(texts)
        starts = np.flatnonzero((data[:-1] == 32) & (data[1:] != 32)) + 1
        breaks = np.flatnonzero(data[starts] == _BREAK)
        first = np.concatenate([[0], breaks + 1])
        count = np.append(breaks, len(starts)) - first
        found = list(self.occurrences(data))
        word = np.searchsorted(starts, np.array([a + 1 for a, _ in found], dtype=np.int64))
        end = word + np.array([p[1] for _, p in found], dtype=np.int64)
        of = np.searchsorted(breaks, word)
        groups: dict[int, set[int]] = {}
        for d, (_, p) in zip(of.tolist(), found):
            groups.setdefault(d, set()).update(self.owners[p[0]])
        runs: dict[int, list[tuple[int, int]]] = {}
        for a, b in merged(word, end):
            d = int(np.searchsorted(breaks, a))
            runs.setdefault(d, []).append((a - int(first[d]), b - int(first[d]) - 1))
        for d, n in enumerate(count.tolist()):
            names = sorted({x for g in groups.get(d, ()) for x in self.names[g]})
            yield n, runs.get(d, []), names


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that the half-open stretches cover."""
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    begin, upto = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > upto[:-1]])
    return list(zip(begin[new].tolist(), upto[np.append(np.flatnonzero(new)[1:] - 1, len(upto) - 1)].tolist()))


def _pass(rows: DataFrame, searcher: Searcher, only_hits: bool) -> DataFrame:
    """key, n_words, spans, items of rows (key, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(searcher)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf):
                got = [(k, *g) for k, g in zip(part["key"], shared.value.search(list(part["text"]))) if g[1] or not only_hits]
                spans = [[{"first": a, "last": b} for a, b in g[2]] for g in got]
                if got:
                    yield pd.DataFrame({"key": [g[0] for g in got], "n_words": [g[1] for g in got], "spans": spans, "items": [g[3] for g in got]})

    return rows.mapInPandas(run, f"key string, n_words long, spans {SPANS}, items array<string>")


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items (name, text), distinct, in lists of at most about ``block_bytes``."""
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    count = 1 if size <= block_bytes else -(-2 * size // block_bytes)
    place = F.pmod(F.xxhash64("name", "text"), F.lit(count))
    for b in range(count):
        yield [(r["name"], r["text"]) for r in items.filter(place == b).collect()]


def find_items(
    df: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, spans (first, last word of every maximal hit run) and items (names, sorted) of every row of ``df``."""
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), text_or_empty(item_text).alias("text")).distinct()
    kind = df.schema[doc_id].dataType
    blocks = _blocks(named, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        rows = df.select(F.col(doc_id).cast("string").alias("key"), text_or_empty(text).alias("text"))
        return _pass(rows, Searcher(first, window), False).select(F.col("key").cast(kind).alias("doc_id"), "n_words", "spans", "items")
    rows = cut(df.select(F.monotonically_increasing_id().cast("string").alias("key"), F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")))
    texts = rows.select("key", "text")
    found = cut(_pass(texts, Searcher(first, window), False))
    further = second
    while further is not None:
        found = found.unionByName(cut(_pass(texts, Searcher(further, window), True)))
        further = next(blocks, None)
    met = found.groupBy("key").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = [(np.array([s["first"] for s in x], dtype=np.int64), np.array([s["last"] for s in x], dtype=np.int64) + 1) for x in pdf["spans"]]
            yield pdf.assign(spans=[[{"first": a, "last": b - 1} for a, b in merged(*e)] for e in ends])

    return met.mapInPandas(unite, met.schema).join(rows.select("key", "doc_id"), "key").select("doc_id", "n_words", "spans", "items")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ``find_items``'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean_rows(df: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``df`` without any hit, with all columns."""
    keyed = cut(df.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_key"), F.col(text).alias("_text")))
    hits = find_items(keyed, items, window, "_key", "_text", block_bytes=block_bytes).filter(F.size("spans") > 0)
    return keyed.join(hits.select(F.col("doc_id").alias("_key")), "_key", "left_anti").select("_row.*")
