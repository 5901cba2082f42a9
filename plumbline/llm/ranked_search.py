"""Ranked lexical search: MaxScore over an inverted index in shards.

``build`` writes the index of a table once: every task deals its documents over shards of about ``SHARD_CHARS`` characters and
writes one row per shard (ids and lengths) and one row per shard and term (places and counts).  Documents of a shard are
numbered in the order of their ids.  Nothing is shuffled, and a frequent term is a short list in each shard.

``search`` takes the queries in blocks of at most about ``BLOCK_TERMS`` terms, which are counted first.  The lists of a block's
terms meet their shard; there every query is run by MaxScore: its lists are ordered by their upper bounds (the largest score
in the list), and those whose bounds together can't lift a document over the k-th best score so far are non-essential.  Only
the other lists propose documents, range of documents by range; non-essential lists are probed from the highest bound down,
and only for documents that can still qualify.  The shards' best lists are merged per query.

The score of a document with tf occurrences of a term of weight w = floor(1000 ln((2 N + 2) / (2 df + 1))) is the sum of
w (10^9 tf div (1000 tf + 8 m)) with m = 25 + (75 n N) div L, repeats of a query's term included.

Defined cases: a null or empty text has no terms and is no result; a null or empty query has no results; queries are told
apart by their rows, not their ids; equal scores go to the smaller doc_id, a null one last; of repeated rows each is a result;
an empty table gives an empty result; other columns are not looked at; a very long text is read a megabyte at a time and is
one document of one shard.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, text_or_empty

K = 10
SHARD_CHARS, SHARD_DOCS = 16 << 20, 1 << 16
BLOCK_TERMS = 50_000
#: Documents whose scores are summed together: few at first, so that a threshold is there early.
FIRST_RANGE, RANGE = 256, 2048

TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_ROW = "shard long, term string, rows long, total long, a binary, b binary, ids array<string>"


class Index(NamedTuple):
    """shards: shard, rows (documents with terms), total (terms), a (lengths, int64), ids.
    postings: shard, term, rows (documents), total, a (places, uint16), b (counts, one byte or four each)."""

    shards: DataFrame
    postings: DataFrame
    doc_type: str


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(TERM), 1)


def _words(text: str, size: int = 1 << 20) -> Iterator[list[bytes]]:
    data, at = text.encode("utf-8").translate(_TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + size)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class _Shard:
    def __init__(self, ordered):
        self.ordered, self.chars = ordered, 0
        self.vocabulary: dict[bytes, int] = defaultdict(count().__next__)
        self.ids, self.lengths, self.found, self.times = [], [], [], []

    def add(self, pdf: pd.DataFrame) -> None:
        number = self.vocabulary.__getitem__
        for i, text in zip(pdf["doc_id"], pdf["text"]):
            held = [np.fromiter(map(number, w), np.int32, len(w)) for w in _words(text)]
            found, times = np.unique(np.concatenate([np.zeros(0, np.int32), *held]), return_counts=True)
            self.ids.append(i)
            self.lengths.append(int(times.sum()))
            self.found.append(found)
            self.times.append(times.astype(np.int32))
            self.chars += len(text)

    def rows(self, shard: int) -> Iterator[pd.DataFrame]:
        order = sorted(range(len(self.ids)), key=lambda i: self.ordered(self.ids[i]))
        n = np.array([self.lengths[i] for i in order], dtype=np.int64)
        yield _frame(shard, [None], [int((n > 0).sum())], [int(n.sum())], [n.tobytes()], [b""], [[self.ids[i] for i in order]])
        sizes = [len(self.found[i]) for i in order]
        term = np.concatenate([np.zeros(0, np.int32), *[self.found[i] for i in order]])
        times = np.concatenate([np.zeros(0, np.int32), *[self.times[i] for i in order]])
        place = np.repeat(np.arange(len(order), dtype=np.uint16), sizes)
        by_term = np.argsort(term, kind="stable")
        term, times, place = term[by_term], times[by_term], place[by_term]
        names = list(self.vocabulary)
        begin = np.searchsorted(term, np.arange(len(names) + 1))
        for first in range(0, len(names), 20_000):
            part = range(first, min(first + 20_000, len(names)))
            spans = [slice(int(begin[t]), int(begin[t + 1])) for t in part]
            held = [times[s] for s in spans]
            yield _frame(
                shard, [names[t].decode("utf-8") for t in part], [len(h) for h in held], [int(h.sum()) for h in held], [place[s].tobytes() for s in spans],
                [(h.astype(np.uint8) if h.max() < 256 else h).tobytes() for h in held], [None] * len(spans),
            )


def _frame(shard: int, term: list, rows: list, total: list, a: list, b: list, ids: list) -> pd.DataFrame:
    return pd.DataFrame({"shard": shard, "term": term, "rows": rows, "total": total, "a": a, "b": b, "ids": ids})


def build(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_chars: int = SHARD_CHARS) -> Index:
    """The index of all rows of ``df``, written to the shared folder."""
    kind = df.schema[doc_id].dataType.simpleString()
    number = kind in ("tinyint", "smallint", "int", "bigint")

    def ordered(x):
        return (x is None, (int(x) if number else x) if x is not None else 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, next_ = _Shard(ordered), TaskContext.get().partitionId() << 32
        for pdf in batches:
            for part in slices(pdf, size=min(1 << 20, shard_chars)):
                if len(shard.ids) + len(part) > SHARD_DOCS or shard.chars >= shard_chars:
                    yield from shard.rows(next_)
                    shard, next_ = _Shard(ordered), next_ + 1
                shard.add(part)
        if shard.ids:
            yield from shard.rows(next_)

    table = cut(df.select(F.col(doc_id).cast("string").alias("doc_id"), text_or_empty(text).alias("text")).mapInPandas(run, _ROW))
    return Index(table.filter("term IS NULL"), table.filter("term IS NOT NULL"), kind)


class _List(NamedTuple):
    places: np.ndarray
    gains: np.ndarray  # score of a weight of 1


class ShardSearch:
    """The lists of a shard, for all queries of a block."""

    def __init__(self, pdf: pd.DataFrame, n_docs: int, n_terms: int):
        head = pdf[pdf["term"].isna()].iloc[0]
        n = np.frombuffer(head["a"], dtype=np.int64)
        if 75 * int(n.max(initial=0)) * n_docs >= 1 << 63:  # beyond 64 bits in numpy
            n = n.astype(object)
        m = (25 + (75 * n * n_docs) // max(n_terms, 1)).astype(np.int64)
        self.ids, self.lists = head["ids"], {}
        for r in pdf[pdf["term"].notna()].itertuples():
            places = np.frombuffer(r.a, dtype=np.uint16).astype(np.int64)
            times = np.frombuffer(r.b, dtype=np.uint8 if len(r.b) == len(places) else np.int32).astype(np.int64)
            self.lists[r.term] = _List(places, (1_000_000_000 * times) // (1000 * times + 8 * m[places]))

    def top(self, query: list[tuple[str, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents of a query (term, weight), best first."""
        held = [(self.lists[t], w) for t, w in query if w > 0 and t in self.lists]
        held.sort(key=lambda x: int(x[0].gains.max()) * x[1])
        upto = np.cumsum([int(x.gains.max()) * w for x, w in held], dtype=np.int64)
        best, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        begin, size = 0, FIRST_RANGE
        while begin < len(self.ids):
            end = min(begin + size, len(self.ids))
            essential = int(np.searchsorted(upto, least, side="right"))
            if essential == len(held):  # later documents lose against equal scores
                break
            sums = np.zeros(end - begin, dtype=np.int64)
            for x, w in held[essential:]:
                lo, hi = np.searchsorted(x.places, (begin, end))
                sums[x.places[lo:hi] - begin] += x.gains[lo:hi] * w
            found = np.flatnonzero(sums)
            sums, found = sums[found], found + begin
            for i in range(essential - 1, -1, -1):
                may = sums + upto[i] > least
                sums, found = sums[may], found[may]
                if not len(found):
                    break
                x, w = held[i]
                at = np.minimum(np.searchsorted(x.places, found), len(x.places) - 1)
                hit = x.places[at] == found
                sums[hit] += x.gains[at[hit]] * w
            over = sums > least
            best, score = np.concatenate([best, found[over]]), np.concatenate([score, sums[over]])
            order = np.lexsort((best, -score))[:k]
            best, score = best[order], score[order]
            least = int(score[-1]) if len(score) == k else 0
            begin, size = end, RANGE
        return best, score


def _blocks(queries: DataFrame, block_terms: int) -> Iterator[DataFrame]:
    """``queries`` (q, term, repeats) in parts of about ``block_terms`` rows, whole queries each."""
    rows = queries.count()
    parts = 1 if rows <= block_terms else -(-2 * rows // block_terms)
    for p in range(parts):
        yield queries.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == p) if parts > 1 else queries


def _block_best(index: Index, queries: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """q, id, score: the k best of every shard for the queries of a block."""
    wanted = index.postings.join(queries.select("term").distinct(), "term", "left_semi")
    known = wanted.groupBy("term").agg(F.sum("rows").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))) * F.col("repeats")
    plan: dict[int, list[tuple[str, int]]] = {}
    for r in queries.join(known, "term").select("q", "term", weight.cast("long").alias("weight")).collect():
        plan.setdefault(r["q"], []).append((r["term"], r["weight"]))
    shared = index.postings.sparkSession.sparkContext.broadcast(plan)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        shard, out = ShardSearch(pdf, n_docs, n_terms), []
        for q, query in shared.value.items():
            best, score = shard.top(query, k)
            out += [(q, shard.ids[b], s) for b, s in zip(best.tolist(), score.tolist())]
        return pd.DataFrame(out, columns=["q", "id", "score"])

    columns = ["shard", "term", "a", "b", "ids"]
    lists = index.shards.select(*columns).unionByName(wanted.select(*columns))
    return lists.groupBy("shard").applyInPandas(run, "q long, id string, score long")


def search(
    index: Index, items: DataFrame, k: int = K, item_id: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every row of ``items``, scores above 0."""
    asked = cut(items.select(F.monotonically_increasing_id().alias("q"), F.col(item_id).alias("item_id"), terms(text_or_empty(text)).alias("terms")))
    queries = cut(asked.select("q", F.explode("terms").alias("term")).groupBy("q", "term").agg(F.count("*").alias("repeats")))
    totals = index.shards.agg(F.sum("rows"), F.sum("total")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    best = None
    for block in _blocks(queries, block_terms):
        found = _block_best(index, block, n_docs, n_terms, k)
        best = found if best is None else best.unionByName(found)
    typed = best.select("q", F.col("id").cast(index.doc_type).alias("doc_id"), "score")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = typed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
