"""N-gram Jaccard join by pigeonhole over a partitioned universe.

A document's set holds its distinct 5-word shingles (64-bit hashes; links are confirmed on the words).  Two sets with 100 |A & B| >= 80 |A | B| differ in
at most (|A| + |B|) / 9 shingles.  Sizes are cut into bands; for each band the universe of shingles is hashed into m
segments, and each segment gets an allowance t of 0 or 1: at t = 0 it is indexed by the subset of the set that falls into
it, at t = 1 also by that subset's one-deletion neighbourhood.  Sets that agree in no segment within its allowance
differ in at least the sum of t + 1, which the allocation puts above the largest possible difference; so similar sets
share a signature.  A pair belongs to the band of its larger set; a set signs its own band and, as the smaller one, the
next if a partner may be there.

Signatures of subsets without a rare shingle (rare: not among the shingles that very many documents share) find no one but
strangers.  The allocation therefore keeps ``slack`` segments to spare, and a set with no more weak segments than that
leaves them out; one of a pair suffices, for lost agreements are weak on both sides.  Sets with more sign weak subsets as
well, and empty ones only if they have more empty segments than slack.  Nothing is lost by it.

Which allocation a band gets, exact segments or fewer ones with neighbourhoods, is decided by estimated cost.

Equal sets are one class, so copies are never compared; what is linked are classes.  A group of up to ``SMALL_GROUP``
classes with a shared signature gives pairs, in a larger one each member is paired with the first.  Pairs whose sizes, or
whose counts of shingles by ``COUNTS`` classes, differ by too much go; the others are verified on the whole sets.  Of large
groups that these links have not connected, members are dealt over blocks of bounded size, and two blocks meet where a
signature has members in both that are still apart: a task compares two blocks and returns a spanning forest of their
links.  A group of n near copies so costs about n comparisons, and its pairs are never listed.

Defined cases: a null text counts as empty; a set without words is empty and linked with nothing; with fewer than five words
the whole sequence is the one shingle; rows that share a doc_id, or have none, are told apart by their texts, and any long is
a doc_id; a component without any doc_id has none; equal rows are in one component; a very long text is one set of 8 bytes a
shingle in the tasks that read it; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, components, cut, release, skewed_join, slices, text_or_empty, with_membership

WORDS = 5
PERCENT = 80
BAND_RATIO = 1.5
SMALL_GROUP = 8
BLOCK_DOCS, BLOCK_SHINGLES = 512, 400_000
#: Shingles that a batch of rows holds so often are reported; those with so many reports in all are common.
BATCH_REPEATS = 4
COMMON_LEAST, COMMON_MOST = 48, 1 << 20
#: Signatures that a task packs at once, and how many a bucket has on average, if they are many.
PACKED, BUCKET = 1 << 19, 1 << 19
#: Bits of a place: of the number of a set within its task.
PLACE_BITS = 36
#: Classes of shingles that are counted for every set, and bits of the bitmap of documents whose texts are wanted.
COUNTS, WANTED_BITS = 128, 1 << 26
#: Columns of a block's matrix of documents and shingles that are multiplied at once.
COLUMNS = 1024
#: Words of more bytes are hashed one by one.
LONG_WORD = 1024

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SEPARATORS = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2 ** 64, for hashes of substrings from prefix sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            steps = np.full(size, _BASE, dtype=U)
            back = np.full(size, pow(_BASE, -1, 1 << 64), dtype=U)
            steps[0] = back[0] = 1
            self.up, self.down = np.cumprod(steps, dtype=U), np.cumprod(back, dtype=U)
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of every word data[start:end], eight bytes at a time; ``data`` goes on for eight bytes after the last word.

    Every step mixes all bits before the next bytes come in, so no pattern of bytes cancels out.
    """
    left = ends - starts
    h = mixed(left.astype(U) ^ mixed(np.array([seed], dtype=U)))
    blocks = np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=data, strides=(1,))
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        word = data[starts[i] : ends[i]].tobytes()
        h[i] ^= U(int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little"))
    on = np.flatnonzero(left <= LONG_WORD)
    at, left = starts[on], left[on]
    while len(on):
        block = blocks[at]
        short = left < 8
        block[short] &= (U(1) << (left[short] * 8).astype(U)) - U(1)
        h[on] = mixed(h[on] ^ block)
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    return h


def shingle_sets(texts: list[str], salt: int = 0) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    return [s for part in _runs(texts) for s, _ in _shingle_sets(part, salt, False)]


def checked_sets(texts: list[str], salt: int = 0) -> list[tuple[np.ndarray, int]]:
    """The same with a number of the set that is made of other hashes of its words."""
    return [x for part in _runs(texts) for x in _shingle_sets(part, salt, True)]


def _runs(texts: list[str]) -> Iterator[list[bytes]]:
    """Texts with spaces as separators, half a megabyte at a time, or one longer text."""
    part, size = [], 0
    for t in texts:
        part.append(t.encode("utf-8").translate(_SEPARATORS))
        size += len(part[-1])
        if size >= 1 << 19:
            yield part
            part, size = [], 0
    if part:
        yield part


def _shingle_hashes(words: np.ndarray) -> np.ndarray:
    """The hash of the ``WORDS`` words from each one on."""
    n = max(0, len(words) - WORDS + 1)
    hashed = words[:n].copy()
    for k in range(1, WORDS):
        hashed = hashed * U(_BASE) + words[k : n + k]
    return mixed(hashed)


def _short_hash(words: np.ndarray) -> np.ndarray:
    """The hash of a whole sequence of fewer words, told from shingles by their number."""
    h = len(words)
    for w in words.tolist():
        h = (h * _BASE + w) & (2**64 - 1)
    return mixed(np.array([h], dtype=U))


def _shingle_sets(part: list[bytes], salt: int, check: bool) -> list[tuple[np.ndarray, int]]:
    data = np.frombuffer(b" ".join([b"", *part, b" " * 8]), dtype=np.uint8)
    space = data == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    edges = np.cumsum([1] + [len(p) + 1 for p in part])
    first = np.searchsorted(starts, edges)
    words = word_hashes(data, starts, ends, 2 * salt)
    hashed = _shingle_hashes(words)
    again = word_hashes(data, starts, ends, 2 * salt + 1) if check else words
    other = _shingle_hashes(again) if check else hashed
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        number = 0
        if b - a >= WORDS:
            values = hashed[a : b - WORDS + 1]
            if check:
                values, at = np.unique(values, return_index=True)
                number = int(np.bitwise_xor.reduce(other[a + at]))
            else:
                values = np.unique(values)
        elif b > a:
            values = _short_hash(words[a:b])
            number = int(_short_hash(again[a:b])[0])
        else:
            values = np.zeros(0, dtype=U)
        out.append((values, number))
    return out


def _numbered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs (x, y) of numbers."""
    return np.unique(x * (int(y.max()) + 1) + y, return_inverse=True)[1]


def texts_similar(x: str, y: str, percent: int) -> bool:
    """Whether the shingle sets of two texts are similar, by the words themselves: equal numbers stand for equal shingles."""
    words: dict[bytes, int] = defaultdict(count().__next__)
    two = [[words[w] for w in t.encode("utf-8").translate(_SEPARATORS).split()] for t in (x, y)]
    n, m = len(two[0]), len(two[1])
    if min(n, m) < WORDS:
        return two[0] == two[1] and n > 0
    single = np.array(two[0] + two[1], dtype=np.int64)
    pairs = _numbered(single[:-1], single[1:])
    fours = _numbered(pairs[:-2], pairs[2:])
    fives = _numbered(fours[:-1], single[4:])
    a, b = np.unique(fives[: n - WORDS + 1]), np.unique(fives[n:])
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and shared * 100 >= (len(a) + len(b) - shared) * percent


class Band(NamedTuple):
    number: int
    low: int
    high: int
    allowance: int  # t of every segment
    segments: int
    slack: int


def _tail(mean: float, most: int) -> float:
    """P(Poisson(mean) > most)."""
    term = total = math.exp(-mean)
    for i in range(1, most + 1):
        term *= mean / i
        total += term
    return max(0.0, 1.0 - total)


def allocate(number: int, low: int, high: int) -> Band:
    """The cheaper allocation of a band: signatures of a set, and those of sets that must sign weak segments too."""
    differ, best = 2 * high // 9, None  # (|A| + |B|) / 9 at most, for J >= 0.8
    size = (low + high) / 2
    for t in (0, 1):
        for spare in (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512, 1024):
            slack = spare * (t + 1)
            m = -(-(differ + 1 + slack) // (t + 1))
            each = low / m
            # Shingles per segment are about Poisson; a tenth is taken to be common.
            weak = m * math.exp(-0.9 * each) * (1 if t == 0 else 1 + 0.9 * each)
            signatures = m if t == 0 else m + size
            # Subsets (or neighbours) of one shingle meet strangers that share a passage.
            single = m * math.exp(-each) * (each if t == 0 else each * each)
            cost = signatures + 6 * single + _tail(min(weak, 600.0), slack // (t + 1)) * 200 * signatures
            if best is None or cost < best[0]:
                best = (cost, Band(number, low, high, t, m, m * (t + 1) - differ - 1))
            if spare > differ + 2:
                break
    return best[1]


def band_list(upto: int = 1 << 34) -> tuple[Band, ...]:
    """Bands of sizes from 4 (smaller sets are similar to equal ones only)."""
    out, low = [], 4
    while low < upto:
        high = max(low + 1, int(low * BAND_RATIO))
        out.append(allocate(len(out), low, high))
        low = high + 1
    return tuple(out)


def _contained(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def signatures(x: np.ndarray, common: np.ndarray, bands: tuple[Band, ...], lows: np.ndarray) -> np.ndarray:
    """The signatures of a set (sorted hashes), in its band and in the next if a larger partner may be there."""
    b = int(np.searchsorted(lows, len(x), side="right")) - 1
    if b < 0:
        return np.zeros(0, dtype=U)
    rare, out = ~_contained(common, x), []
    for band in bands[b : b + 2]:
        if band.number > b and len(x) * 5 // 4 < band.low:
            break
        out.append(_signed(x, rare, band))
    return np.concatenate(out)


def _signed(x: np.ndarray, rare: np.ndarray, band: Band) -> np.ndarray:
    m, t = band.segments, band.allowance
    segment = ((x >> U(32)) * U(m)) >> U(32)  # grows with x, so a segment is a slice
    begin = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
    size = np.diff(np.append(begin, len(x)))
    value = mixed(x ^ U(0x5851F42D4C957F2D))
    total, n_rare = np.add.reduceat(value, begin), np.add.reduceat(rare.astype(np.int64), begin)
    empty = m - len(begin)
    weak = (empty + int((n_rare <= t).sum())) * (t + 1)
    void = (empty + (int((size <= 1).sum()) if t else 0)) * (t + 1)
    place = segment[begin] + U(band.number << 40)
    every = weak > band.slack  # too few strong segments: sign the weak ones too
    keep = every | (n_rare > 0)
    out = [mixed((total * U(_BASE)) ^ mixed(place))[keep]]
    if t:
        of = np.repeat(np.arange(len(begin)), size)
        left, left_rare = total[of] - value, n_rare[of] - rare
        keep = (size[of] > 1) & (every | (left_rare > 0))
        out.append(mixed((left * U(_BASE)) ^ mixed(place[of]))[keep])
    if void > band.slack:  # empty subsets are signed by such sets alone
        bare = np.setdiff1d(np.arange(m, dtype=U), segment[begin] if not t else segment[begin][size > 1])
        out.append(mixed(mixed(bare + U(band.number << 40)) + U(1)))
    return np.concatenate(out)


def _documents(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, key and tag (two hashes of the row's id and text) and text."""
    return df.select(F.col(doc_id).cast("long").alias("doc"), *_keys(doc_id, text), text_or_empty(text).alias("text"))


def _keys(doc_id: str, text: str) -> list[Column]:
    row = [F.col(doc_id).isNull(), F.col(doc_id).cast("long"), text_or_empty(text)]
    return [F.xxhash64(*row).alias("key"), F.xxhash64(F.lit("tag"), *row).alias("tag")]


def _class_number(s: np.ndarray, salt: int) -> int:
    """The number of a set of shingles: two sets that share one are found out, and the work is done again with another salt."""
    return int(np.add.reduce(mixed(s ^ U(1 + 2 * salt))).astype(np.int64)) if len(s) else 0


def _profiles(docs: DataFrame, salt: int) -> DataFrame:
    """Two kinds of rows: of every document (doc, void, key, tag, n, cid, check, counts), and of repeated shingles (cid, times).

    cid is the number of the document's set, check one from other hashes of its words, and counts how many of its shingles fall into each
    of ``COUNTS`` classes: sets whose counts differ by more than similar sets may are not similar.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            repeated = [np.zeros(0, dtype=U)]
            for part in slices(pdf):
                checked = checked_sets(list(part["text"]), salt)
                sets = [s for s, _ in checked]
                yield pd.DataFrame(
                    {
                        "doc": part["doc"].to_numpy(),
                        "void": part["void"].to_numpy(),
                        "key": part["key"].to_numpy(),
                        "tag": part["tag"].to_numpy(),
                        "n": [len(s) for s in sets],
                        "cid": np.array([_class_number(s, salt) for s in sets], dtype=np.int64),
                        "check": np.array([c for _, c in checked], dtype=U).astype(np.int64),
                        "counts": [np.minimum(np.bincount((s % U(COUNTS)).astype(np.int64), minlength=COUNTS), 255).astype(np.uint8).tobytes() for s in sets],
                        "times": 0,
                    }
                )
                repeated += sets
            seen, times = np.unique(np.concatenate(repeated), return_counts=True)
            seen, times = seen[times >= BATCH_REPEATS], times[times >= BATCH_REPEATS]
            yield pd.DataFrame({"doc": 0, "void": True, "key": 0, "tag": 0, "n": -1, "cid": seen.astype(np.int64), "check": 0, "counts": b"", "times": times})

    rows = docs.select(F.coalesce("doc", F.lit(0)).alias("doc"), F.col("doc").isNull().alias("void"), "key", "tag", "text")
    return rows.mapInPandas(run, "doc long, void boolean, key long, tag long, n long, cid long, check long, counts binary, times long")


def packed(values: np.ndarray, places: np.ndarray) -> bytes:
    """Sorted numbers of up to 48 bits, and a place of up to 24 bits for each, in few bytes: the rows of a column byte by byte.

    Of numbers the differences are kept.  Their two low bytes and the low one of places are as good as random and stay; the rest is compressed.
    """
    step = np.diff(values, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    place = places.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return step[:2].tobytes() + place[:1].tobytes() + zlib.compress(step[2:6].tobytes() + place[1:3].tobytes(), 1)


def unpacked(data: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers and places that were packed."""
    low = np.frombuffer(data, dtype=np.uint8, count=3 * count).reshape(3, count)
    high = np.frombuffer(zlib.decompress(memoryview(data)[3 * count :]), dtype=np.uint8).reshape(6, count)
    step, place = np.zeros((count, 8), dtype=np.uint8), np.zeros((count, 4), dtype=np.uint8)
    step[:, :2], step[:, 2:6], place[:, 0], place[:, 1:3] = low[:2].T, high[:4].T, low[2], high[4:].T
    return np.cumsum(step.view("<u8").ravel(), dtype=U), place.view("<u4").ravel()


def _signature_rows(docs: DataFrame, classes: DataFrame, common: np.ndarray, salt: int, shingles: int) -> DataFrame:
    """Packed signatures (bucket, first, count, data), and rows that tell which sets the numbers stand for.

    A task numbers the sets that it meets, by its partition and their order there; rows of one partition must come in the same
    order if a lost task is run again, as those of files do.  ``data`` has the signatures of a bucket in order, as many bits of
    them as leave hardly any two alike by chance, and for each its set, counted from ``first``; a bucket is a range of
    signatures.  The rows without a bucket have the sets' cids, from ``first`` on.  A few bytes a signature are shuffled so,
    and tasks sort numbers instead of rows.  Of equal sets only the class's own document signs, and a few others that a bitmap
    lets through.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(common)
    bits = min(48, int(shingles).bit_length() + 10)
    buckets = max(1, min(64, shingles >> 12), shingles // BUCKET)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, seen, known = band_list(), set(), broadcast.value
        lows = np.array([b.low for b in bands])
        first, cids, sigs, held = TaskContext.get().partitionId() << PLACE_BITS, [], [], 0

        def rows() -> pd.DataFrame:
            value = np.concatenate(sigs)
            place = np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])
            order = np.argsort(value)
            value, place = value[order], place[order]
            bucket = (((value >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
            value >>= U(64 - bits)
            begin = np.flatnonzero(np.diff(bucket, prepend=-1))
            end = np.append(begin[1:], len(value))
            data = [packed(value[i:j], place[i:j]) for i, j in zip(begin.tolist(), end.tolist())]
            return pd.DataFrame(
                {
                    "bucket": np.append(bucket[begin], -1 - (first + (first >> PLACE_BITS)) % buckets),
                    "first": first,
                    "count": np.append(end - begin, len(cids)),
                    "data": [*data, np.array(cids, dtype="<i8").tobytes()],
                }
            )

        for pdf in batches:
            for part in slices(pdf):
                for s in shingle_sets(list(part["text"]), salt):
                    cid = _class_number(s, salt)
                    if cid not in seen:
                        seen.add(cid)
                        signed = np.unique(signatures(s, known, bands, lows))
                        if not len(signed):  # too small to be similar to any but equal ones
                            continue
                        cids.append(cid)
                        sigs.append(signed)
                        held += len(signed)
                        if held >= PACKED:
                            yield rows()
                            first, cids, sigs, held = first + len(cids), [], [], 0
        if cids:
            yield rows()

    own = with_membership(docs, F.col("key"), bitmap_of(classes, F.col("key"), WANTED_BITS), WANTED_BITS)
    return own.filter("_maybe").select("text").mapInPandas(run, "bucket long, first long, count long, data binary")


def _met(signed: DataFrame) -> DataFrame:
    """Sets with a common signature, by number: a, b, sig and size, both 0 for sets of a small group.

    In a large group each member b, the first one too, is with the first, a.  Rows of size -1 give the cid, b, of number a.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frame = lambda a, b, sig, size: pd.DataFrame({"a": a, "b": b, "sig": sig, "size": size}, dtype=np.int64)
        if pdf["bucket"].iat[0] < 0:
            numbers = [f + np.arange(n) for f, n in zip(pdf["first"], pdf["count"])]
            return frame(np.concatenate(numbers), np.frombuffer(b"".join(pdf["data"]), dtype="<i8"), 0, -1)
        parts = [unpacked(d, n) for d, n in zip(pdf["data"], pdf["count"])]
        value = np.concatenate([v for v, _ in parts])
        number = np.concatenate([f + p.astype(np.int64) for f, (_, p) in zip(pdf["first"], parts)])
        del parts
        order = np.lexsort((number, value))
        value, number = value[order], number[order]
        new = (np.diff(value, prepend=~value[:1]) != 0) | (np.diff(number, prepend=-1) != 0)
        value, number = value[new].astype(np.int64), number[new]
        begin = np.flatnonzero(np.diff(value, prepend=-1))
        size = np.diff(np.append(begin, len(value)))
        small, large = np.repeat((size > 1) & (size <= SMALL_GROUP), size), np.repeat(size > SMALL_GROUP, size)
        ends = [np.flatnonzero(small[k:] & (value[k:] == value[:-k])) for k in range(1, min(SMALL_GROUP, len(value)))]
        pairs = frame(np.concatenate([number[:0], *[number[i] for i in ends]]), np.concatenate([number[:0], *[number[i + k] for k, i in enumerate(ends, 1)]]), 0, 0)
        crowds = frame(np.repeat(number[begin], size)[large], number[large], value[large], np.repeat(size, size)[large])
        release()
        return pd.concat([pairs.drop_duplicates(), crowds])

    return signed.groupBy("bucket").applyInPandas(run, "a long, b long, sig long, size long").distinct()


def _texts(docs: DataFrame, wanted: DataFrame, salt: int) -> DataFrame:
    """cid and text, once each, of the sets in ``wanted`` (key of one document that has it), and perhaps of a few others."""
    marked = with_membership(docs, F.col("key"), bitmap_of(wanted, F.col("key"), WANTED_BITS), WANTED_BITS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for pdf in batches:
            for part in slices(pdf):
                cids = np.array([_class_number(s, salt) for s in shingle_sets(list(part["text"]), salt)], dtype=np.int64)
                new = [c not in seen and not seen.add(c) for c in cids.tolist()]
                yield pd.DataFrame({"cid": cids[new], "text": part["text"].to_numpy()[new]})

    # Sorted out by cid, so that joins by it need no further shuffle; a few more sets than wanted may be among them.
    return marked.filter("_maybe").select("text").mapInPandas(run, "cid long, text string").groupBy("cid").agg(F.first("text").alias("text"))


def _close(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose sizes and counts allow similarity."""
    one = classes.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("counts").alias("c_a"))
    two = classes.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("counts").alias("c_b"))
    both = skewed_join(pairs, one, "a", F.col("b")).join(two, "b")  # only ``a``, the first of a large group, has many pairs
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            release()
            x, y = (np.frombuffer(b"".join(pdf[c]), dtype=np.uint8).reshape(-1, COUNTS).astype(np.int64) for c in ("c_a", "c_b"))
            apart = np.abs(x - y).sum(axis=1)  # of all differing shingles, at least so many
            allowed = (pdf["n_a"] + pdf["n_b"]).to_numpy() * (100 - percent)
            yield pdf.loc[apart * (100 + percent) <= allowed, ["a", "b"]]

    return both.filter(fits).select("a", "b", "n_a", "n_b", "c_a", "c_b").mapInPandas(run, "a long, b long")


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, salt: int) -> DataFrame:
    """The pairs (a, b) that are similar, verified on the whole sets."""
    close = cut(_close(pairs, classes, percent))
    ends = close.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    texts = _texts(docs, ends.join(classes, "cid").select("key"), salt)
    left = skewed_join(close, texts.select(F.col("cid").alias("a"), F.col("text").alias("x")), "a", F.col("b"))
    both = left.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, "x"):
                x, y = (shingle_sets(list(part[c]), salt) for c in ("x", "y"))
                shared = np.array([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)], dtype=np.int64)
                union = np.array([len(s) + len(t) for s, t in zip(x, y)], dtype=np.int64) - shared
                passed = part[shared * 100 >= union * percent]
                yield passed.loc[[texts_similar(s, t, percent) for s, t in zip(passed["x"], passed["y"])], ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _forest(ids: np.ndarray, texts: list[str], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the same documents as all links among ``texts`` do, one less than documents for each component."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, of = np.concatenate(sets), np.repeat(np.arange(count, dtype=np.int32), sizes)
    order = np.argsort(values, kind="stable")
    values, of = values[order], of[order]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    often = np.repeat(np.diff(np.append(begin, len(values))), np.diff(np.append(begin, len(values))))
    del order
    shared = np.zeros(count * count, dtype=np.int32)
    few = 8
    for k in range(1, few):  # pairs of the holders of rarely held shingles
        same = (values[k:] == values[:-k]) & (often[k:] <= few)
        shared += np.bincount(of[:-k][same] * np.int64(count) + of[k:][same], minlength=count * count).astype(np.int32)
    shared = shared.reshape(count, count)
    shared += shared.T
    much = often > few
    column = np.cumsum(np.concatenate([[True], values[much][1:] != values[much][:-1]])) - 1 if much.any() else np.zeros(0, int)
    holder = of[much]
    del values, of, often, much
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [c, c + COLUMNS])
        held = np.zeros((count, COLUMNS), dtype=np.float32)
        held[holder[lo:hi], column[lo:hi] - c] = 1
        shared += np.rint(held @ held.T).astype(np.int32)

    def similar(i: int) -> np.ndarray:
        both = shared[i].astype(np.int64)
        return (both * 100 >= (sizes[i] + sizes - both) * percent) & (both > 0)

    open_, out = np.ones(count, dtype=bool), []
    for root in range(count):
        if open_[root]:
            open_[root], queue = False, [root]
            while queue:
                i = queue.pop()
                new = [j for j in np.flatnonzero(similar(i) & open_).tolist() if texts_similar(texts[i], texts[j], percent)]
                open_[new] = False
                queue += new
                out += [(int(ids[i]), int(ids[j])) for j in new]
    return out


def _crowd_links(crowds: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, salt: int) -> DataFrame:
    """Links a, b that connect what members (sig, cid, size, label) of large groups have in common, block by block.

    Members of one label are connected already.  Labels of many members fill blocks of their own, so that two such blocks
    need no meeting; the others share blocks by the largest group they are in.
    """
    member = crowds.groupBy("cid").agg(F.max_by("sig", F.struct("size", "sig")).alias("home"), F.min("label").alias("label"))
    member = cut(member.join(classes.select("cid", "n", "key"), "cid"))
    blocks = lambda: F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    many = member.groupBy("label").agg(F.count("*").alias("docs"), blocks().alias("parts")).filter(F.col("docs") >= BLOCK_DOCS // 2)
    labelled = cut(skewed_join(member, many.select("label", "parts"), "label", F.col("cid"), "left"))
    own = labelled.filter("parts IS NOT NULL").select("cid", "key", F.xxhash64("label", F.pmod(F.xxhash64("cid"), "parts"), F.lit(1)).alias("block"))
    rest = labelled.filter("parts IS NULL").drop("parts")
    parts = rest.groupBy("home").agg(blocks().alias("parts"))
    pooled = rest.join(parts, "home").select("cid", "key", F.xxhash64("home", F.pmod(F.xxhash64("cid"), "parts")).alias("block"))
    placed = cut(own.unionByName(pooled))
    of_sig = cut(crowds.join(placed, "cid").groupBy("sig", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi")))
    # The label that fills most blocks of a group: such blocks need not meet each other.
    uniform = of_sig.filter("lo = hi").groupBy("sig", F.col("lo").alias("main")).agg(F.count("*").alias("n"))
    main = uniform.groupBy("sig").agg(F.max_by("main", F.struct("n", "main")).alias("main"))
    known = of_sig.join(main, "sig", "left")
    odd = known.filter("main IS NULL OR lo <> main OR hi <> main").select("sig", F.col("block").alias("x"), "lo", "hi")
    other = known.select("sig", F.col("block").alias("y"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y"))
    differ = F.least("lo", "lo_y") < F.greatest("hi", "hi_y")
    meetings = odd.join(other, "sig").filter(differ).select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"))
    meetings = cut(meetings.distinct())
    texts = cut(_texts(docs, placed, salt).join(placed.select("cid", "block"), "cid"))
    left = meetings.join(texts.withColumnRenamed("block", "left"), "left")
    right = meetings.filter("left < right").join(texts.withColumnRenamed("block", "right"), "right").select(
        F.col("left").alias("l"), F.col("right").alias("r"), F.col("cid").alias("d"), F.col("text").alias("x")
    )

    def compare(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        ids = np.concatenate([a["cid"].to_numpy(), b["d"].to_numpy()]).astype(np.int64)
        texts = [*a["text"], *b["x"]]
        found = pd.DataFrame(_forest(ids, texts, shingle_sets(texts, salt), percent), columns=["a", "b"])
        release()
        return found

    pairs = left.select("left", "right", "cid", "text").groupBy("left", "right").cogroup(right.groupBy("l", "r"))
    return pairs.applyInPandas(compare, "a long, b long").distinct()


def _labelled(crowds: DataFrame, found: DataFrame) -> DataFrame:
    """The members (sig, cid, size, label) of those groups whose members are not all connected by now."""
    labels = crowds.join(found, crowds["cid"] == found["node"], "left").select("sig", "cid", "size", F.coalesce("component", "cid").alias("label"))
    labels = cut(labels)
    open_ = labels.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("sig", F.lit(1).alias("open"))
    return cut(labels.join(open_, "sig").drop("open"))


def _classes(docs: DataFrame, percent: int, salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows (doc, key, tag, n, cid) of all documents, and sets (cid, root) that have more than one row or a link."""
    if percent < 80:
        raise ValueError("the size bands hold for similarities of 80 percent and more")
    profiles = cut(_profiles(docs, salt))
    rows = profiles.filter("n >= 0").select(F.when(~F.col("void"), F.col("doc")).alias("doc"), "key", "tag", "n", "cid")
    reported = profiles.filter("n < 0").groupBy("cid").agg(F.sum("times").alias("times"))
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    least = max(COMMON_LEAST, shingles // COMMON_MOST)  # so there are no more than COMMON_MOST of them
    common = np.sort(np.array([r.cid for r in reported.filter(F.col("times") >= least).select("cid").collect()], dtype=np.int64).view(U))

    own = F.struct("n", "check")
    classes = cut(
        profiles.filter("n > 0").groupBy("cid").agg(
            F.min("n").alias("n"), F.min("key").alias("key"), F.first("counts").alias("counts"), F.count("*").alias("rows"),
            (F.min(own) != F.max(own)).alias("clash"),
        )
    )
    if not classes.filter("clash").isEmpty():  # about one chance in 10 million for a billion sets
        return _classes(docs, percent, salt + 1)

    met = cut(_met(_signature_rows(docs, classes, common, salt, shingles)))
    numbers = met.filter("size < 0").select("a", F.col("b").alias("cid"))
    # A member of a large group meets its first one; what that leaves apart is compared block by block.
    ends = cut(met.filter("size >= 0 AND a <> b").select("a", "b").distinct())
    one = skewed_join(ends, numbers, "a", F.col("b")).select(F.col("cid").alias("x"), "b")
    two = one.join(numbers.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("cid").alias("b"))
    pairs = cut(two.filter("a <> b").distinct())
    links = cut(_links(pairs, docs, classes, percent, salt))
    crowds = cut(met.filter("size > 0").select("sig", "size", F.col("b").alias("a")).join(numbers, "a").select("sig", "cid", "size").distinct())
    found = cut(components(links))
    apart = _labelled(crowds, found)
    if not apart.isEmpty():
        found = cut(components(links.unionByName(_crowd_links(apart, docs, classes, percent, salt))))
    joined = classes.join(found, classes["cid"] == found["node"], "left")
    several = joined.filter("component IS NOT NULL OR rows > 1").select("cid", F.coalesce("component", "cid").alias("root"))
    return rows, cut(several)


def similar_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``df``."""
    rows, several = _classes(_documents(df, doc_id, text), percent)
    named = cut(skewed_join(rows, several, "cid", F.col("key"), "left").select("doc", "key", "n", "root"))
    least = named.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc").alias("least"))
    done = skewed_join(named.filter("root IS NOT NULL"), least, "root", F.col("key"))
    columns = lambda c: [F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col(c).alias("component_id")]
    return done.select(*columns("least")).unionByName(named.filter("root IS NULL").select(*columns("doc")))


def drop_similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Of the rows of each component one, the smallest by (doc_id, text's hash), with all columns.

    Only rows that a bitmap of the keys of such components marks are shuffled.
    """
    rows, several = _classes(_documents(df, doc_id, text), percent)
    named = cut(skewed_join(rows, several, "cid", F.col("key")).select("doc", "key", "tag", "root"))
    bitmap = bitmap_of(named, F.col("key"), WANTED_BITS)
    winner = named.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("void"), "doc", "key", "tag")).alias("w")).select("w.key", "w.tag")
    known = named.select("key", "tag", F.lit(False).alias("wins")).unionByName(winner.select("key", "tag", F.lit(True).alias("wins")))
    known = known.groupBy("key", "tag").agg(F.max("wins").alias("wins"))
    marked = with_membership(df.select(F.struct("*").alias("_row"), *_keys(doc_id, text)), F.col("key"), bitmap, WANTED_BITS)
    met = marked.filter("_maybe").select("_row", "key", "tag").join(known, ["key", "tag"], "left")
    # Rows of equal id and text may differ elsewhere: the same one stays in every run.
    stays = met.filter("wins").groupBy("key", "tag").agg(F.min_by("_row", F.sha2(F.to_json("_row"), 256)).alias("_row")).select("_row")
    alone = met.filter("wins IS NULL").select("_row")
    return marked.filter("NOT _maybe").select("_row").unionByName(alone).unionByName(stays).select("_row.*")
