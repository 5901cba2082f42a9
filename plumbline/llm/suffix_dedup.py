"""Suffix-array dedup: every byte covered by a string of ``length`` bytes that starts anywhere else goes.

Strings are brought together by anchors.  The anchor of a string of ``length`` bytes is its gram of ``GRAM`` bytes with the
smallest hash, the leftmost of several; equal strings have equal anchors at equal places.  Neighbouring strings mostly share
their anchor, so a text becomes a row of contexts: the anchor and the bytes of all strings it stands for.

1. One scan counts contexts by anchor (64-bit hashes, aggregated before the shuffle).
2. Anchors met once are done: nothing in their contexts repeats.  A second scan keeps the contexts of the others (a
   bitmap of fixed size says which): all strings of a context that is met more than once repeat.  Both need no bytes.
3. Where contexts of an anchor differ, a third scan ships the bytes of each of them, of equal ones hardly more than
   once a task, so that a large group of copies meets in no task's memory.  Sorted once to the right
   and once to the left of their anchor, each has its longest match on either side next to it; what lies beyond both
   can't repeat and is cut off, and what is left is mostly nothing, or the same bytes as of another context.
4. Where variants remain, threshold-bounded interval expansion runs on blocks of them: their suffixes are sorted, and
   breadth-first backward extension on the Burrows-Wheeler transform derives the longest common prefixes by increasing
   value; it stops at ``length``.  Boundaries that are then still open lie between suffixes that share ``length`` bytes
   or more.
5. An anchor of more variants than a block holds is cut over blocks, and one of very many contexts is salted over tasks;
   the strings that repeat in no block of its own are then compared across its blocks by a 128-bit hash.

The repeated starts of a text become its removed runs; only texts that have any are shuffled to meet them.

Defined cases: a null text counts as empty and loses nothing; a null doc_id stays null; repeated rows repeat each other's
strings; a very long text is read in overlapping parts; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_array, bitmap_of, cut, text_or_empty, with_membership
from .jaccard_join import Powers, mixed

LENGTH = 200
GRAM = 50
CHUNK = 1 << 20
BLOCK = 160 << 10
#: Contexts that are resolved together, and intervals that are extended at once.
GROUP_ROWS, EXTEND = 8192, 8192
BITMAP = 1 << 26
#: Contexts of an anchor from which on it is salted; more for more data, so that there are few such anchors.
HOT_LEAST, HOT_MOST = 20_000, 1 << 16
#: Contexts a task remembers to have shipped.
SHIPPED = 1 << 16
U = np.uint64
#: Low bits of a gram's hash that make room for its place; what is read at once is shorter than 2 ** PLACE_BITS bytes.
PLACE_BITS = 24


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


class Contexts:
    """The contexts of a run of texts: text number, first start and length, anchor and context hashes, bytes.

    The texts may be parts of longer ones; ``places`` then holds the number of each part's text and where it starts there.
    """

    def __init__(
        self, parts: list[bytes], powers: Powers, length: int, places: list[tuple[int, int]] | None = None, place_bits: int = PLACE_BITS
    ):
        self.length, gram = length, min(GRAM, length)
        of, shift = np.array(places or [(i, 0) for i in range(len(parts))], dtype=np.int64).reshape(-1, 2).T
        self.data = b"".join(parts)
        assert len(self.data) < 1 << place_bits, "too much text at once: places of grams would run into their hashes"
        low = U((1 << place_bits) - 1)
        x = np.frombuffer(self.data, dtype=np.uint8)
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        ends = np.cumsum(sizes)
        self.begin = self.count = np.zeros(0, dtype=np.int64)
        self.key = self.context = np.zeros(0, dtype=U)
        self.text = self.first = self.offset = np.zeros(0, dtype=np.int64)
        if len(x) < length or not (sizes >= length).any():
            return
        up, down = powers.upto(len(x) + 1)
        self.sums = np.zeros(len(x) + 1, dtype=U)
        np.cumsum((x.astype(U) + U(1)) * up[: len(x)], out=self.sums[1:])
        self.down = down
        grams = mixed((self.sums[gram:] - self.sums[:-gram]) * down[: len(x) - gram + 1])
        placed = (grams & ~low) | np.arange(len(grams), dtype=U)
        least = (_sliding_least(placed, length - gram + 1) & low).astype(np.int64)
        end_of = np.repeat(ends, sizes)[: len(least)]
        inside = np.arange(len(least)) + length <= end_of
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1]
        self.begin = np.flatnonzero(new)
        stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        self.count = stop - self.begin + 1  # strings of the context
        anchor = least[self.begin]
        self.key, self.offset = grams[anchor], anchor - self.begin
        body = (self.sums[self.begin + self.count + length - 1] - self.sums[self.begin]) * down[self.begin]
        self.context = mixed(body ^ mixed((anchor - self.begin).astype(U) * U(1 << 32) + self.count.astype(U)))
        part = np.searchsorted(ends, self.begin, side="right")
        self.text = of[part]
        self.first = self.begin - (ends - sizes)[part] + shift[part]

    def body(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.begin[i] + self.count[i] + self.length - 1]


def _batches(texts: Iterable[str], length: int, chunk: int) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """UTF-8 bytes of texts, about ``chunk`` at a time, each with its text's number and where it starts there.

    Long texts come in parts that overlap by length - 1 bytes, so each string is in exactly one part.
    """
    parts, places, size = [], [], 0
    for i, text in enumerate(texts):
        t = text.encode("utf-8")
        for a in range(0, max(1, len(t) - length + 1), chunk):
            part = t[a : a + chunk + length - 1]
            if parts and size + len(part) > chunk:
                yield parts, places
                parts, places, size = [], [], 0
            parts.append(part)
            places.append((i, a))
            size += len(part)
    if parts:
        yield parts, places


def repeated_starts(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, whether the string of ``length`` bytes at each of its starts is anywhere else in the contexts."""
    text = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes + 1) - 1
    letters, symbols = np.unique(text, return_inverse=True)
    symbols = symbols.astype(np.int64) + 1
    symbols[ends] = 0  # the separator, below every letter
    n, sigma = len(text), len(letters) + 1
    order = _sorted_suffixes(symbols, length)
    bwt = symbols[order - 1]
    c = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
    closed = _expand(bwt, c, n, sigma, length)
    row = np.empty(n, dtype=np.int64)
    row[order] = np.arange(n)
    again = ~closed[row] | ~closed[row + 1]
    return [again[e - s : e - length + 1] for s, e in zip(sizes.tolist(), ends.tolist())]


def _sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first ``depth`` symbols or more, by doubling."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(8, dtype=np.int64)]).astype(np.int64)
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        key = key * 257 + padded[k : k + n]
    have = 7
    while True:
        order = np.argsort(key, kind="stable")
        if have >= depth:
            return order
        sorted_key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
        if rank[order[-1]] == n:
            return order
        key = rank * (n + 1)
        key[: n - have] += rank[have:]
        have *= 2


def _expand(bwt: np.ndarray, c: np.ndarray, n: int, sigma: int, length: int) -> np.ndarray:
    """Which boundaries between neighbouring suffixes have a common prefix below ``length``.

    Intervals of strings of one length are extended backwards by every symbol; the end of a new interval is a boundary
    whose common prefix is that length, unless it was closed at a smaller one; such an interval leads to nothing new.
    """
    closed = np.zeros(n + 1, dtype=bool)
    closed[0] = closed[n] = True
    rank = np.zeros((sigma, n + 1), dtype=np.int32)
    for s in range(sigma):
        np.cumsum(bwt == s, out=rank[s, 1:])
    back = c[bwt] + rank[bwt, np.arange(n)]  # the row of the suffix that is one symbol longer
    low, high = np.array([0]), np.array([n])
    for depth in range(length):
        single = high - low == 1
        one = back[low[single]]
        low, high = low[~single], high[~single]
        grown = [(one, one + 1)]
        for i in range(0, len(low), EXTEND):
            lows = (c[:sigma, None] + rank[:, low[i : i + EXTEND]]).ravel()
            highs = (c[:sigma, None] + rank[:, high[i : i + EXTEND]]).ravel()
            kept = lows < highs
            grown.append((lows[kept], highs[kept]))
        low, high = (np.concatenate(side) for side in zip(*grown))
        fresh = ~closed[high] if depth else np.ones(len(high), dtype=bool)
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        closed[high] = True
    return closed


def _rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = text_or_empty(text)
    return df.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("doc"), F.xxhash64(F.col(doc_id).isNull(), body).alias("th"),
        body.alias("text"), F.col(doc_id).isNull().alias("void"),
    )


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """key, n, same: the contexts of every anchor and whether they are all equal, of anchors met more than once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for pdf in batches:
            for parts, places in _batches(pdf["text"], length, CHUNK):
                c = Contexts(parts, powers, length, places)
                yield pd.DataFrame({"key": c.key.view(np.int64), "context": c.context.view(np.int64)})

    return (
        rows.select("text")
        .mapInPandas(run, "key long, context long")
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"))
        .filter("n > 1")
        .select("key", "n", (F.col("lo") == F.col("hi")).alias("same"))
    )


def _marked(rows: DataFrame, bitmap: np.ndarray, hot: dict[int, int], length: int) -> DataFrame:
    """The contexts whose anchor is in ``bitmap``; those of hot anchors get a salt from 1 on, equal contexts several."""
    shared = rows.sparkSession.sparkContext.broadcast((bitmap, hot))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, (bits, salts) = Powers(), shared.value
        for pdf in batches:
            for parts, places in _batches(pdf["text"], length, CHUNK):
                c = Contexts(parts, powers, length, places)
                hit = _hits(c, bits)
                keys, text, first = c.key[hit].view(np.int64), c.text[hit], c.first[hit]
                spread = zip(keys.tolist(), (text + first).tolist())
                out = {"doc": pdf["doc"].to_numpy()[text], "th": pdf["th"].to_numpy()[text], "first": first}
                out |= {"strings": c.count[hit], "key": keys, "context": c.context[hit].view(np.int64)}
                yield pd.DataFrame(out | {"salt": [1 + x % salts[k] if k in salts else 0 for k, x in spread]})

    return rows.mapInPandas(run, "doc long, th long, first long, strings long, key long, context long, salt int")


def _hits(c: Contexts, bits: np.ndarray) -> np.ndarray:
    # The bitmap's keys are signed, and so is the remainder there; both sides agree modulo a power of two.
    at = (c.key & U(len(bits) * 8 - 1)).astype(np.int64)
    return np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)


def _bodies(rows: DataFrame, bitmap: np.ndarray, hot: dict[int, int], length: int) -> DataFrame:
    """The contexts whose anchor is in ``bitmap`` with their bytes and n, how often they were met (from 2 on: at least).

    A task ships equal contexts until their n add up to 2 or more, and again only if it had to forget them; doc, th and
    first are those of one of them.  All of a context have one salt.
    """
    shared = rows.sparkSession.sparkContext.broadcast((bitmap, hot))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, (bits, salts), shipped = Powers(), shared.value, {}
        for pdf in batches:
            for parts, places in _batches(pdf["text"], length, CHUNK):
                c = Contexts(parts, powers, length, places)
                hit = _hits(c, bits)
                order = hit[np.lexsort((c.context[hit], c.key[hit]))]
                ids = np.stack([c.key[order], c.context[order]], axis=1).view(np.int64)
                begin = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])[: len(ids)])
                times, take, n = np.diff(np.append(begin, len(ids))).tolist(), [], []
                for i, one, many in zip(begin.tolist(), map(tuple, ids[begin].tolist()), times):
                    if (before := shipped.get(one, 0)) < 2:
                        take.append(i)
                        n.append(many)
                        shipped[one] = before + many
                if len(shipped) > SHIPPED:
                    shipped.clear()
                at, (keys, contexts) = order[take], ids[take].T
                out = {"doc": pdf["doc"].to_numpy()[c.text[at]], "th": pdf["th"].to_numpy()[c.text[at]], "first": c.first[at]}
                out |= {"key": keys, "context": contexts, "n": n}
                out["salt"] = [1 + x % salts[k] if k in salts else 0 for k, x in zip(keys.tolist(), contexts.tolist())]
                out["offset"], out["body"] = c.offset[at], [c.body(i) for i in at]
                yield pd.DataFrame(out)

    names = "doc long, th long, first long, key long, context long, n long, salt int, offset long, body binary"
    return rows.mapInPandas(run, names)


def _collapsed(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for equal contexts that stand next to each other, with the sum of their n."""
    ids = rows[["key", "salt", "context"]].to_numpy()
    new = np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])[: len(ids)]
    if new.all():
        return rows
    begin = np.flatnonzero(new)
    return rows.iloc[begin].assign(n=np.add.reduceat(rows["n"].to_numpy(), begin)).reset_index(drop=True)


def _matches(group: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """For each part the longest common prefix with any other part of its group."""
    width = max(1, max(map(len, parts)))
    padded = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), width)
    keyed = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), padded], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{width + 4}").ravel(), kind="stable")
    differ = keyed[order[1:]] != keyed[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width + 4) - 4  # below 0: another group
    most = np.zeros(len(parts), dtype=np.int64)
    most[order[1:]] = common
    most[order[:-1]] = np.maximum(most[order[:-1]], common)
    return np.minimum(np.maximum(most, 0), [len(p) for p in parts])


class _Variant:
    """Bytes that some contexts of an anchor have in common, and where they start in the texts that hold them."""

    __slots__ = ("body", "holders", "repeated")

    def __init__(self, body: bytes, repeated: bool):
        self.body, self.holders, self.repeated = body, [], repeated


def _resolve(rows: pd.DataFrame, spread: bool, length: int, block_size: int, powers: Powers) -> list[tuple]:
    """(doc, th, a, b, w1, w2) for the contexts of whole anchors, or (``spread``) of a part of one anchor.

    Each context has one row; those met more than once repeat as a whole, are marked elsewhere and only compared here.
    """
    out = []
    keys = rows[["key", "salt"]].to_numpy()
    new_group = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
    group = np.cumsum(new_group) - 1
    docs, ths, firsts, times, offsets = (rows[c].to_numpy() for c in ("doc", "th", "first", "n", "offset"))
    bodies = [bytes(x) for x in rows["body"]]
    left = right = None
    if not spread:
        right = _matches(group, [x[o:] for x, o in zip(bodies, offsets.tolist())])
        left = _matches(group, [x[:o][::-1] for x, o in zip(bodies, offsets.tolist())])
    groups: dict[int, dict[bytes, _Variant]] = {}
    for i, (g, n, body, o) in enumerate(zip(group.tolist(), times.tolist(), bodies, offsets.tolist())):
        whole = n > 1  # the same context more than once: all of it repeats
        shift = 0
        if not spread:
            if left[i] + right[i] < length:
                continue
            shift, body = o - left[i], body[o - left[i] : o + right[i]]
        variants = groups.setdefault(g, {})
        v = variants.get(body)
        if v is None:
            v = variants[body] = _Variant(body, whole)
        else:
            v.repeated = True
        if not whole:
            v.holders.append((docs[i], ths[i], firsts[i] + shift))
    block: list[_Variant] = []
    size = 0
    for variants in groups.values():
        pieces = list(variants.values())
        if not spread and all(v.repeated for v in pieces):
            out += _covered(pieces, None, length)
            continue
        total = sum(len(v.body) for v in pieces)
        if spread or total > 2 * block_size:
            piece, held = [], 0
            for v in pieces:
                piece.append(v)
                held += len(v.body)
                if held >= block_size:
                    out += _finish(piece, length, powers, True)
                    piece, held = [], 0
            out += _finish(piece, length, powers, True)
            continue
        block += pieces
        size += total
        if size >= block_size:
            out += _finish(block, length, powers, False)
            block, size = [], 0
    return out + _finish(block, length, powers, False)


def _covered(variants: list[_Variant], again: list[np.ndarray] | None, length: int) -> list[tuple]:
    out = []
    for i, v in enumerate(variants):
        if v.repeated:
            out += [(d, t, f, f + len(v.body), None, None) for d, t, f in v.holders]
        elif again is not None and again[i].any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], again[i].view(np.int8), [0]]))).tolist()
            out += [(d, t, f + a, f + b + length - 1, None, None) for d, t, f in v.holders for a, b in zip(edge[::2], edge[1::2])]
    return out


def _finish(variants: list[_Variant], length: int, powers: Powers, further: bool) -> list[tuple]:
    """Expansion of one block; ``further``: its strings are also compared with those of other blocks."""
    if not variants:
        return []
    again = repeated_starts([v.body for v in variants], length)
    out = _covered(variants, again, length)
    if further:
        for v, repeats in zip(variants, again):
            w1, w2 = _string_hashes(v.body, length, powers)
            for i, (x, y) in enumerate(zip(w1, w2)):
                if v.repeated or repeats[i]:
                    out.append((None, None, None, None, x, y))
                else:
                    out += [(d, t, f + i, f + i + length, x, y) for d, t, f in v.holders]
    return out


def _whole_numbers(values: list) -> pd.arrays.IntegerArray:
    """64-bit numbers and nulls, never by way of floats."""
    missing = np.array([v is None for v in values], dtype=bool)
    return pd.arrays.IntegerArray(np.array([0 if v is None else int(v) for v in values], dtype=np.int64), missing)


def _expanded(contexts: DataFrame, length: int, block_size: int) -> DataFrame:
    """a, b: the bytes that repeated strings cover, by doc and th; and rows with w1, w2 of strings to compare further.

    The latter come from anchors cut over blocks: their strings met once in the block, and those met more often (without
    doc).
    """
    names = ["doc", "th", "a", "b", "w1", "w2"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, held, part_of = Powers(), [], None

        def resolved(rows: pd.DataFrame, spread: bool) -> pd.DataFrame:
            found = _resolve(rows, spread, length, block_size, powers) if len(rows) else []
            return pd.DataFrame({n: _whole_numbers([r[i] for r in found]) for i, n in enumerate(names)})

        def in_parts(rows: pd.DataFrame) -> pd.Series:
            salted = rows["salt"] > 0
            return salted | ((rows["key"] == part_of[0]) & (rows["salt"] == part_of[1])) if part_of else salted

        for pdf in batches:
            for i in range(0, len(pdf), GROUP_ROWS):
                held.append(pdf.iloc[i : i + GROUP_ROWS])
                rows = _collapsed(pd.concat(held, ignore_index=True))
                held = [rows]
                if len(rows) < GROUP_ROWS:
                    continue
                last = tuple(rows[["key", "salt"]].iloc[-1])
                whole = (rows["key"] != last[0]) | (rows["salt"] != last[1])
                salted = in_parts(rows)
                yield resolved(rows[whole & ~salted], False)
                yield resolved(rows[whole & salted], True)
                rest = rows[~whole]
                held = [rest]
                if len(rest) >= 4 * GROUP_ROWS:  # an anchor that is too much at once
                    edge = rest["context"] != rest["context"].iloc[-1]
                    yield resolved(rest[edge], True)
                    held, part_of = [rest[~edge]], last
        if held:
            rows = _collapsed(pd.concat(held, ignore_index=True))
            salted = in_parts(rows)
            yield resolved(rows[~salted], False)
            yield resolved(rows[salted], True)

    ordered = contexts.repartition("key", "salt").sortWithinPartitions("key", "salt", "context")
    return ordered.mapInPandas(run, "doc long, th long, a long, b long, w1 long, w2 long")


def _string_hashes(body: bytes, length: int, powers: Powers) -> tuple[list[int], list[int]]:
    """Two 64-bit hashes of every string of ``length`` bytes."""
    x = np.frombuffer(body, dtype=np.uint8).astype(U)
    up, down = powers.upto(len(x) + 1)
    out = []
    for values in (x + U(1), mixed(x + U(77))):
        sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(values * up[: len(x)], dtype=U)])
        out.append(mixed((sums[length:] - sums[:-length]) * down[: len(x) - length + 1]).view(np.int64).tolist())
    return out[0], out[1]


def repeated_ranges(rows: DataFrame, length: int = LENGTH, block_size: int = BLOCK) -> DataFrame:
    """doc, th, a, b: the byte ranges of texts that repeated strings cover (they may overlap)."""
    anchors = cut(_counted(rows, length))
    total = anchors.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_LEAST, total // HOT_MOST)
    hot = {r.key: r.n // least + 1 for r in anchors.filter(F.col("n") > least).collect()}
    marked = cut(_marked(rows, bitmap_array(anchors, F.col("key"), BITMAP), hot, length))
    repeated = marked.groupBy("key", "context").agg(F.count("*").alias("n")).filter("n > 1").select("key", "context")
    # Contexts of a hot anchor meet their row in several tasks.
    salts = rows.sparkSession.createDataFrame([(k, n) for k, n in hot.items()], "key long, salts long")
    repeated = repeated.join(F.broadcast(salts), "key", "left").select(
        "key", "context", F.explode(F.expr("if(salts IS NULL, array(0), sequence(1, int(salts)))")).alias("salt")
    )
    end = (F.col("first") + F.col("strings") + length - 1).alias("b")
    whole = marked.join(repeated, ["key", "context", "salt"]).select("doc", "th", F.col("first").alias("a"), end)
    mixed_ = bitmap_array(anchors.filter("NOT same").select("key"), F.col("key"), BITMAP)
    found = cut(_expanded(_bodies(rows, mixed_, hot, length), length, block_size))
    across = found.filter("w1 IS NOT NULL")
    several = across.groupBy("w1", "w2").count().filter("count > 1").select("w1", "w2")
    met = across.filter("doc IS NOT NULL").join(several, ["w1", "w2"], "left_semi")
    columns = ["doc", "th", "a", "b"]
    return whole.unionByName(found.filter("w1 IS NULL").select(*columns)).unionByName(met.select(*columns))


def _cut_text(text: str, ranges: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]], bytes]:
    """Bytes of the text, its maximal removed runs, and what is left."""
    data, runs = text.encode("utf-8"), []
    for a, b in sorted(ranges):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    edges = [0, *(e for r in runs for e in r), len(data)]
    return len(data), runs, b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left), or kept_sha256, of every row of ``df``."""
    rows = _rows(df, doc_id, text)
    ranges = cut(repeated_ranges(rows, length).distinct())
    flagged = with_membership(rows, F.xxhash64("doc", "th"), bitmap_of(ranges, F.xxhash64("doc", "th")))
    lists = ranges.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    last = "kept_sha256 string" if digest else "kept binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, void, t, found in zip(pdf["doc"], pdf["void"], pdf["text"], pdf["ranges"]):
                n, runs, kept = _cut_text(t, [] if found is None else [(r["a"], r["b"]) for r in found])
                out.append((doc, void, n, sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept).hexdigest() if digest else kept))
            yield pd.DataFrame(out, columns=["doc", "void", "n_bytes", "n_removed", "n_spans", last.split()[0]])

    untouched = flagged.filter("NOT _maybe").select("doc", "void", "text", F.lit(None).cast(lists.schema["ranges"].dataType).alias("ranges"))
    touched = flagged.filter("_maybe").join(lists, ["doc", "th"], "left").select("doc", "void", "text", "ranges")
    done = [x.mapInPandas(run, f"doc long, void boolean, n_bytes long, n_removed long, n_spans long, {last}") for x in (untouched, touched)]
    real: Column = F.when(~F.col("void"), F.col("doc"))
    return done[0].unionByName(done[1]).select(real.alias("doc_id"), "n_bytes", "n_removed", "n_spans", last.split()[0])
