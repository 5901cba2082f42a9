"""Spelling variant grouping: pairs of words one edit apart by merging errata tries.

Words of a group stand in a trie.  At every node its heavy child, the one with most words, stays where it is; the light
subtrees are merged into it with the branching character replaced (words of equal length) or skipped (one word is longer).
Merging walks both tries at once and so costs no more than the smaller one; a word lies in a light subtree at most log2 times
on its path.  Where two ends coincide, the two words are one edit apart: the place of the edit is where they part, so each
pair is met once, at one node.

Groups: two words one edit apart have lengths a and a or a + 1 and part at some place of an interval, at first 0 to a.  A
group with more than ``GROUP_WORDS`` words is cut at the middle of its interval: words that part in the first half agree in
all that follows, those that part in the second in all that precedes, so the halves are grouped by that too.  It ends, at the
latest, at intervals of one place, where a group has no more words than there are letters, or pairs of them.  So every pair
stays within a group of bounded size, and no group of all words exists.

Defined cases: a null text has no words; a word that occurs in several rows counts with all its occurrences; of near words with
equal counts the smallest in code-point order is the form; repeated rows count again; an empty table gives an empty result;
other columns are not looked at; of a very long text only its words go on, one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

LEAST_CHARS, LEAST_TIMES, FACTOR = 6, 5, 5
GROUP_WORDS = 20_000
HOT_GROUPS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "([a-zÀ-ÿ]+)"
END = ""  # the key of a node's word


def word_counts(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_one_in: int = 0, least_chars: int = LEAST_CHARS, least_times: int = LEAST_TIMES,
) -> DataFrame:
    """word, n of the words of at least ``least_chars`` letters that occur ``least_times`` times.

    ``drop_one_in`` > 0 deletes a letter, chosen by a hash of the row's id and the word, of about one word in so many.
    """
    runs = F.regexp_extract_all(F.translate(text_or_empty(text), _UPPER, _LOWER), F.lit(RUN), 1)
    words = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("word"))
    words = words.filter(F.length("word") >= least_chars)
    if drop_one_in:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = F.pmod(h, F.length("word")).cast("int")
        shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = words.select(F.when(h % drop_one_in == 0, shorter).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_times)


def trie_of(words: list[tuple[str, int]]) -> dict:
    """A node is a dict from a character to a child; ``END`` leads to the number of the word that ends there."""
    root: dict = {}
    for middle, i in words:
        node = root
        for c in middle:
            nxt = node.get(c)
            if nxt is None:
                nxt = node[c] = {}
            node = nxt
        node[END] = i
    return root


def coinciding(a: dict, b: dict) -> Iterator[tuple[int, int]]:
    """The words (of a, of b) that end at the same place below both nodes."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if len(b) < len(a):
            for c in b:
                if c in a:
                    if c == END:
                        yield a[c], b[c]
                    else:
                        stack.append((a[c], b[c]))
        else:
            for c in a:
                if c in b:
                    if c == END:
                        yield a[c], b[c]
                    else:
                        stack.append((a[c], b[c]))


def merged_into(light: dict, overlay: dict) -> Iterator[tuple[int, int]]:
    """Merges a light subtree into an overlay, whose ends hold lists of words; (old, new) words that coincide."""
    stack = [(light, overlay)]
    while stack:
        a, o = stack.pop()
        for c, below in a.items():
            if c == END:
                held = o.setdefault(END, [])
                for i in held:
                    yield i, below
                held.append(below)
            else:
                stack.append((below, o.setdefault(c, {})))


def one_edit_pairs(words: list[tuple[str, int]], a: int, open_end: bool) -> Iterator[tuple[int, int]]:
    """Pairs (numbers) of ``words`` (middle, number), of length a or a + 1, that part before place a and are one edit apart.

    ``open_end``: a word that only lacks the other's last character counts too.  Both of length a + 1 are no pair of this group.
    """
    root = trie_of(words)
    size: dict[int, int] = {}
    order, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        order.append((node, depth))
        stack += [(below, depth + 1) for c, below in node.items() if c != END]
    for node, _ in reversed(order):
        size[id(node)] = sum(1 if c == END else size[id(below)] for c, below in node.items())
    of_a = {i: len(w) == a for w, i in words}
    for node, depth in order:
        if depth == a and open_end and END in node:  # the longer word ends with one character more
            yield from ((node[END], below[END]) for c, below in node.items() if c != END and END in below)
        if depth >= a:
            continue
        children = sorted(((c, below) for c, below in node.items() if c != END), key=lambda x: size[id(x[1])])
        _, heavy = children.pop()
        overlay: dict = {}
        for c, light in children:
            # Replaced: the light subtree meets the heavy one and the light ones before it.
            yield from ((i, j) for i, j in coinciding(light, heavy) if of_a[i])
            if len(children) > 1:
                yield from ((i, j) for i, j in merged_into(light, overlay) if of_a[i])
            # Skipped in a light subtree: what follows c meets what follows this node.
            for d, below in light.items():
                if d != END and d != c and d in node:
                    yield from coinciding(below, node[d])
            # Skipped in the heavy subtree: what follows its character and c meets the light subtree.
            if c in heavy:
                yield from coinciding(heavy[c], light)


def _groups(words: DataFrame, group_words: int) -> DataFrame:
    """a, head, tail, word, n: the words in groups within which all pairs lie."""
    row = lambda a: F.struct(a.cast("int").alias("a"), F.lit("").alias("head"), F.lit("").alias("tail"))
    size = F.length("word")
    rows = words.select(F.explode(F.array(row(size), row(size - 1))).alias("g"), "word", "n").select("g.*", "word", "n")
    open_, done = cut(rows), None
    while True:
        counts = open_.groupBy("a", "head", "tail").agg(F.count("*").alias("rows"))
        wide = F.col("a") - F.length("head") - F.length("tail") > 1
        hot = cut(counts.filter((F.col("rows") > group_words) & wide).select("a", "head", "tail", F.lit(True).alias("hot")))
        n_hot = hot.count()
        # One row a group of over group_words rows; beyond the bound both sides are shuffled.
        marked = open_.join(F.broadcast(hot) if n_hot <= HOT_GROUPS else hot, ["a", "head", "tail"], "left")
        ready = marked.filter("hot IS NULL").drop("hot") if n_hot else open_
        done = ready if done is None else done.unionByName(ready)
        if not n_hot:
            return done
        low, high = F.length("head"), F.col("a") - F.length("tail")
        mid = (low + F.floor((high - low) / 2)).cast("int")
        first = F.struct("a", F.col("head"), F.substring("word", F.length("word") - (F.col("a") - mid) + 1, F.col("a") - mid).alias("tail"))
        second = F.struct("a", F.substring("word", F.lit(1), mid).alias("head"), F.col("tail"))
        open_ = cut(marked.filter("hot").select(F.explode(F.array(first, second)).alias("g"), "word", "n").select("g.*", "word", "n"))


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, n_near, near, near_n: of the words (word, n; distinct) those with near words, and the most frequent of these."""

    def solved(a: int, head: int, tail: int, texts: list[str], times: list[int]) -> list[tuple[str, int, str, int]]:
        middles = [(w[head : len(w) - tail], i) for i, w in enumerate(texts)]
        met: dict[int, list] = {}
        for i, j in one_edit_pairs(middles, a - head - tail, not tail):
            for x, y in ((i, j), (j, i)):
                best = met.setdefault(x, [0, y])
                best[0] += 1
                if (-times[y], texts[y]) < (-times[best[1]], texts[best[1]]):
                    best[1] = y
        return [(texts[x], k, texts[y], times[y]) for x, (k, y) in met.items()]

    def made(pdf: pd.DataFrame, begin: list[int]) -> pd.DataFrame:
        a, head, tail, texts, times = (pdf[c].tolist() for c in ("a", "head", "tail", "word", "n"))
        out = []
        for x, y in zip(begin, begin[1:]):
            if y - x > 1:
                out += solved(a[x], len(head[x]), len(tail[x]), texts[x:y], times[x:y])
        return pd.DataFrame(out, columns=["word", "n_near", "near", "near_n"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            rest = pdf.iloc[new[-1] :] if new else None  # the last group may go on in the next batch
            yield made(pdf, new)
        if rest is not None:
            yield made(rest, [0, len(rest)])

    keys = ["a", "head", "tail"]
    groups = _groups(words, group_words).repartition(*keys).sortWithinPartitions(*keys)
    found = groups.mapInPandas(run, "word string, n_near long, near string, near_n long")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min_by("near", F.struct(-F.col("near_n"), F.col("near"))).alias("near"), F.max("near_n").alias("near_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form), by doubling the steps; forms have no cycle, for each is more frequent than its word."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        after = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = cut(now.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(words: DataFrame, factor: int = FACTOR, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every row of ``words`` (word, n)."""
    words = cut(words)
    near = words.join(near_words(words, group_words), "word", "left")
    fits = F.col("near_n") >= factor * F.col("n")
    named = cut(
        near.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"),
            F.when(fits, F.col("near_n")).alias("form_n"),
        )
    )
    rooted = named.join(roots(named.filter("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
