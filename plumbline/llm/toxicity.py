"""Toxicity through noisy-channel deobfuscation.

A text's suspicious stretches (digits and symbols standing for letters, letters set apart by separators, letters repeated)
are read as character lattices: each character offers the letters it may stand for, and separators and repetitions may
be dropped, at a channel cost.  The Viterbi path of a lattice under a character language model restores the text; a
stretch whose lattice has one path is left as it is.  The language model interpolates the 1- to 4-gram counts of the
characters of all texts (a table with a fixed bound, ``SYMBOLS ** ORDER`` cells).

The restored text is scored by a logistic regression on the abusive stems (beginnings of words) in it and on their
density.  Both are learned on a bounded sample of labelled rows (``TRAIN_ROWS`` of either label, those with the smallest
hash of doc_id): stems are added one by one, each explaining the most toxic rows that those before leave unexplained.

Defined cases: a null text counts as empty; a text without an abusive stem, an empty one too, has the regression's score
for none; without any toxic labelled row the score is 0; equal texts have equal scores; an empty table gives an empty
result; other columns are not looked at.  A very long text is read whole; its stretches are decoded in windows.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, slices, text_or_empty

TRAIN_ROWS = 1500
STEM_LENGTHS = range(4, 11)
ORDER = 4
THRESHOLD = 0.3
#: Symbols: 0 anything that isn't a letter, 1-26 a-z, 27 a byte of any other letter.
SYMBOLS = 28
#: What letters a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t",
}
SEPARATORS = " .-_*~"
#: Characters of a stretch after which the paths' common beginning is settled.
WINDOW = 4096
COST_LEET, COST_DROP, COST_KEEP, COST_DOUBLE = -0.7, -0.7, -4.0, -6.0

_LEET = re.escape("".join(LEET))
_LETTER = r"[^\W\d_]"
_OTHER = r"(?:[^\w\s]|[\d_])"
#: What makes a token suspicious: such a character anywhere beside a letter; a letter three times in a row; separators
#: between letters.  Four or more single characters with separators between each two count as one.  No character is in
#: two neighbouring repetitions, and a run is tried from its start only, so long runs take linear time.
SUSPICIOUS = re.compile(
    rf"{_LETTER}{_OTHER}*[{_LEET}]|(?<![^\w\s]|[\d_])(?>{_OTHER}*?[{_LEET}]){_OTHER}*+{_LETTER}"
    rf"|({_LETTER})\1\1|{_LETTER}[.\-_*~]+{_LETTER}"
)
_SINGLE = rf"(?:[^\W_]|[{re.escape('@$!|+')}])"
SPACED = re.compile(rf"(?<!\w)(?:{_SINGLE}[ .\-_*~]+){{3,}}{_SINGLE}(?!\w)")


def symbol(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


class CharModel:
    """Interpolated character n-gram model over symbols, from counts of ORDER-grams."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.tables: list[dict[int, float]] = []
        self.context: list[dict[int, float]] = []
        for n in range(1, ORDER + 1):
            keys, where = np.unique(grams % SYMBOLS**n, return_inverse=True)
            sums = np.bincount(where, weights=counts, minlength=len(keys))
            self.tables.append(dict(zip(keys.tolist(), sums.tolist())))
            heads, where = np.unique(keys // SYMBOLS, return_inverse=True)
            self.context.append(dict(zip(heads.tolist(), np.bincount(where, weights=sums, minlength=len(heads)).tolist())))
        self.cache: dict[int, float] = {}

    def log(self, history: int, s: int) -> float:
        """log P(s | history), history being the last ORDER - 1 symbols as one number."""
        key = history * SYMBOLS + s
        if (got := self.cache.get(key)) is None:
            p = 1.0 / SYMBOLS
            for n in range(1, ORDER + 1):
                h = history % SYMBOLS ** (n - 1)
                total = self.context[n - 1].get(h, 0.0)
                p = (self.tables[n - 1].get(h * SYMBOLS + s, 0.0) + 4.0 * p) / (total + 4.0)
            got = self.cache[key] = math.log(p)
        return got


def lattice(stretch: str, spaced: bool) -> Iterator[list[tuple[str, float]]]:
    """For each character of ``stretch`` what it may be read as ('' drops it), with the channel's log cost."""
    run = 0
    for i, ch in enumerate(stretch):
        run = run + 1 if i and ch == stretch[i - 1] else 1
        if ch in LEET:
            here = [(letter, COST_LEET) for letter in LEET[ch]] + [(ch, COST_KEEP)]
            if not ch.isdigit():
                here.append(("", COST_DROP * 2))
        elif ch in SEPARATORS and (spaced or ch != " "):
            here = [("", COST_DROP), (ch, COST_DROP)]
        elif run > 1 and ch.isalpha():
            long = run > 2 or stretch.startswith(ch, i + 1)
            here = [(ch, COST_KEEP if long else 0.0), ("", COST_DROP if long else COST_DOUBLE)]
        else:
            here = [(ch, 0.0)]
        yield here


def restore(stretch: str, model: CharModel, spaced: bool) -> str:
    """The Viterbi path of the lattice of ``stretch`` under ``model``, from one word's start to a word's end.

    Every ``WINDOW`` characters what all surviving paths have in common is settled, so a stretch of any length takes little
    memory and has the same path as if it were read at once.
    """
    if all(len(c) == 1 for c in lattice(stretch, spaced)):
        return stretch
    top = SYMBOLS ** (ORDER - 1)
    states: dict[int, tuple[float, int]] = {0: (0.0, -1)}
    trail: list[tuple[str, int]] = []  # (text, link to what stands before)
    settled: list[str] = []
    for at, cell in enumerate(lattice(stretch, spaced)):
        if at % WINDOW == 0 and at:
            text, trail, states = _settle(trail, states)
            settled.append(text)
        new: dict[int, tuple[float, int]] = {}
        for history, (score, link) in states.items():
            for text, cost in cell:
                if text:
                    s = symbol(text)
                    value, state = score + cost + model.log(history, s), (history * SYMBOLS + s) % top
                else:
                    value, state = score + cost, history
                if state not in new or value > new[state][0]:
                    new[state] = (value, len(trail) if text else link)
                    if text:
                        trail.append((text, link))
        states = new
    best = max(states.items(), key=lambda x: x[1][0] + model.log(x[0], 0))[1][1]
    return "".join([*settled, *(trail[i][0] for i in _path(trail, best))])


def _path(trail: list[tuple[str, int]], link: int) -> list[int]:
    back = []
    while link >= 0:
        back.append(link)
        link = trail[link][1]
    return back[::-1]


def _settle(trail: list[tuple[str, int]], states: dict[int, tuple[float, int]]) -> tuple[str, list, dict]:
    """The text that all states' paths begin with, and trail and states of what comes after it."""
    paths = [_path(trail, link) for _, link in states.values()]
    shared = os.path.commonprefix(paths)
    number = {-1: -1} | ({shared[-1]: -1} if shared else {})
    kept: list[tuple[str, int]] = []
    for path in paths:
        for i in path[len(shared) :]:
            if i not in number:
                number[i] = len(kept)
                kept.append((trail[i][0], number[trail[i][1]]))
    return "".join(trail[i][0] for i in shared), kept, {h: (score, number[link]) for h, (score, link) in states.items()}


class Restorer:
    """Restores whole texts; each distinct stretch is decoded once."""

    LIMIT, SHORT = 200_000, 64

    def __init__(self, model: CharModel):
        self.model, self.seen = model, {}

    def stretch(self, text: str, spaced: bool = False) -> str:
        if len(text) > self.SHORT:  # hardly met again, and a cache of long ones would have no bound
            return restore(text, self.model, spaced)
        if (got := self.seen.get(key := (text, spaced))) is None:
            if len(self.seen) > self.LIMIT:
                self.seen.clear()
            got = self.seen[key] = restore(text, self.model, spaced)
        return got

    def text(self, text: str) -> str:
        low = SPACED.sub(lambda m: self.stretch(m.group(), True), text.lower())
        out, done = [], 0
        for m in SUSPICIOUS.finditer(low):
            if m.start() < done:
                continue
            a, b = m.span()
            while a > done and not low[a - 1].isspace():
                a -= 1
            while b < len(low) and not low[b].isspace():
                b += 1
            out += [low[done:a], self.stretch(low[a:b])]
            done = b
        return "".join([*out, low[done:]]) if out else low


class Classifier(NamedTuple):
    """Weights of log(1 + count) of each stem, of their density, and the bias."""

    stems: tuple[str, ...]
    weights: tuple[float, ...]
    density: float
    bias: float


WORDS = re.compile(r"[^\W\d_]+")


def stems_of(restored: str) -> set[str]:
    """The beginnings, of STEM_LENGTHS letters, of the words of a restored text."""
    return {w[:n] for w in set(WORDS.findall(restored)) for n in STEM_LENGTHS if len(w) >= n}


def character_counts(df: DataFrame) -> DataFrame:
    """gram, n: the ORDER-grams of symbols in all texts of ``df`` (text); at most SYMBOLS ** ORDER rows."""
    table = bytes(b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0 for b in range(256))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**ORDER, dtype=np.int64)
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                joined = "\0\0\0".join(["", *pdf["text"].iloc[i : i + 256], ""])
                x = np.frombuffer(joined.encode("utf-8").translate(table), np.uint8).astype(np.int32)
                code = x[: 1 - ORDER].copy()
                for k in range(1, ORDER):
                    code *= SYMBOLS
                    code += x[k : len(x) - ORDER + 1 + k]
                total += np.bincount(code, minlength=SYMBOLS**ORDER)
            release()
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"gram": seen, "n": total[seen]})

    return df.mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def fit_characters(df: DataFrame, text: str = "text") -> CharModel:
    """The language model of the characters of all texts of ``df``."""
    counts = character_counts(df.select(text_or_empty(text).alias("text"))).toPandas().sort_values("gram")
    return CharModel(counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64))


def sample_labelled(df: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """doc_id, text, toxic of ``rows`` labelled rows of either label, by smallest hash of doc_id; of the rows of a doc_id one."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [
        known.filter((F.col("toxic") == 1) == is_toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        for is_toxic in (True, False)
    ]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text"))  # partly on the map side, so an id of very many rows is no burden
    return df.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), one.alias("text"))


def _choose_stems(found: list, n_toxic: int, n_clean: int) -> list[str]:
    """Greedy cover of the toxic rows by stems that are rare in the others."""
    chosen, covered = [], set()
    rows = [(r.stem, set(r.toxic_docs), r.clean) for r in found]
    least = max(2, n_toxic // 100)

    def worth(row: tuple) -> tuple:
        stem, docs, clean = row
        gain = len(docs - covered)
        return gain * math.log((gain / n_toxic + 1e-3) / (clean / max(n_clean, 1) + 1e-3)), len(docs), -len(stem), stem

    while rows:
        rows = [r for r in rows if len(r[1] - covered) >= least and not any(r[0].startswith(s) for s in chosen)]
        if not rows:
            break
        best = max(rows, key=worth)
        chosen.append(best[0])
        # Rows with one covering stem may still hold others: half of them stay open.
        covered |= {d for d in best[1] if zlib.crc32(repr(d).encode()) % 2 or best[2] * 20 > len(best[1])}
    return chosen


def _fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_classifier(df: DataFrame, labels: DataFrame, model: CharModel, rows: int = TRAIN_ROWS) -> Classifier:
    """Stems and weights from a bounded sample of the labelled rows of ``df`` (doc_id, text)."""
    sample = cut(sample_labelled(df, labels, rows).select("doc_id", "toxic", text_or_empty().alias("text")))
    kind = sample.schema["doc_id"].dataType.simpleString()
    is_toxic = F.col("toxic") == 1

    def restored_stems(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Restorer(model)
        for pdf in batches:
            bags = [sorted(stems_of(r.text(t))) for t in pdf["text"]]
            yield pdf[["doc_id", "toxic"]].assign(toxic=pdf["toxic"].astype("int64"), stem=bags).explode("stem").dropna()

    counts = {bool(r.t): r.n for r in sample.groupBy(is_toxic.alias("t")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(True, 0), counts.get(False, 0)
    if not n_toxic:
        return Classifier((), (), 0.0, -30.0)
    found = (
        sample.mapInPandas(restored_stems, f"doc_id {kind}, toxic long, stem string")
        .groupBy("stem")
        .agg(F.collect_set(F.when(is_toxic, F.col("doc_id"))).alias("toxic_docs"), F.count(F.when(~is_toxic, 1)).alias("clean"))
        .filter(F.size("toxic_docs") >= max(2, n_toxic // 100))
        .filter(F.col("clean") * (n_toxic * 4) < F.size("toxic_docs") * F.lit(max(n_clean, 1)))
        .collect()
    )
    stems = sorted(_choose_stems(found, n_toxic, n_clean))
    features = sample.mapInPandas(_featured(model, stems), "toxic long, x array<double>").toPandas().sort_values(
        ["toxic", "x"], key=lambda c: c if c.name == "toxic" else c.map(tuple)
    )
    if not n_clean:
        return Classifier(tuple(stems), (1.0,) * len(stems), 0.0, 0.0)
    w = _fit_weights(np.stack(features["x"].to_numpy()), (features["toxic"] == 1).to_numpy(float))
    share = labels.filter("toxic IS NOT NULL").agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = math.log(share / (1 - share)) - math.log(n_toxic / n_clean) if 0 < share < 1 else 0.0
    return Classifier(tuple(stems), tuple(w[: len(stems)]), float(w[-2]), float(w[-1]) + prior)


def _featured(model: CharModel, stems: list[str]):
    extract = features_of(model, stems)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = extract()
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"].astype("int64"), "x": [one(t)[0] for t in pdf["text"]]})

    return run


def features_of(model: CharModel, stems: tuple[str, ...] | list[str]):
    """A factory, called once in a task, of a function from a text to (features, words with an abusive stem)."""
    known = {s: i for i, s in enumerate(stems)}
    spelled = "|".join("".join(f"{re.escape(c)}+" for c in s) for s in stems) or "(?!)"
    pattern = rf"(?<![^\W\d_])(?:{spelled})[^\W\d_]*"

    def make():
        restorer, words = Restorer(model), re.compile(pattern)

        def stem_of(word: str) -> int | None:
            return next((known[word[:n]] for n in STEM_LENGTHS if word[:n] in known), None)

        def one(text: str) -> tuple[list[float], list[str]]:
            restored, counts, hits = restorer.text(text), [0] * len(known), []
            for word in words.findall(restored):
                # A doubled letter alone isn't suspicious; here it may hide a stem.
                at = stem_of(word)
                if at is None and (at := stem_of(restorer.stretch(word))) is None:
                    continue
                counts[at] += 1
                hits.append(word)
            density = 100 * len(hits) / (restored.count(" ") + restored.count("\n") + 1)
            return [*map(math.log1p, counts), min(density, 4.0)], hits

        return one

    return make


def scorer(model: CharModel, classifier: Classifier):
    """A factory, called once in a task, of a function from a text to (score, words with an abusive stem)."""
    extract, weights = features_of(model, classifier.stems), [*classifier.weights, classifier.density]

    def make():
        features = extract()

        def one(text: str) -> tuple[float, list[str]]:
            x, hits = features(text)
            z = classifier.bias + sum(a * b for a, b in zip(x, weights))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), sorted(set(hits))

        return one

    return make


def score(df: DataFrame, model: CharModel, classifier: Classifier, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted and words (those with an abusive stem) of every row of ``df``."""
    rows = df.select(F.col(doc_id).cast("string").alias("doc_id"), text_or_empty(text).alias("text"))
    find = scorer(model, classifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = find()
        for pdf in batches:
            for part in slices(pdf):
                got = [one(t) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "score": [g[0] for g in got], "words": [g[1] for g in got]})

    scored = rows.mapInPandas(run, "doc_id string, score double, words array<string>")
    scored = scored.withColumn("doc_id", F.col("doc_id").cast(df.schema[doc_id].dataType))
    return scored.select("doc_id", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "words")


def clean_rows(df: DataFrame, model: CharModel, classifier: Classifier, text: str = "text") -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, with all columns; decided where each row is."""
    find = scorer(model, classifier)

    @F.pandas_udf("boolean")
    def toxic(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = find()
        for series in texts:
            yield pd.Series([one(t)[0] >= THRESHOLD for t in series], dtype=bool)
            release()

    return df.filter(~toxic(text_or_empty(text)))
