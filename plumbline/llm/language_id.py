"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the lower-cased UTF-8 bytes of a text in both directions, across words, and gives every position a
distribution over the languages; a document's probabilities are the mean over all its positions.  Texts are read in windows
of ``WINDOW`` bytes, each with up to ``CONTEXT`` bytes of what precedes and follows it, so that every position sees at least
so far (or to the end of the text) both ways; windows of many texts are read side by side, and a long text isn't one long
chain.  The network is trained here, in numpy, by backpropagation through time on a bounded sample of labelled rows: of
each language ``TRAIN_DOCS`` documents with their whole texts, those with the smallest hash of doc_id; a training step reads
spans of up to ``SPAN`` bytes, longer than a window, from random places of random ones.  The weights (tens of KB) go to the tasks.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled row every text is
``und``; equal texts give equal predictions (probabilities are rounded to six digits), ties go to the smaller language; a
very long text is read in slices of bounded size; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices

TRAIN_DOCS = 150
WINDOW, CONTEXT = 256, 32
HIDDEN = 8
STEPS, BATCH, SPAN = 260, 64, 288
UNKNOWN = "und"
#: Windows that are read side by side.
ABREAST = 1024


class BiGRU:
    """Weights by name; d is the direction, 0 forward and 1 backward.

    Step: z, r = sigmoid(E[x] + h U + b), n = tanh(E[x] + r * (h U_n) + b), h' = (1 - z) n + z h.
    """

    def __init__(self, labels: list[str], seed: int = 7):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.labels, self.w = labels, {}
        for d in (0, 1):
            self.w[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.w[f"U{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        self.w["V"] = rng.normal(0, 0.3, (2 * h, len(labels))).astype(np.float32)
        self.w["c"] = np.zeros(len(labels), np.float32)

    def _pass(self, x: np.ndarray, d: int, active: list[int] | None = None, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, H, B) of byte columns x (T, B); at step t only the first ``active[t]`` columns are read."""
        k = HIDDEN
        table, u_t = np.ascontiguousarray(self.w[f"E{d}"].T), np.ascontiguousarray(self.w[f"U{d}"].T)
        out, h = np.zeros((len(x), k, x.shape[1]), table.dtype), np.zeros((k, x.shape[1]), table.dtype)
        for t in range(len(x)):
            b = x.shape[1] if active is None else active[t]
            old = h[:, :b]
            e, u = np.take(table, x[t, :b], axis=1), u_t @ old
            zr = e[: 2 * k]
            zr += u[: 2 * k]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r, un = zr[:k], zr[k:], u[2 * k :]
            n = r * un
            n += e[2 * k :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((old.copy(), z, r, n, un))
            new = old - n
            new *= z
            new += n
            h[:, :b] = out[t, :, :b] = new
        return out

    def _softmax(self, both: np.ndarray) -> np.ndarray:
        s = self.w["V"].T @ both
        s += self.w["c"][:, None]
        s -= s.max(axis=1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=1, keepdims=True)
        return s

    def probabilities(self, x: np.ndarray, sizes: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """(t, labels, B) for runs of positions in turn: the distribution at every position of byte columns x (T, B).

        ``sizes`` (B) are the columns' lengths, in falling order; what is given beyond them means nothing.
        """
        active = None if sizes is None else [int(np.searchsorted(-sizes, -t)) for t in range(len(x))]
        ahead, back = self._pass(x, 0, active), self._pass(x[::-1], 1, active and active[::-1])[::-1]
        for t in range(0, len(x), 32):
            yield self._softmax(np.concatenate([ahead[t : t + 32], back[t : t + 32]], axis=1))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients, by backpropagation through time, of byte columns x (T, B) with labels y (B)."""
        k, keep = HIDDEN, ([], [])
        xs = (x, x[::-1])
        states = [self._pass(xs[d], d, None, keep[d]) for d in (0, 1)]
        both = np.concatenate([states[0], states[1][::-1]], axis=1)
        p, at = self._softmax(both), np.arange(len(y))
        loss = -np.log(p[:, y, at] + 1e-9).mean()
        p[:, y, at] -= 1
        p /= x.size
        g = {n: np.zeros_like(w) for n, w in self.w.items()}
        g["V"] = np.tensordot(both, p, ([0, 2], [0, 2]))
        g["c"] = p.sum((0, 2))
        back = self.w["V"] @ p
        for d, dh_out in enumerate((back[:, :k], back[::-1, k:])):
            dh, steps = np.zeros((k, x.shape[1]), back.dtype), []
            for t in reversed(range(len(x))):
                h, z, r, n, un = keep[d][t]
                dh = dh + dh_out[t]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                steps.append(np.concatenate([dz, dr, dn]))
                du = np.concatenate([dz, dr, dn * r])
                g[f"U{d}"] += h @ du.T
                dh = dh * z + self.w[f"U{d}"] @ du
            np.add.at(g[f"E{d}"], xs[d][::-1].ravel(), np.stack(steps).transpose(0, 2, 1).reshape(-1, 3 * k))
        return float(loss), g


def bytes_of(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 7) -> BiGRU:
    """A network for the languages in ``langs``, by Adam on batches of spans of one length, languages balanced."""
    labels, rng = sorted(set(langs)), np.random.default_rng(seed)
    net = BiGRU(labels, seed)
    pools: dict[int, list[list[bytes]]] = {}  # by length of span: whole texts that are shorter, longer ones for a random part
    for text, lang in zip(texts, langs):
        if data := bytes_of(text):
            pools.setdefault(min(len(data), SPAN), [[] for _ in labels])[labels.index(lang)].append(data)
    lengths = sorted(pools)
    mass = np.array([sum(len(data) for pool in pools[n] for data in pool) for n in lengths], dtype=float)
    if not lengths:
        return net
    m = {n: np.zeros_like(w) for n, w in net.w.items()}
    v = {n: np.zeros_like(w) for n, w in net.w.items()}
    for step in range(1, steps + 1):
        n = int(rng.choice(lengths, p=mass / mass.sum()))
        full = [i for i, pool in enumerate(pools[n]) if pool]
        y = rng.choice(full, BATCH)
        read = [pools[n][i][rng.integers(len(pools[n][i]))] for i in y]
        begin = [rng.integers(len(data) - n + 1) for data in read]
        x = np.array([list(data[a : a + n]) for data, a in zip(read, begin)], dtype=np.int64).T
        _, g = net.gradients(x, y)
        rate = 0.02 * (1 - step / (steps + 1))
        for name, w in net.w.items():
            m[name] += 0.1 * (g[name] - m[name])
            v[name] += 0.01 * (g[name] ** 2 - v[name])
            w -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)
    return net


def pooled(net: BiGRU, texts: list[str]) -> np.ndarray:
    """(texts, labels): the mean probabilities of each text's positions."""
    total = np.zeros((len(texts), len(net.labels)))
    windows = []  # of text, its bytes, first position, end of the window, and of what is read around it
    for i, text in enumerate(texts):
        data = bytes_of(text)
        for a in range(0, len(data), WINDOW):
            b = min(a + WINDOW, len(data))
            windows.append((i, data, a, b, max(0, a - CONTEXT), min(len(data), b + CONTEXT)))
            if len(windows) == ABREAST:
                _read(net, windows, total)
                windows = []
    if windows:
        _read(net, windows, total)
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)


def _read(net: BiGRU, windows: list[tuple], total: np.ndarray) -> None:
    """Adds the probabilities at the windows' positions to their texts' rows of ``total``."""
    windows = sorted(windows, key=lambda w: w[4] - w[5])
    sizes = np.array([hi - lo for *_, lo, hi in windows])
    x = np.zeros((len(windows), sizes[0]), np.uint8)
    for row, (_, data, _, _, lo, hi) in zip(x, windows):
        row[: hi - lo] = np.frombuffer(data, np.uint8, hi - lo, lo)
    begin, end = (np.array([w[k] - w[4] for w in windows]) for k in (2, 3))
    sums, t = np.zeros((len(windows), len(net.labels))), 0
    for p in net.probabilities(np.ascontiguousarray(x.T), sizes):
        at = np.arange(t, t + len(p))[:, None]
        sums += np.einsum("tlb,tb->bl", p, ((at >= begin) & (at < end)).astype(np.float32))
        t += len(p)
    np.add.at(total, np.array([w[0] for w in windows]), sums)


def training_rows(df: DataFrame, per_language: int) -> DataFrame:
    """lang, doc_id and text of ``per_language`` rows of each language of ``df`` (doc_id, text, lang), by smallest hash.

    The ids are chosen on doc_id and lang alone, once each, with a group limit on the map side; only then are their texts read,
    and of the rows that share an id and a language one is taken, partly on the map side.
    """
    known = df.filter("lang IS NOT NULL AND text IS NOT NULL")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_language)
    chosen = F.broadcast(ids.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")))
    rows = known.join(chosen, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")), "left_semi")
    return rows.groupBy("lang", "doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def identify(df: DataFrame, net: BiGRU, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row of ``df``."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf):
                texts = [t or "" for t in part["text"]]
                lettered = np.array([any(map(str.isalpha, t)) for t in texts], dtype=bool) & bool(net.labels)
                lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
                if lettered.any():
                    p = pooled(net, [t for t, ok in zip(texts, lettered) if ok]).round(6)
                    lang[lettered] = np.array(net.labels, dtype=object)[p.argmax(axis=1)]
                    score[lettered] = p.max(axis=1)
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": lang, "score": score})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def fit(df: DataFrame, per_language: int = TRAIN_DOCS) -> BiGRU:
    """A network trained on a bounded sample of the labelled rows of ``df`` (doc_id, text, lang)."""
    sample = sorted((r.lang, r.doc_id is None, r.doc_id or 0, r.text) for r in training_rows(df, per_language).collect())
    return train([text for *_, text in sample], [lang for lang, *_ in sample])
