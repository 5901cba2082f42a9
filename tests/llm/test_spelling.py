import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import spelling


def near(x, y):
    """Whether exactly one inserted, deleted or replaced character tells them apart."""
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute(counts, factor=5):
    out = {}
    for w, n in counts.items():
        close = sorted((-counts[v], v) for v in counts if near(w, v))
        fits = close and -close[0][0] >= factor * n
        out[w] = (close[0][1] if fits else None, n, len(close), -close[0][0] if fits else None)
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def _vocabulary(seed, size):
    r = random.Random(seed)
    words = {"".join(r.choice("abé") for _ in range(r.randint(6, 9))) for _ in range(size // 2)}
    while len(words) < size:
        w = list(r.choice(sorted(words)))
        i = r.randrange(len(w) + 1)
        w[i : i + r.randint(0, 1)] = r.choice(["", "z", "ab", "é"])
        if len(w) >= 6:
            words.add("".join(w))
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "abababab", "babababa"}
    return {w: r.choice([5, 6, 30, 31, 200, 1200]) for w in words}


@pytest.mark.parametrize("group_words", [20_000, 40, 1])
def test_variants_equal_brute_force(spark, group_words):
    counts = _vocabulary(group_words, 260)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, group_words=group_words).collect()}
    assert got == brute(counts)


def test_groups_are_cut_without_losing_pairs(spark):
    """A third of the words share their beginning, and another their end."""
    r = random.Random(2)
    tail = lambda: "".join(r.choice("abcd") for _ in range(5))
    words = sorted({"prefix" + tail() for _ in range(150)} | {tail() + "suffix" for _ in range(150)} | {tail() + tail() for _ in range(150)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    groups = spelling._groups(df, 30).groupBy("a", "head", "tail").count().collect()
    narrow = [g for g in groups if g["a"] - len(g["head"]) - len(g["tail"]) > 1]
    assert narrow and max(g["count"] for g in narrow) <= 30
    got = {x.word: x.n_near for x in spelling.near_words(df, 30).collect()}
    want = {w: sum(near(w, v) for v in words) for w in words}
    assert got == {w: n for w, n in want.items() if n}


def test_pairs_of_one_trie_are_met_once():
    r = random.Random(4)
    for a in (1, 2, 3, 4):
        words = sorted({"".join(r.choice("ab") for _ in range(n)) for n in (a, a + 1) for _ in range(30)})
        met = list(spelling.one_edit_pairs([(w, i) for i, w in enumerate(words)], a, True))
        pairs = Counter(tuple(sorted(p)) for p in met)
        want = {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if i < j and near(x, y) and min(len(x), len(y)) == a}
        assert set(pairs) == want and set(pairs.values()) <= {1}


def test_word_counts_drop_letters_by_hash(docs):
    texts = [None, "", "short Ärger ÄRGER straße STRASSE straße"] + ["Wonderful wonderful×day naïveté-ok " * 3] * 40
    want = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")):
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 7 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            want[run] += 1
    got = {r.word: r.n for r in spelling.word_counts(docs(texts), drop_one_in=7).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5} and got


def test_empty_tables_and_repeated_rows(docs, spark):
    assert spelling.variants(spelling.word_counts(docs(["x"]).limit(0))).collect() == []
    df = docs([(1, "wonderful")] * 5 + [(None, "wonderfull")] * 5)
    rows = spelling.variants(spelling.word_counts(df)).orderBy("word").collect()
    assert [(r.word, r.n, r.n_near, r.form, r.root) for r in rows] == [("wonderful", 5, 1, None, "wonderful"), ("wonderfull", 5, 1, None, "wonderfull")]
    assert spelling.variants(spark.createDataFrame([("alone", 5)], "word string, n long")).select(F.col("root")).first().root == "alone"
