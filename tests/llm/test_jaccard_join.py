import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import common as C
from plumbline.llm import jaccard_join as J


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets, holders, shared = {d: shingles(t) for d, t in rows}, defaultdict(list), Counter()
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    for ds in holders.values():
        shared.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1 :])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def edited(text, seed, edits):
    r, w = random.Random(seed), text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("small_group,block", [(8, 512), (2, 7)])
def test_components_equal_brute_force(docs, prose, monkeypatch, small_group, block):
    monkeypatch.setattr(J, "SMALL_GROUP", small_group)
    monkeypatch.setattr(J, "BLOCK_DOCS", block)
    monkeypatch.setattr(J, "COMMON_LEAST", 12)
    monkeypatch.setattr(C, "HOT_ROWS", 30)
    texts = [None, "", " \n", "one two", "One TWO", "one two three four five", "one two three four five six"]
    for size in (5, 6, 9, 14, 30, 60, 120, 400, 1500):
        base = prose(size, size)
        texts += [base, base.upper(), *[edited(base, i, max(1, size * i // 60)) for i in range(1, 7)], base + " tail", prose(size + 1, size)]
    crowd = prose(77, 100)
    texts += [edited(crowd, i, i % 9) for i in range(40)]  # a crowd of near copies, many at the border
    line = prose(88, 40)
    texts += [f"{prose(200 + i, 30)} {line} {prose(400 + i, 25)}" for i in range(40)]  # a passage in many strangers
    far = [edited(crowd, 900 + i, 14) for i in range(6)]  # apart from the crowd's first, near one or the other of the rest
    texts += far + [edited(f, i, 2) for i, f in enumerate(far)]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_documents(docs(rows)).collect()}
    want = brute(rows)
    assert {d: (want[d], got[d]) for d in want if want[d] != got[d]} == {}


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(4)
    bands, none = J.band_list(), np.zeros(0, dtype=J.U)
    lows = np.array([b.low for b in bands])
    for n in [4, 5, 7, 10, 11, 16, 25, 26, 60, 91, 92, 138, 139, 300, 471, 708, 3000]:
        for trial in range(30):
            a = r.integers(0, 1 << 63, n, dtype=np.int64).view(J.U)
            drop = r.integers(0, n // 5 + 1)
            more = r.integers(0, n // 5 + 1)
            b = np.concatenate([a[drop:], r.integers(0, 1 << 63, more, dtype=np.int64).view(J.U)])
            shared = n - drop
            if 100 * shared < 80 * (n + more):
                continue
            common = np.sort(r.choice(a, n // 2, replace=False)) if trial % 2 else none
            x, y = (J.signatures(np.unique(s), common, bands, lows) for s in (a, b))
            equal = len(a) == len(b) and not drop and not more
            assert equal or np.intersect1d(x, y).size, (n, drop, more)


def test_allocation_leaves_no_gap():
    for b in J.band_list()[:24]:
        assert b.segments * (b.allowance + 1) - b.slack == 2 * b.high // 9 + 1 and b.slack >= 0


def test_repeated_rows_null_ids_and_empty_tables(docs, prose):
    t = prose(1, 50)
    df = docs([(3, t), (3, t), (None, t), (9, edited(t, 1, 1)), (None, prose(2, 50)), (7, None)])
    got = sorted((str(r.doc_id), str(r.component_id)) for r in J.similar_documents(df).collect())
    assert got == [("3", "3"), ("3", "3"), ("7", "7"), ("9", "3"), ("None", "3"), ("None", "None")]
    assert J.similar_documents(df.limit(0)).collect() == [] == J.drop_similar(df.limit(0)).collect()


def test_one_of_each_group_stays(docs, prose):
    t = prose(1, 60)
    df = docs([(1, t), (4, edited(t, 1, 1)), (5, edited(t, 2, 1)), (6, prose(9, 60)), (7, ""), (8, None)])
    kept = J.drop_similar(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 6, 7, 8]


def test_any_long_is_an_id_and_shared_ids_are_told_apart(docs, prose):
    t, u, big = prose(1, 50), prose(2, 50), (1 << 62) + 7
    df = docs([(big, t), ((1 << 63) - 1, edited(t, 1, 1)), (5, u), (5, prose(3, 50)), (3, edited(u, 1, 1)), (None, t)])
    got = sorted((r.doc_id or 0, r.component_id) for r in J.similar_documents(df).collect())
    assert got == [(0, big), (3, 3), (5, 3), (5, 5), (big, big), ((1 << 63) - 1, big)]
    assert sorted(r.doc_id for r in J.drop_similar(df).collect()) == [3, 5, big]


def test_sets_that_share_a_number_are_told_apart(docs, prose, monkeypatch):
    number = J._class_number
    monkeypatch.setattr(J, "_class_number", lambda s, salt: 1 if salt == 0 else number(s, salt))
    df = docs([(1, prose(1, 30)), (2, prose(2, 30)), (3, prose(1, 30))])
    # Tasks import the module anew; here it is enough that the second salt gives the same classes.
    assert {r.doc_id: r.component_id for r in J.similar_documents(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_few_words_alone_and_after_a_long_text(docs, spark):
    """Runs of 0 to 6 words in all, one row a partition and behind a text that fills a run of its own."""
    texts = ["", "one", "one two", "ONE two", "one two three", "one two three four", "one two three four five", "one two three four five six"]
    for t in texts:
        assert len(J.shingle_sets([t])[0]) == len(shingles(t)) == len(J.shingle_sets(["x " * 300_000, t])[1])
        got = J.similar_documents(docs([(1, t)])).collect()
        assert [(r.n_shingles, r.component_id) for r in got] == [(len(shingles(t)), 1)]
    rows = list(enumerate(["y " * 300_000, *texts]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_documents(docs(rows).repartition(len(rows))).collect()}
    assert got == brute(rows)
    assert sorted(r.doc_id for r in J.drop_similar(docs([(3, "one two"), (4, "ONE two")])).collect()) == [3]


def test_words_that_cancel_out_in_polynomials(docs):
    """A word and its complement of 1,024 and more letters, for which every polynomial modulo a power of two is the same."""
    low = "a"
    while len(low) < 2048:
        low += low.translate(str.maketrans("ab", "ba"))
        word, other = low, low.translate(str.maketrans("ab", "ba"))
        assert not np.intersect1d(*J.shingle_sets([f"w {word} x y z", f"w {other} x y z"])).size
    rows = [(i, f"w1 w2 {w} w3 w4 w5 w6") for i, w in enumerate([word, other, word[:1024], other[:1024], word[:1000], other[:1000]])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_documents(docs(rows)).collect()}
    assert got == brute(rows) and len({c for _, c in got.values()}) == 6


def test_links_are_confirmed_on_words(prose):
    r = random.Random(3)
    for i in range(200):
        x = prose(i, r.choice([0, 3, 5, 9, 40, 200]), 50)
        y = edited(x, i, r.randint(0, 4)) if x else r.choice(["", "a"])
        a, b = shingles(x), shingles(y)
        assert J.texts_similar(x, y, 80) == (bool(a & b) and 100 * len(a & b) >= 80 * len(a | b))


def test_hashes_of_one_word_do_not_depend_on_its_place():
    r = random.Random(9)
    words = ["w" * n for n in (1, 7, 8, 9, 15, 16, 17, 1023, 1024, 1025, 3000)] + ["".join(r.choice("ab") for _ in range(n)) for n in range(1, 40)]
    seen = {}
    for _ in range(20):
        r.shuffle(words)
        data = np.frombuffer((" " + " ".join(words) + " " * 8).encode(), dtype=np.uint8)
        space = data == 32
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:]) + 1
        for w, h in zip(words, J.word_hashes(data, starts, ends, 5).tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_of_equal_rows_the_same_one_stays(spark):
    schema = "doc_id long, text string, meta map<string,int>, rank int"
    rows = [(1, "a b c d e f", {"k": i}, i) for i in range(6)] + [(2, "A b c d e f", {}, 0)]
    kept = {J.drop_similar(spark.createDataFrame(rows[k:] + rows[:k], schema).repartition(3)).first()["rank"] for k in range(3)}
    assert len(kept) == 1


def test_packed_signatures_come_back_in_few_bytes():
    r = np.random.default_rng(6)
    for n in (0, 1, 2, 700, 5000):
        values, places = np.sort(r.integers(0, 1 << 48, n)).astype(J.U), r.integers(0, 1 << 24, n)
        back = J.unpacked(J.packed(values, places), n)
        assert (back[0] == values).all() and (back[1] == places).all()


def test_signatures_are_shuffled_in_few_bytes_and_meet(docs, prose, monkeypatch):
    """A row of two longs for each signature was over 12 bytes.  Sets meet as their signatures say, in groups of all sizes."""
    monkeypatch.setattr(J, "SMALL_GROUP", 3)
    monkeypatch.setattr(J, "PACKED", 5000)
    monkeypatch.setattr(J, "BUCKET", 3000)
    base = prose(5, 80)
    texts = [edited(base, i, i % 7) for i in range(30)] + [prose(100 + i, 90) for i in range(150)] + [base, "one two", ""]
    d = J._documents(docs(list(enumerate(texts))), "doc_id", "text")
    classes = d.sparkSession.createDataFrame(J._profiles(d, 0).filter("n > 0").groupBy("cid").agg({"key": "min"}).collect(), "cid long, key long")
    total = sum(len(s) for s in J.shingle_sets(texts))
    signed = J._signature_rows(d, classes, np.zeros(0, dtype=J.U), 0, total)
    size, count = signed.filter("bucket >= 0").selectExpr("sum(length(data))", "sum(count)").first()
    assert size < 9 * count and signed.filter("bucket >= 0").selectExpr("count(distinct bucket)", "count(*)").first()[0] > 1
    met = J._met(signed).collect()
    cid = {r.a: r.b for r in met if r.size < 0}
    bands = J.band_list()
    lows, holders = np.array([b.low for b in bands]), defaultdict(set)
    for s in J.shingle_sets(texts):
        for x in J.signatures(s, np.zeros(0, dtype=J.U), bands, lows).tolist():
            holders[x].add(J._class_number(s, 0))
    small = {frozenset((a, b)) for h in holders.values() if 1 < len(h) <= 3 for a in h for b in h if a != b}
    assert small <= {frozenset((cid[r.a], cid[r.b])) for r in met if r.size == 0}
    large = defaultdict(set)
    for r in met:
        if r.size > 0:
            large[r.sig].add(cid[r.b])
    assert {frozenset(h) for h in holders.values() if len(h) > 3} <= {frozenset(h) for h in large.values()} and large
