import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from plumbline.llm import ranked_search


def terms(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(texts, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in texts]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 25 + (75 * c.total() * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def found(rows):
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in sorted(rows, key=lambda r: (r.item_id, r["rank"]))]


@pytest.mark.parametrize(("shard_chars", "block_terms"), [(1 << 24, 50_000), (3000, 25)])
def test_equals_brute_force(spark, docs, prose, shard_chars, block_terms):
    r = random.Random(6)
    texts = [prose(i, r.choice([1, 5, 40, 200]), 300) for i in range(300)] + [None, "", "...", "É É é", "Z9 z9"]
    texts += [texts[3]] * 20 + [texts[4].upper()]
    items = [(i, prose(500 + i, r.randint(1, 30), 300)) for i in range(25)] + [(25, None), (26, ""), (27, "nowhere unseenword"), (28, "é z9 Z9 co co co")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")
    index = ranked_search.build(docs(texts).repartition(3), shard_chars=shard_chars)
    got = found(ranked_search.search(index, asked, block_terms=block_terms).collect())
    assert got == brute(list(enumerate(texts)), items) and {g[0] for g in got} >= {0, 24, 28}
    assert (index.shards.count() > 3) == (shard_chars == 3000)


def test_ties_repeated_rows_and_null_ids(spark, docs):
    rows = [(9, "red fish"), (2, "red fish"), (2, "red fish"), (None, "red fish"), (1, "blue fish"), (3, "cold soup"), (4, "warm soup")]
    asked = spark.createDataFrame([(1, "red"), (1, "red")], "item_id long, text string")
    got = ranked_search.search(ranked_search.build(docs(rows)), asked, k=3).collect()
    assert sorted((g["rank"], g.doc_id) for g in got) == [(1, 2), (1, 2), (2, 2), (2, 2), (3, 9), (3, 9)]
    every = ranked_search.search(ranked_search.build(docs(rows)), asked.limit(1)).orderBy("rank").collect()
    assert [g.doc_id for g in every] == [2, 2, 9, None]


def test_empty_tables(spark, docs):
    asked = spark.createDataFrame([(1, "red")], "item_id long, text string")
    assert ranked_search.search(ranked_search.build(docs(["red"]).limit(0)), asked).collect() == []
    assert ranked_search.search(ranked_search.build(docs(["red"])), asked.limit(0)).collect() == []


def _shard(r, n, lists):
    """A shard of n documents with (term, share of documents) lists."""
    lengths = np.array([r.randint(5, 400) for _ in range(n)], dtype=np.int64)
    rows = [(0, None, n, 0, lengths.tobytes(), b"", list(map(str, range(n))))]
    for term, share in lists:
        places = np.array([i for i in range(n) if r.random() < share], dtype=np.uint16)
        times = np.array([r.choice([1, 1, 1, 2, 3, 300]) for _ in places], dtype=np.int32)
        rows.append((0, term, len(places), 0, places.tobytes(), times.tobytes(), None))
    return ranked_search.ShardSearch(pd.DataFrame(rows, columns=["shard", "term", "rows", "total", "a", "b", "ids"]), n, int(lengths.sum()))


def test_pruning_equals_full_sums():
    """Frequent terms of little weight become non-essential; the best documents stay those of the full sums."""
    r = random.Random(1)
    shard = _shard(r, 9000, [("the", 0.9), ("of", 0.7), ("rare", 0.01), ("odd", 0.03), ("some", 0.2)])
    for query in ([("the", 30), ("of", 60), ("rare", 9000), ("odd", 7000)], [("the", 1)], [("some", 500), ("of", 499)], [("absent", 5)], [("the", 0)]):
        full = np.zeros(9000, dtype=np.int64)
        for t, w in query:
            if t in shard.lists:
                full[shard.lists[t].places] += shard.lists[t].gains * w
        want = sorted((-int(s), i) for i, s in enumerate(full) if s > 0)[:10]
        best, score = shard.top(query, 10)
        assert [(-s, b) for b, s in zip(best.tolist(), score.tolist())] == want
