import hashlib
import random
import re

import numpy as np
import pytest

from plumbline.llm import decontamination


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, size=10):
    """n_words, n_hit, n_items, digest of the items."""
    w, hit, met = words(text), set(), set()
    for name, item in items:
        v = words(item)
        k = min(size, len(v))
        wanted = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in wanted:
                hit.update(range(i, i + k))
                met.add("" if name is None else str(name))
    return len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items(spark):
    def make(rows):
        return spark.createDataFrame(rows, "item_id long, text string, spans string, n_words string")

    return make


def _cases(prose):
    r = random.Random(3)
    items = [(i, prose(100 + i, r.randint(12, 60), 400)) for i in range(30)]
    items += [(30, "One two"), (31, "x"), (32, ""), (33, None), (34, "a " * 14), (None, "no name at all here"), (5, items[6][1]), (35, items[7][1].upper())]
    items += [(36, "ä ö Ü é"), (37, "the quick brown fox jumps over the lazy dog tonight"), (38, "the quick brown fox jumps over the lazy dog tonight again")]
    texts = [None, "", "x", "one-TWO", "one  two three", "a " * 40, "a " * 9, "ä\nö Ü\té", "Ä ö Ü é", "xx x.x", " - "]
    for _ in range(120):
        parts = [prose(r.random(), r.randint(0, 60), 400)]
        for _ in range(r.randint(0, 3)):
            v = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(v) - 9))
            parts += [r.choice([" ", "\n", ", "]).join(v[a : a + r.choice([8, 9, 10, 11, 30])]), prose(r.random(), r.randint(0, 9), 400)]
        texts.append(r.choice([" ", "; ", "\n\n"]).join(parts))
    return items, texts


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_equals_brute_force(docs, items, prose, block_bytes):
    named, texts = _cases(prose)
    found = decontamination.find_items(docs(texts), items([(i, t, "y", "z") for i, t in named]), block_bytes=block_bytes)
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.summary(found).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == brute(t, named), t


def test_stretches_and_parts_lose_nothing(monkeypatch):
    """Occurrences that reach over the ends of stretches, and of the parts of a long text."""
    r = random.Random(8)
    text = " ".join(r.choice(["a", "b", "ab", "ba"]) for _ in range(4000))
    named = [(str(i), " ".join(r.choice(["a", "b", "ab", "ba"]) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 10, 12])]
    for stretch, part in ((7, 1 << 20), (512, 50), (64, 333)):
        monkeypatch.setattr(decontamination, "STRETCH", stretch)
        monkeypatch.setattr(decontamination, "SEARCH_BYTES", part)
        n, runs, met = next(decontamination.Searcher(named, 5).search([text]))
        want = brute(text, named, 5)
        assert (n, sum(b - a + 1 for a, b in runs), len(met)) == want[:3]


def test_shift_tables_skip_most_places(prose):
    """On text without occurrences the loop looks at a small part of the places."""
    patterns = [p for i in range(20) for p in decontamination.windows(prose(i, 40).encode().split(), 10)]
    c = decontamination.PatternClass(patterns)
    data = decontamination.joined_words([prose(1000 + i, 500) for i in range(20)])
    looked = []
    hashes = c.hashes
    c.hashes = lambda blocks, at: looked.append(np.size(at)) or hashes(blocks, at)
    assert len(c.candidates(data)) < len(data) / 500 and sum(looked) < len(data) / 8


def test_runs_merge_to_maximal_ones():
    assert decontamination.merged(np.array([5, 0, 3, 20]), np.array([9, 4, 5, 21])) == [(0, 9), (20, 21)]
    assert decontamination.merged(np.zeros(0, int), np.zeros(0, int)) == []


def test_repeated_rows_empty_tables_and_clean_rows(docs, items):
    item = items([(1, "one two three", "", "")])
    df = docs([(7, "say one two three now"), (7, "say one two three now"), (None, "one two"), (8, None)])
    rows = decontamination.find_items(df, item).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 0, 1, 1] and {(s.first, s.last) for r in rows for s in r.spans} == {(1, 3)}
    clean = decontamination.clean_rows(df, item)
    assert clean.columns == df.columns and sorted((r.doc_id is None, r.text) for r in clean.collect() if r.text) == [(True, "one two")] and clean.count() == 2
    assert decontamination.find_items(df.limit(0), item).collect() == []
    assert all(r.spans == [] for r in decontamination.find_items(df, item.limit(0)).collect())
