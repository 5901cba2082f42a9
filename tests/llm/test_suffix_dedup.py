import hashlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import suffix_dedup as S


def brute(rows, length):
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((d, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fixture(prose):
    base = prose(1, 200)
    texts = [None, "", base, base, base[:500] + "X" + base[501:], base[300:900], "a" * 700, "ab" * 300, prose(2, 20) + "\x00" + "é" * 300, "é" * 150]
    passage = prose(3, 60)
    texts += [f"{prose(10 + i, 30)} {passage} {prose(50 + i, 30)}" for i in range(12)]
    texts += [f"{prose(90 + i, 10)}{passage[i * 7 :]}{prose(120 + i, 10)}{passage[: 250 + i]}" for i in range(12)]
    return list(enumerate(texts))


@pytest.mark.parametrize("length,block,group_rows,hot", [(200, 160 << 10, 8192, 20_000), (200, 600, 3, 20_000), (60, 900, 5, 4), (12, 160 << 10, 8192, 20_000)])
def test_equal_to_brute_force(docs, prose, monkeypatch, length, block, group_rows, hot):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(S, "HOT_LEAST", hot)
    monkeypatch.setattr(S, "CHUNK", 700)  # long texts come in parts
    monkeypatch.setattr(S.repeated_ranges, "__defaults__", (length, block))
    rows = fixture(prose)
    got = sorted(map(tuple, S.remove_repeats(docs(rows), length=length, digest=True).collect()))
    assert got == brute([(d, (t or "").encode()) for d, t in rows], length)


def test_expansion_equals_counting():
    r = np.random.default_rng(0)
    contexts = [bytes(r.integers(97, 100, r.integers(5, 60)).astype(np.uint8)) for _ in range(40)]
    for length in (1, 4, 7, 30):
        long = [c for c in contexts if len(c) >= length]
        seen = Counter(c[i : i + length] for c in long for i in range(len(c) - length + 1))
        want = [[seen[c[i : i + length]] > 1 for i in range(len(c) - length + 1)] for c in long]
        assert [x.tolist() for x in S.repeated_starts(long, length)] == want


def test_equal_strings_have_equal_anchors(prose):
    from plumbline.llm.jaccard_join import Powers

    passage = prose(5, 120)
    texts = [(prose(i, 40) + passage + prose(i + 9, 40)).encode() for i in range(3)]
    c = S.Contexts(texts, Powers(), 200)
    anchor = {}
    for b, n, o, k in zip(c.begin.tolist(), c.count.tolist(), c.offset.tolist(), c.key.tolist()):
        for i in range(n):
            anchor.setdefault(c.data[b + i : b + i + 200], set()).add((k, o - i))
    assert anchor and all(len(a) == 1 for a in anchor.values())


def test_kept_bytes_repeated_rows_and_empty_tables(docs, prose):
    t = prose(1, 60)
    df = docs([(1, t), (1, t), (None, "short"), (2, None)])
    rows = {(str(r.doc_id), bytes(r.kept), r.n_removed, r.n_spans) for r in S.remove_repeats(df).collect()}
    assert rows == {("1", b"", len(t), 1), ("None", b"short", 0, 0), ("2", b"", 0, 0)}
    assert S.remove_repeats(df.limit(0)).collect() == []


def test_texts_longer_than_places(docs):
    """A passage beyond 2 ** 24 bytes of one text meets its copy in a short one."""
    passage = bytes(np.random.default_rng(1).integers(97, 123, 300).astype(np.uint8)).decode()
    filler = bytes(np.random.default_rng(2).integers(97, 123, (1 << 24) + 9000).astype(np.uint8)).decode()
    long = f"{filler[:-4000]}<{passage}>{filler[-4000:]}"
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(docs([(1, long), (2, f"({passage})")]), digest=True).collect()}
    assert got == {1: (len(long), 300, 1), 2: (302, 300, 1)}


def test_anchors_of_parts_under_few_place_bits(prose):
    from plumbline.llm.jaccard_join import Powers

    passage = prose(5, 60)
    texts = [prose(1, 400) + passage + prose(2, 400), passage + prose(3, 20)]
    with pytest.raises(AssertionError):
        S.Contexts([t.encode() for t in texts], Powers(), 200, None, 10)
    anchor, starts = {}, []
    for parts, places in S._batches(texts, 200, 700):
        c = S.Contexts(parts, Powers(), 200, places, 10)
        for x, f, b, n, o, k in zip(c.text.tolist(), c.first.tolist(), c.begin.tolist(), c.count.tolist(), c.offset.tolist(), c.key.tolist()):
            for i in range(n):
                assert c.data[b + i : b + i + 200] == texts[x].encode()[f + i : f + i + 200]
                starts.append((x, f + i))
                anchor.setdefault(c.data[b + i : b + i + 200], set()).add((k, o - i))
    assert sorted(starts) == [(x, i) for x, t in enumerate(texts) for i in range(len(t) - 199)]
    assert all(len(a) == 1 for a in anchor.values())


@pytest.mark.parametrize("hot", [20_000, 4])
def test_equal_contexts_of_a_mixed_anchor_are_shipped_few_times(docs, prose, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_LEAST", hot)
    base = prose(1, 60)
    rows = [(i, base) for i in range(300)] + [(300, base[:200] + "X" + base[201:]), (301, prose(2, 60))]
    df = docs(rows).repartition(3)
    full = np.full(S.BITMAP // 8, 255, dtype=np.uint8)
    shipped = S._bodies(S._rows(df, "doc_id", "text"), full, {}, 200).groupBy("key", "context").agg({"*": "count", "n": "sum"}).collect()
    assert shipped and max(r["count(1)"] for r in shipped) <= 6 and {r["sum(n)"] > 1 for r in shipped} == {True, False}
    got = sorted(map(tuple, S.remove_repeats(df, digest=True).collect()))
    assert got == brute([(d, t.encode()) for d, t in rows], 200)


def test_equal_contexts_are_one_row():
    import pandas as pd

    rows = pd.DataFrame({"key": [1, 1, 1, 2], "salt": 0, "context": [5, 5, 6, 6], "n": [1, 3, 1, 1], "body": [b"a", b"a", b"b", b"b"]})
    assert S._collapsed(rows)[["key", "context", "n"]].to_numpy().tolist() == [[1, 5, 4], [1, 6, 1], [2, 6, 1]]
    assert len(S._collapsed(rows[:0])) == 0
