"""run() over a small table with nulls, empty and repeated rows, a map and clashing columns, against plain Python."""

import ctypes
import hashlib
import re
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from plumbline.llm import common, queries, toxicity
from plumbline.llm.queries import byte_bpe_codec


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_run_equals_brute_force(spark, prose, tmp_path):
    import tiktoken  # noqa: F401  the codec's library

    from plumbline.llm import bpe

    clean = [(i, prose(i, 40)) for i in range(1, 99)]
    near = [(100, clean[0][1] + " tail"), (101, clean[1][1] + " more words"), (102, clean[2][1].upper())]
    copies = [(200, clean[3][1]), (4, clean[3][1]), (None, clean[4][1]), (201, clean[5][1].replace(" ", "  "))]
    odd = [(300, None), (301, ""), (None, "  "), (302, "word")]
    bad = [(400 + i, f"{prose(500 + i, 30)} blockhead numskull {prose(700 + i, 5)}") for i in range(60)]
    rows = clean + near + copies + odd + bad
    source = lambda i: None if i is None else f"s{i % 3}"
    full = [(i, t, "en", source(i), len(t or ""), {"k": 1}, "x", "y") for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, meta map<string,int>, _row string, n long"
    df = spark.createDataFrame([(*r[:7], 0) for r in full], schema)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0, 0) for i, _ in clean] + [(i, 0, 1) for i, _ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    # Toxicity's model is learned; the operator's own rows are the ground for the others.
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    first = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, str(tmp_path))
    assert first.columns == docs.columns
    stay = sorted(((r.doc_id, r.text, r.source) for r in first.collect()), key=repr)
    scored = toxicity.score(docs, *queries.toxicity_models(spark, docs, str(tmp_path))).collect()
    assert sorted(repr(r[0]) for r in stay) == sorted(repr(r.doc_id) for r in scored if r.score < 0.3)
    assert not {i for i, *_ in stay} & {i for i, _ in bad} and len({i for i, *_ in stay} & {i for i, _ in clean}) > 80

    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    seen, exact = set(), []
    for r in sorted(stay, key=order):
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if norm not in seen:
            seen.add(norm)
            exact.append(r)
    apart = []
    for r in exact:  # the groups planted here are stars around their smallest id
        s = shingles(r[1])
        if not any(s and t and 100 * len(s & t) >= 80 * len(s | t) for t in (shingles(x[1]) for x in apart)):
            apart.append(r)
    codec = bpe.Codec(*byte_bpe_codec())
    want = {}
    for i, t, _ in apart:
        ids = codec.encode(t or "")
        want[i, hashlib.sha256((t or "").encode()).hexdigest()] = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Mixing repeats or leaves out whole documents; what it leaves is right, and near the sources' targets.
    assert all(want[r.doc_id, r.decoded_sha256] == (r.n_tokens, r.ids_sha256) for r in got)
    sizes = {}
    for i, t, s in apart:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    total, weights = sum(sizes.values()), {s: 1 + n % 3 for n, s in enumerate(sorted(sizes, key=lambda x: (x is None, x)))}
    target, free, left = {}, dict(weights), total
    while free:
        level = left / sum(free.values())
        capped = [s for s, w in free.items() if level * w > 3 * sizes[s]]
        if not capped:
            target |= {s: level * w for s, w in free.items()}
            break
        for s in capped:
            target[s] = 3 * sizes[s]
            left -= target[s]
            del free[s]
    words = {(i, hashlib.sha256((t or "").encode()).hexdigest()): (s, len((t or "").split())) for i, t, s in apart}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s, n = words[r.doc_id, r.decoded_sha256]
        taken[s] += n
    assert all(abs(taken[s] - target[s]) <= 42 for s in sizes), (taken, target)


def test_batches_to_python_are_bounded_in_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for own, expected in [("64m", str(common.BATCH_BYTES)), ("67108864b", str(common.BATCH_BYTES)), ("100k", "100k"), ("2MB", "2MB")]:
            spark.conf.set(name, own)
            common.bound_batches(spark)
            assert spark.conf.get(name) == expected
    finally:
        spark.conf.set(name, before)


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="another C library")
def test_free_memory_goes_back_after_a_batch():
    """A block above keeps the C library from giving back by itself what a batch took."""

    def resident():
        return int(re.search(r"\nRssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    took = [b"x" * 20_000 for _ in range(4000)]
    above, held = took.pop(), resident()
    del took
    assert [len(x) for x in common.slices(pd.DataFrame({"text": ["a", None, "b"]}), size=1)] == [2, 1]
    assert resident() < held - 60 and len(above) == 20_000


def test_blocks_are_compared_in_bounded_memory():
    import tracemalloc

    from plumbline.llm import jaccard_join

    near = [" ".join(f"w{w if w != 7 * i else -i}" for w in range(60)) for i in range(1, 9)]
    texts = [f"{near[i % 8]} z{i}" if i < 64 else " ".join(f"v{i}-{w}" for w in range(20)) for i in range(1024)]
    sets = jaccard_join.shingle_sets(texts)
    tracemalloc.start()
    links = jaccard_join._forest(np.arange(1024), texts, sets, 80)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    similar = lambda a, b: 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
    root = list(range(1024))
    for i in range(64):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    mine = list(range(1024))
    for a, b in links:
        mine = [mine[a] if x == mine[b] else x for x in mine]
    group = lambda r: sorted(sorted(i for i in range(1024) if r[i] == c) for c in set(r))
    assert group(mine) == group(root) and len(links) == 1024 - len(set(root)) > 0
    assert most < 30e6, most


def test_results_of_earlier_stages_go(spark, tmp_path, monkeypatch):
    """One result is on disk when the next stage begins, and the last one stays for what reads it."""
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline.common, "shared_folder", lambda spark: f"{tmp_path}/shared")
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(len(list((tmp_path / "shared").glob("pipeline-*"))))
        return docs.filter(f"doc_id <> {len(seen)}")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{i}", stage) for i in range(4)])
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()
    assert seen == [0, 1, 1, 1] and got == []
