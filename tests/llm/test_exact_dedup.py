import hashlib
import re

from plumbline.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (d, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(d)
    return sorted((d, min(groups[t]), len(groups[t]), d == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (d, _), t in zip(rows, norm))


def test_groups_equal_brute_force(docs, prose):
    base = [prose(i, 80) for i in range(30)]
    texts = base + [b.replace(" ", "\n  ") for b in base[:10]] + [base[0]] * 40 + [None, "", " ", "\t\n", base[3][:-1] + "!", base[3] + " tail"]
    rows = list(enumerate(texts))
    got = exact_dedup.exact_groups(docs(rows), digest_all=True).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_without_digest_only_survivors_are_hashed(docs, prose):
    rows = list(enumerate([prose(1, 50), prose(2, 60), prose(1, 50)]))
    got = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_groups(docs(rows)).collect()}
    assert got[0] == got[2] is not None and got[1] is None


def test_repeated_rows_null_ids_and_empty_tables(docs):
    rows = [(1, "same"), (1, "same"), (None, "same"), (5, "same"), (None, "alone")]
    got = exact_dedup.exact_groups(docs(rows)).collect()
    assert sum(r.kept for r in got if r.group_size == 4) == 1 and {r.keep_id for r in got if r.group_size == 4} == {1}
    assert [r.kept for r in got if r.group_size == 1] == [True]
    assert exact_dedup.exact_groups(docs(rows).limit(0)).collect() == []
    assert exact_dedup.drop_exact(docs(rows).limit(0)).collect() == []


def test_kept_rows_keep_their_columns(docs):
    df = docs([(1, "a  b"), (0, "a b"), (2, "c"), (1, "a b"), (3, None), (4, "")])
    kept = exact_dedup.drop_exact(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, "a b"), (2, "c"), (3, None)]


def test_map_columns_and_large_groups(spark, monkeypatch):
    from plumbline.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rows = [(i, "a  b" if i % 2 else f"t{i}", {"k": i}, "x") for i in range(20, 0, -1)] + [(None, "a b", None, "y"), (1, "a b", {}, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, meta map<string,int>, _row string")
    kept = exact_dedup.drop_exact(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, *range(2, 21, 2)]
    groups = exact_dedup.exact_groups(df).collect()
    assert sum(r.kept for r in groups) == 11 and {(r.keep_id, r.group_size) for r in groups if r.group_size > 1} == {(1, 12)}
