import random
import re

from plumbline.llm import license_scan

BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = words(text)
    hits = [(i, label) for i in range(len(w)) for p, label in BASE.items() if tuple(w[i : i + len(p)]) == p]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_equals_brute_force(docs):
    r = random.Random(5)
    pool = ["MIT", "license", "License", "apache", "general", "public", "the", "limit", "licensé", "emit", "x1", "GNU", "licenses"]
    texts = [None, "", "MIT License", "mit-license", "mit license mit license", "limit license", "Apache License", "MIT licensé", "É mit license É"]
    texts += [r.choice([" ", ", ", "\n", "-", "*"]).join(r.choice(pool) for _ in range(r.randint(0, 60))) for _ in range(150)]
    got = license_scan.summary(license_scan.scan(docs(texts))).collect()
    for row in got:
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == brute(texts[row.doc_id]), texts[row.doc_id]
        assert set(filter(None, row.base_labels.split(","))) <= set(filter(None, row.labels.split(","))) and 0 <= row.score <= 1


def test_fuzzy_notices_with_spans(docs):
    texts = ["Redistribution and use in sorce and binary form are permitted", "Licensed under the Apach Licens, Version 2.0", "a clean text"]
    rows = {r.doc_id: r.spans for r in license_scan.scan(docs(texts)).collect()}
    assert [(s.label, s.first_word, s.edits, s.base) for s in rows[0]] == [("bsd", 0, 2, False)]
    assert rows[0][0].text == "redistribution and use in sorce and binary form" and "apache" in {s.label for s in rows[1]} and rows[2] == []


def test_pieces_cover_the_phrase():
    for notice in license_scan.NOTICES:
        cut = license_scan.pieces(notice.phrase, notice.edits)
        assert len(cut) == notice.edits + 1 and "".join(p for _, p in cut) == notice.phrase


def test_repeated_rows_and_empty_tables(docs):
    df = docs([(1, "mit license " * 2000), (1, "mit license " * 2000), (None, "x")])
    got = license_scan.summary(license_scan.scan(df)).collect()
    assert [r.n_base for r in got if r.doc_id == 1] == [2000, 2000] and len(got) == 3
    assert license_scan.scan(df.limit(0)).collect() == []
