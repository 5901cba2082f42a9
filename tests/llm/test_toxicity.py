import random

import pytest

from plumbline.llm import toxicity as T


@pytest.fixture(scope="module")
def corpus(spark, prose):
    r, rows, labels = random.Random(2), [], []
    for i in range(240):
        words = prose(i, 40).split()
        if toxic := i % 4 == 0:
            for w in r.sample(["blockhead", "numskull", "dimwit"], 2):
                words.insert(r.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def models(corpus):
    df, labels = corpus
    model = T.fit_characters(df)
    return model, T.fit_classifier(df, labels.filter("doc_id % 3 <> 0"), model)


def test_noise_is_read(models):
    r = T.Restorer(models[0])
    for noisy, clean in [("n.u.m.s.k.u.l.l", "numskull"), ("bl0ckh3ad", "blockhead"), ("d i m w i t", "dimwit"), ("diiiimwit", "dimwit"), ("DIMW1T", "dimwit"), ("num_skull", "numskull")]:
        assert r.text(noisy) == clean


SPELLINGS = {
    "numsku11": "numskull", "dimw1+": "dimwit", "numskul1.": "numskull", "dimwi7,": "dimwit", "81ockhead": "blockhead",
    '"8lockhead"': "blockhead", "(d1mw1+)": "dimwit", "d--i--m--w--i--t": "dimwit", "d . i . m . w . i . t": "dimwit",
}


def test_substitutions_at_the_edges_and_runs_of_separators(models, spark, prose):
    r = T.Restorer(models[0])
    assert {s: "".join(T.WORDS.findall(r.text(s))) for s in SPELLINGS} == SPELLINGS
    rows = [(i, f"{prose(910 + i, 12)} {s} {prose(950 + i, 12)}") for i, s in enumerate(SPELLINGS)]
    got = T.score(spark.createDataFrame(rows, "doc_id long, text string"), *models).collect()
    assert {rows[x.doc_id][1] for x in got if not x.predicted} == set()


def test_long_runs_take_linear_time():
    for run in ("_" * 200_000, "$" * 200_000, "0" * 200_000, "!_" * 100_000, "a" + "-" * 200_000):
        assert not T.SPACED.search(run) and not T.SUSPICIOUS.search(run)


def test_clean_text_is_left_alone(models, prose):
    r = T.Restorer(models[0])
    for i in range(20):
        assert r.text(prose(i, 50)) == prose(i, 50)
    assert r.text("") == "" and r.text("price 100 $$$ 3.5 (ok)") == "price 100 $$$ 3.5 (ok)"


def test_viterbi_finds_the_best_path(models):
    import itertools

    model = models[0]
    for stretch in ("d1mw1t", "b10ck", "nu.m5k"):
        cells, best = T.lattice(stretch, False), None
        for path in itertools.product(*cells):
            h, total = 0, sum(c for _, c in path)
            for t, _ in path:
                if t:
                    total, h = total + model.log(h, T.symbol(t)), (h * T.SYMBOLS + T.symbol(t)) % T.SYMBOLS ** (T.ORDER - 1)
            total += model.log(h, 0)
            best = max(best or (total, ""), (total, "".join(t for t, _ in path)))
        assert T.restore(stretch, model, False) == best[1]


def test_held_out_rows_and_obfuscations(corpus, models, spark, prose):
    df, labels = corpus
    got = {r.doc_id: r for r in T.score(df, *models).collect()}
    held = [(r.doc_id, r.toxic) for r in labels.collect() if r.doc_id % 3 == 0]
    assert all(got[d].predicted == t for d, t in held)
    noisy = spark.createDataFrame([(1, prose(900, 30) + " numsku11 d1mwit"), (2, prose(901, 30) + " d-i-m-w-i-t you"), (3, prose(902, 30)), (4, None), (5, "")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in T.score(noisy, *models).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def test_rows_keep_their_columns(docs, models):
    df = docs([(1, "numskull dimwit here"), (2, "fine words"), (2, "fine words"), (None, None)])
    kept = T.clean_rows(df, *models)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "None"]
    assert T.score(df.limit(0), *models).collect() == []


def test_without_labels_nothing_is_toxic(corpus, models):
    df, labels = corpus
    none = T.fit_classifier(df, labels.limit(0), models[0])
    assert {r.predicted for r in T.score(df, models[0], none).collect()} == {0}


def test_long_stretches_are_settled_in_windows(monkeypatch):
    """A stretch decoded in windows has the path it has when read at once."""
    words = T.CharModel(*_grams("you are an idiot and a moron of the worst kind " * 30))
    text = "y0u@re4n1d10t&n0t-a-m0r0n" * 12
    whole = T.restore(text, words, False)
    for window in (1, 7, 50):
        monkeypatch.setattr(T, "WINDOW", window)
        assert T.restore(text, words, False) == whole


def _grams(text):
    import numpy as np

    s = [T.symbol(c) for c in text]
    codes = [sum(v * T.SYMBOLS ** (3 - k) for k, v in enumerate(s[i : i + 4])) for i in range(len(s) - 3)]
    values, counts = np.unique(codes, return_counts=True)
    return values, counts.astype(float)


def test_the_sample_is_bounded_in_rows(docs, spark):
    """An id of very many rows gives one, the same in every order."""
    rows = [(7, f"text {i}") for i in range(10_000)] + [(8, "other"), (9, None)]
    labels = spark.createDataFrame([(7, 1), (8, 0), (8, 1), (9, 0), (None, 1)], "doc_id long, toxic int")
    first = sorted(map(tuple, T.sample_labelled(docs(rows), labels, 1500).collect()))
    assert [(d, t) for d, t, _ in first] == [(7, 1), (8, 1), (9, 0)]
    assert sorted(map(tuple, T.sample_labelled(docs(rows[::-1]).repartition(5), labels, 1500).collect())) == first
