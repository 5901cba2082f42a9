import random

import numpy as np
import pytest

from plumbline.llm import language_id as L

SOUNDS = {"aa": ["ka", "lo", "mi"], "bb": ["xur", "vez", "qip"], "cc": ["éta", "öna", "ñu"]}


def text(lang, seed, words=30):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def net():
    pairs = [(text(lang, i), lang) for lang in SOUNDS for i in range(30)]
    return L.train([t for t, _ in pairs], [lang for _, lang in pairs], steps=60)


def test_gradients_by_backpropagation_equal_differences():
    net = L.BiGRU(["a", "b"])
    for name in net.w:
        net.w[name] = net.w[name].astype(np.float64)
    x, y = np.random.default_rng(1).integers(0, 256, (5, 4)), np.array([0, 1, 1, 0])
    _, g = net.gradients(x, y)
    for name, w in net.w.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), w.shape)
        old, step, losses = w[at], 1e-3, []
        for d in (step, -step):
            w[at] = old + d
            losses.append(net.gradients(x, y)[0])
        w[at] = old
        assert abs((losses[0] - losses[1]) / (2 * step) - g[name][at]) < 1e-3 * max(1, abs(g[name][at])), name


def test_held_out_accuracy_and_undefined_texts(docs, net):
    texts = [text(lang, 1000 + i, 8) for i in range(40) for lang in SOUNDS] + [None, "", " 12 !?", "\n"]
    got = {r.doc_id: r for r in L.identify(docs(texts), net).collect()}
    right = sum(got[i].lang_pred == list(SOUNDS)[i % 3] for i in range(120))
    assert right >= 118 and all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in range(120, 124))


def test_windows_side_by_side_equal_each_text_alone(net):
    def alone(t):
        data = L.bytes_of(t)
        total = np.zeros(3)
        for a in range(0, len(data), L.WINDOW):
            lo, b = max(0, a - L.CONTEXT), min(a + L.WINDOW, len(data))
            part = np.frombuffer(data[lo : b + L.CONTEXT], np.uint8).reshape(-1, 1)
            total += np.concatenate(list(net.probabilities(part)))[a - lo : b - lo, :, 0].sum(axis=0)
        return total / len(data)

    texts = [text("aa", 1) + " " + "z" * 700 + " " + text("cc", 2, 200), "k", "xur", "é" * 256, text("bb", 3, 60), *map(str, range(40))]
    assert np.allclose(L.pooled(net, texts), [alone(t) for t in texts], atol=1e-5)


def test_a_position_sees_beyond_its_word_both_ways(net):
    def at(t, position):
        return np.concatenate(list(net.probabilities(np.frombuffer(t.encode(), np.uint8).reshape(-1, 1))))[position, :, 0]

    here = at("kalo xx kalo", 5)
    assert not np.allclose(here, at("xurv xx kalo", 5), atol=1e-4) and not np.allclose(here, at("kalo xx xurv", 5), atol=1e-4)


def test_repeated_and_very_long_texts(docs, net):
    long = " ".join(text("bb", i, 400) for i in range(400))  # about a megabyte
    got = {r.doc_id: r for r in L.identify(docs([long, text("aa", 1), text("aa", 1), text("cc", 1) * 3, long]), net).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["bb", "aa", "aa", "cc", "bb"]
    assert got[0].score == got[4].score and got[1].score == got[2].score


def test_training_rows_are_bounded_and_labelled(docs, spark):
    df = docs([text("aa", i) for i in range(30)], lang="aa").unionByName(docs([None, "x"], lang=None))
    rows = L.training_rows(df, 5).collect()
    assert [r.lang for r in rows] == ["aa"] * 5
    assert all(r.text in {text("aa", i) for i in range(30)} for r in rows)
    hot = docs([(7, f"{text('aa', i)} {i}") for i in range(10_000)] + [(None, "x y"), (None, "z w")], lang="aa")
    assert sorted((r.doc_id is None, r.doc_id) for r in L.training_rows(hot, 5).collect()) == [(False, 7), (True, None)]
    empty = L.fit(df.filter("lang = 'none'"))
    assert {r.lang_pred for r in L.identify(df, empty).collect()} == {"und"}
    assert L.identify(df.limit(0), empty).collect() == []
