import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import bpe
from plumbline.llm.queries import byte_bpe_codec

TEXTS = [None, "", " ", "Hello world", "a" * 3000, "ab" * 2500 + "c", " " * 2000 + "x", "x" + "\n" * 999, "don't we'll 'tis", "<|endoftext|>" * 300 + "tail",
         "é" * 1500 + "漢字" * 700, "123456789" * 300, "!?." * 800, "the quick brown fox " * 200, "🙂👍🏽" * 300, "﻿  mixed   spaces \t\t x", "\x00\x01" * 100]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation(), t.no_padding()
    return t


def random_text(seed):
    r = random.Random(seed)
    parts = ["the", " of", "ing", "'s", "'", " ", "  ", "\n", "é", "漢", "7", "42", "##", "zzzz", "aaaaaaa", "<|endoftext|>", "🙂"]
    return "".join(r.choice(parts) for _ in range(r.randint(50, 900)))


def test_like_the_library(docs, library):
    texts = TEXTS + [random_text(i) for i in range(60)]
    for leaf in (64, 16_384):  # with small leaves almost every text is a tree
        got = {r.doc_id: r for r in bpe.round_trip_digest(docs(texts), byte_bpe_codec(), leaf).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            ids = library.encode(t or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, (leaf, i, t)


def test_joins_are_exact_at_every_cut(library):
    codec = bpe.Codec(*byte_bpe_codec())
    for text in [random_text(1)[:160], "antidisestablishmentarianism" * 4, "a" * 77, "naïve café 漢字" * 6]:
        want = library.encode(text, add_special_tokens=False).ids
        for at in range(1, len(text)):
            if not any(at - 13 < text.find("<|endoftext|>", max(0, at - 12)) < at for _ in (0,)):
                assert codec.join(codec.encode(text[:at]), codec.encode(text[at:]), 2).tolist() == want, (text, at)


def test_round_trip_and_repeated_rows(docs):
    df = docs([(1, "some text " * 50), (1, "some text " * 50), (None, "x"), (3, None)])
    ids = bpe.encode(df, byte_bpe_codec(), 32)
    back = sorted((r.doc_id is None, r.doc_id, r.text) for r in bpe.decode(ids, byte_bpe_codec()).collect())
    assert back == [(False, 1, "some text " * 50)] * 2 + [(False, 3, ""), (True, None, "x")]
    assert bpe.encode(df.limit(0), byte_bpe_codec()).collect() == []


def test_ids_beside_a_null_and_rows_in_slices(docs, monkeypatch):
    """A null doc_id in a batch leaves the others' last digits alone; slices change nothing."""
    big = (1 << 62) + 7
    df = docs([(big, "some text " * 9), (None, "x"), (2, "")])
    want = sorted(map(repr, bpe.round_trip_digest(df, byte_bpe_codec(), 32).collect()))
    assert any(f"doc_id={big}" in w for w in want)
    monkeypatch.setattr(bpe, "SLICE", 5)
    assert sorted(map(repr, bpe.round_trip_digest(df, byte_bpe_codec(), 32).collect())) == want
