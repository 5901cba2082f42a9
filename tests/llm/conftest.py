import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from texts or (doc_id, text) pairs, with an extra column of a clashing name."""

    def make(rows, source="s", lang="en"):
        full = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        data = [(i, t, lang, source, len(t) if t else 0, -1, "x", "y") for i, t in full]
        return spark.createDataFrame(data, SCHEMA + ", n long, kept string, _row string")

    return make


@pytest.fixture(scope="session")
def prose():
    """Random texts of syllables."""

    def make(seed, words, vocabulary=3000):
        r = random.Random(seed)
        syllables = ["ba", "co", "di", "fu", "ge", "lan", "mor", "nis", "pet", "qua", "ris", "tol", "uve", "xi", "zan"]
        pool = ["".join(r.choice(syllables) for _ in range(1 + i % 4)) for i in range(vocabulary)]
        return " ".join(r.choice(pool) for _ in range(words))

    return make
