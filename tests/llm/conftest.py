import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, ids=None, extra=""):
        ids = list(range(len(texts))) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    return lambda n, seed: [random.Random(seed * 7919 + k).choice(vocabulary) for k in range(n)]


#: Texts that every operator must bear.
ODD = [None, "", " ", "\n\n\n", "x", "a b c", "é" * 5, " ", "😀 ok", "a\nb\nc\na\nb\nc", "word " * 30_000, "z" * 50_000]


@pytest.fixture(scope="session")
def odd():
    return ODD
