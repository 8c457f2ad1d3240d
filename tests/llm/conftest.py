import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    def make(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["src0"] * len(texts) if sources is None else sources
        return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)], DOCS)

    return make


@pytest.fixture
def clashing(spark):
    """A column that is called like a result."""
    return lambda df, name: df.selectExpr("*", f"'x' AS {name}")


@pytest.fixture
def words():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    return lambda n, seed: [random.Random(seed * 1000 + i).choice(vocabulary) for i in range(n)]
