import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as a documents table, with extra columns whose names clash with inner ones."""

    def make(rows, clashing=True):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCUMENTS)
        if clashing:
            for name in ("id", "row", "run", "sha", "norm", "version", "node", "root", "bands", "_id", "_text", "_t", "_c0", "ids", "piece", "seed"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df.repartition(3)

    return make


@pytest.fixture
def words():
    """A seeded source of invented prose."""
    rng = random.Random(7)
    stock = ["".join(rng.choice("abcdeghilmnorstuéß") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def make(n, seed):
        own = random.Random(seed)
        return [own.choice(stock) for _ in range(n)]

    return make
