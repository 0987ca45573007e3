import random

import pytest

EDGE_ROWS = [
    (1, "plain words stand here and there", "en", "s1", 32),
    (2, None, None, None, None),
    (3, "", "en", "s1", 0),
    (4, " \n\t ", "fr", "s2", 4),
    (5, "plain words stand here and there", "en", "s1", 32),
    (5, "plain words stand here and there", "en", "s1", 32),
    (None, "an orphan text without id", "de", "s2", 25),
    (6, "x" * 5000 + " " + "long text " * 3000, "es", "s3", 35001),
    (7, "日本語 ünïcode 🙂 straße", "de", None, 20),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeats and extra columns whose names clash with inner ones."""
    rows = [(*r, "clash", 0.5, 1) for r in EDGE_ROWS]
    return spark.createDataFrame(rows, SCHEMA + ", digest string, score double, rep int")


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def near_docs(spark):
    """Random texts, copies and near copies of several degrees, and a chain."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 40, 120]))) for _ in range(60)]
    for base in range(0, 40, 2):
        words = texts[base].split()
        for changes in (0, 1, 3, 8, 20):
            copy = list(words)
            for _ in range(min(changes, len(copy))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for _ in range(8):
        chain = chain[3:] + [rng.choice(vocabulary) for _ in range(3)]
        texts.append(" ".join(chain).upper())
    return spark.createDataFrame([(i * 3 + 1, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)], SCHEMA)
