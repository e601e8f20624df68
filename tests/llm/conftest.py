import random

import pytest


@pytest.fixture(scope="session")
def sample():
    """Small documents with copies, near copies, nulls, empty texts and odd characters."""
    rng = random.Random(5)
    words = ["the", "of", "Thon", "ouerst", "née", "straße", "ciónñ", "x1", "!!", "漢字", "a.", "b,"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "a", "er", "on"]) for _ in range(n))
    rows = [(i, text(rng.randrange(1, 120))) for i in range(60)]
    base = text(100).split()
    for i in range(60, 90):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(1000))
        rows.append((i, " ".join(w)))
    rows += [(90, rows[3][1]), (91, rows[3][1].upper()), (92, None), (93, ""), (94, " \n\t "), (95, "one"), (96, "One"), (97, "two words"), (None, rows[4][1]), (98, rows[5][1]), (98, rows[5][1]), (99, "long " * 5000)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, sample):
    rows = [(i, t, ["en", "de", None][k % 3], f"src{k % 12}" if k % 7 else None, len(t or ""), "kept", 7) for k, (i, t) in enumerate(sample)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, key int").coalesce(2).cache()


@pytest.fixture(scope="session")
def empty(spark, documents):
    return spark.createDataFrame([], documents.schema)
