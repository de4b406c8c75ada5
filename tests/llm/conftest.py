import random

import pytest


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, white, repeated, tied, near-equal and very long texts."""
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7))) for _ in range(400)]
    base = [rnd.choice(vocab) for _ in range(300)]
    near = list(base)
    near[150] = "changed"
    long = [rnd.choice(vocab) for _ in range(30_000)]
    texts = [None, "", " \t\n", "one", "one two", "one two", "é ñ ç  x y \x1c z", "A" * 5000, " ".join(base), " ".join(base), " ".join(near), " ".join(long), "x".join(" " * 3 + "\n" * 3), "<|endoftext|> a", "a \n b   c"]
    texts += [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, "no id"), (3, "one"), (5000, " ".join(base[40:120]))]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    rows = [(i, t, "en", "s1", 1, 2, "x", "y", 0) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, payload string, component string, part int").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
