import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, kept string, t string"


def words(rng, n, size=40):
    return " ".join(rng.choice([f"w{k}" for k in range(size)] + ["the", "of", "a", "é", "ñandú"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, repeats, nulls, empties, white space of all kinds, a very long one; columns whose names operators use themselves."""
    rng = random.Random(7)
    base = [words(rng, rng.randint(30, 120), 400) for _ in range(12)]
    texts = [None, "", " ", "\n\t\x0b\x0c\r", "one", "two words", "a b c d e a b c d e", "x " * 300, "### $$$ %%% & | <> *", "NBSP here and there", "▁ mark ▁▁", "same line\nsame line\n\nsame line\n  \n"]
    for k in range(60):
        b = rng.choice(base)
        kind = rng.random()
        if kind < 0.3:
            t = b
        elif kind < 0.6:
            w = b.split(" ")
            w[rng.randrange(len(w))] = f"edit{k}"
            t = " ".join(w)
        elif kind < 0.8:
            t = words(rng, rng.randint(1, 60), 300) + "\n" + b[: rng.randint(50, 200)]
        else:
            t = words(rng, rng.randint(1, 200), 300)
        texts.append(t)
    texts.append(words(rng, 20_000, 5_000))
    out = [(k * 3 % 211, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s10", None, "s1", "s1"]), None if t is None else len(t), "x", "y", None, "z") for k, t in enumerate(texts)]
    return [*out, out[20], out[20]]  # rows alike


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
