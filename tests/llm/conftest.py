import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, kept string, key string"


def make_rows():
    """Texts with copies, near copies, repeats, odd white space, nulls, empties and one very long text."""
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "delta", "eps", "zeta7", "éta", "θ", "don't", "x1y2", "<|endoftext|>", "#%$", "Kappa lambda"]
    texts = [None, "", " ", "\n\n", "one", "one two", "ONE two", "one  two\n", "a\tb\x0bc", "é", "é"]
    for _ in range(25):
        texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(3, 90))).replace(" eps ", "\n"))
    base = [f"w{rng.randint(0, 400)}" for _ in range(400)]
    texts += [" ".join(base), " ".join(base), "  ".join(base) + "\n"]
    for at in (7, 120, 390):
        near = list(base)
        near[at] = "changed"
        texts.append(" ".join(near))
    passage = "\n".join(" ".join(f"p{i}q{j}" for j in range(30)) for i in range(3))
    texts += [f"own line {k} here\n{passage}\nend {k}" for k in range(4)]
    texts.append(" ".join(f"long{i % 997}" for i in range(60_000)))
    texts.append("password = hunter2hunter AKIA" + "A1B2" * 5 + " 0123456789abcdef01234567 token: abc secret=token: abcdefgh")
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s1", "s2", None][i % 4], len(t or ""), 1, "x", "y") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
