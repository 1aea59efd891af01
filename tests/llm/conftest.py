import random

import pytest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, v=400):
    return " ".join(rng.choice(["the", "of", "und", "la"]) if rng.random() < 0.3 else f"w{rng.randrange(v)}{rng.choice(['', ',', '.'])}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Clean texts, exact and near copies, shared passages, empty, null and long texts, repeated rows, null ids and sources."""
    rng = random.Random(5)
    base = [words(rng, n) for n in (60, 80, 200, 300, 13, 12, 4, 1)]
    near = base[3].split(" ")
    near[150] = "changed"
    passage = words(rng, 40)
    texts = [*base, base[2], " ".join(near), base[0] + " " + passage, passage + "\n" + base[1], "", None, " \t\n", "é ü ß 漢字   x  y\r\nz <|endoftext|> I'll 12ab", words(rng, 6000, 3000), base[2] + " ", "a b c " * 40]
    out = [(k, t, "en", f"s{k % 4}" if k % 5 else None, None) for k, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, base[1], None, None, 3), (500, base[7], "en", "s1", 1)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)
