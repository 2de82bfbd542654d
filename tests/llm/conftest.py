import random

import pytest

SCHEMA = "doc_id long, text string, lang string, score double, node long, rank int, row long, slot int"


def frame(spark, rows):
    """(id, text) rows as a table whose other columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 0.5, 1, 2, 3, 4) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "Épsilon", "zeta"]
    long = " ".join(rng.choices(words, k=30_000))
    return [(1, "Alpha beta gamma delta epsilon."), (1, "Alpha beta gamma delta epsilon."), (2, None), (3, ""), (4, " \t\n "), (None, "alpha beta"), (5, long), (6, "alpha beta"), (7, "日本 é <|endoftext|> x"), (8, "!!! ??? 123")]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return frame(spark, edge_rows).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [(1, "x")]).limit(0)
