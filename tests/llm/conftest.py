import random

import pytest

from lodestone.llm import store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def english():
    return "the of and a to in is was that for river stone house winter garden morning people light water table letter window market bridge forest".split()


@pytest.fixture(scope="session")
def german():
    return "der die das und zu ein ist war nicht mit fluss stein haus winter garten morgen leute licht wasser tisch brief fenster markt wald".split()


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows,
    and extra columns whose names operators use."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t", None, "a", 3), (4, long, "en", "a", 1), (4, long, "en", "a", 1), (5, "one", "en", "b", 3), (6, "one", "en", "b", 3), (None, "one two three four five", "de", "b", 3), (7, "?! ... --", "en", "a", 2), (8, "Ünïcödé текст 文字列 🙂", "xx", "c", 9)]
    extra = [(*r, 1.0, "x", 5, True, [1], "y") for r in rows]
    return spark.createDataFrame(extra, SCHEMA + ", score double, s string, n int, accepted boolean, bands array<int>, h string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session", autouse=True)
def cleared(spark):
    yield
    store.clear(spark)
