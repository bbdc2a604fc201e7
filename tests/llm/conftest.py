import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, _id string, _key int, _src string, _row int, pos int"


def words(rng, n, alphabet="abcdehilnorst"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, one hot source."""
    rng = random.Random(7)
    base = [words(rng, 60) for _ in range(6)]
    texts = [None, "", "   \n\t ", "word", "two words", "12 34 !!", "é 日本 😀", "\n".join(base), "\n".join(base), "\n".join(base[:4]) + "\nextra", words(rng, 30_000), "x" * 150_000, "a\n" * 3000, base[0], base[0].upper(), base[1] + " end"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s1", "s1", "s2"][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "no id at all", None, None, 12), (None, None, None, None, None)]
    return [(*r, "clash", 1, "clash", 2, 3) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DDL).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)
