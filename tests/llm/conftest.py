import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> list[str]:
    """``n`` words that other seeds hardly share."""
    r = random.Random(seed)
    return ["".join(r.choice("bcdfgklmnprstv") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, white space of all kinds."""
    long = " ".join(prose(1, 30_000))
    return [
        (1, "One two three one two three", "en", "a", 27),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (4, " \t\n\x0b\f\r ", "fr", "b", 7),
        (5, long, "en", "a", len(long)),
        (6, "ÀÉ ñandú ΑΣ 数字 👩‍👩‍👧 x y", "es", None, 20),
        (6, "ÀÉ ñandú ΑΣ 数字 👩‍👩‍👧 x y", "es", None, 20),
        (None, "no id here at all", None, "c", 17),
        (7, "a\nb\na\n\n b\na", "en", "a", 10),
        (8, "1234 %%%", "de", "b", 8),
        (9, "aaaa" * 5000, "de", "b", 20_000),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with the names that operators use inside."""
    from pyspark.sql import functions as F

    names = "key spans row component rep bands text_ words ratio kept score lang_pred block start length h n c bucket".split()
    return odd.withColumns({n: F.lit("x") for n in names})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
