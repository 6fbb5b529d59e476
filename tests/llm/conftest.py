import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, score double"

LONG = " ".join(f"word{i % 977} und{i % 31}" for i in range(12_000))

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of green herbs and salt"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (2, PROSE, "en", "a"),
        (None, PROSE + " end", "en", None),
        (3, None, None, "b"),
        (4, "", "en", "b"),
        (5, " \n\t ", "en", None),
        (6, LONG, "en", "b"),
        (7, "!!! ???", "de", ""),
        (None, None, None, None),
        (8, "über straße ÉCOLE niño 中文 \U0001f600 end", "de", "c"),
    ]
    full = [(i, t, lang, s, None, "k", 0, 0.5) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3, F.lit(1)).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
