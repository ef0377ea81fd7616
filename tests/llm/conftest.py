import pytest

#: Texts of every kind that operators must stand: nulls, empty, blank, ties, repeats, other scripts, long ones.
ODD = [None, "", " ", "\n\n", "a", "one two three", "one two three four five six", "Ünïcode 日本語 text here now ok", "x" * 20_000, "word " * 6_000, "tie tie tie tie tie tie", "one two three four five six"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, with a null doc_id, a repeated row, and columns whose names operators use themselves."""
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 7, 1, "k") for i, t in enumerate(ODD)]
    rows += [(None, "no id at all in this row", "en", "s0", 1, 2, "z"), rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, key string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
