import pytest

ODD = [
    (None, "a row without id"),
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one two three four five six"),
    (4, "one two three four five six"),
    (5, "x" * 3000),
    (6, "word " * 5000),
    (7, "naïve Ünïcode 𝔘𝔫𝔦 日本語 text here <|endoftext|> end"),
]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en", None if i == 2 else "s", 1, "q", 5, 6, 7) for i, t in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, row int, `n.x` int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def empty(odd):
    return odd.limit(0)
