import pytest

#: Texts that every operator must take: none, empty, blank, repeated, very long, non-ASCII, control strings.
EDGE = [None, "", "  \n\t", "one", "a b c", "same text here", "same text here", "ÄÖ ü 日本語 \U0001f600 é", "x " * 30_000, "ſecret K <|im_end|> <\\|", "A" * 5_000]


@pytest.fixture
def edge(spark):
    """EDGE with ids, a repeated row, and further columns whose names operators use inside."""
    rows = [(k, t, "n", k, [1]) for k, t in enumerate(EDGE)]
    return spark.createDataFrame([*rows, rows[5]], "doc_id bigint, text string, id string, n_words int, spans array<int>")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
