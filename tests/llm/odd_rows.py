"""What the tests of the training-data operators share."""

import pytest

LONG = "a long text of many words, " * 20_000
ODD_TEXTS = [None, "", "   \n ", "one", "one", "two words here", "Two  words here", "under the MIT License\nor the apache license", "<|endoftext|> ü ß   漢字", LONG, LONG + "x"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, a repeated row, and extra columns with clashing names."""
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "web1"][i % 2], len(t or ""), "k", 1) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], (None, "no id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, component_id int")
