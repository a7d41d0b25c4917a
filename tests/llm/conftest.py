import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string, slot string, html string"


@pytest.fixture(scope="session")
def words():
    r = random.Random(3)
    return ["".join(r.choice("aeiourstnlkd") for _ in range(r.randint(2, 8))) for _ in range(400)]


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text, lang, source) with the other columns of documents and columns that clash with operators' names."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), "x", "y", "z", "w") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Null, empty, blank, one letter, digits only, long, repeated rows, null id.
ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "x", "en", "b"), (5, "12 34", "de", "b"), (6, "word " * 30_000, "en", "a"), (7, "same text here for all", "en", "a"), (7, "same text here for all", "en", "a"), (None, "a row without an id", "fr", "c")]
