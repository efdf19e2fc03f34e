from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls, empty texts, copies, ties and extra columns."""
    rows = [
        (5, "The quick brown fox jumps over the lazy dog again and again", "en", "b", 1), (3, "the QUICK brown fox jumps over the lazy dog again and again", "en", "a", 2),
        (9, None, None, None, 3), (7, "", "de", "a", 4), (8, "...\n\n  ", "de", None, 5), (2, "one", "en", "b", 6), (11, "one", "en", "b", 7), (11, "one", "en", "b", 7),
        (None, "the quick brown fox jumps over the lazy dog", "en", "c", 8), (1, "eine kleine Katze sitzt auf dem Dach und singt ein Lied", "de", "c", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size long")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
