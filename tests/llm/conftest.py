import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with nulls, empty and blank texts, copies, ties, repeated rows and clashing extra columns."""
    base = "the quick brown fox jumps over the lazy dog and runs into the wide green forest near the old river"
    rows = [
        (0, base, "en", "a"), (1, base + " today", "en", "a"), (2, base, "en", "b"), (3, None, None, None), (4, "", "en", "a"),
        (5, " \n\t ", "de", "b"), (6, "der schnelle braune Fuchs springt über den faulen Hund und läuft in den Wald", "de", "b"),
        (7, "x " * 4000, "en", "c"), (8, "word", None, "c"), (8, "word", None, "c"), (9, "é", "fr", None), (None, "no id here at all", "en", "a"),
        (10, "Licensed under the Apache License, Version 2.0.\nsame line\nsame line\n" + base, "en", "a"), (11, "123 <|endoftext|> 456 !!", "en", "d"),
    ]
    rows = [(*r, 7, 1.5, "x", 3) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, score double, kept string, size long")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
