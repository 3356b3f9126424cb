"""Documents of the edge cases that every operator takes."""

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null id, null and empty texts, repeated rows and ids, ties, a very long text, and clashing column names."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta\nshared line of text here", "x", 1, 5),
        (2, "SHARED line of text here  \nalone in its document today", "x", 1, 5),
        (2, "SHARED line of text here  \nalone in its document today", "x", 1, 5),
        (3, None, None, None, None),
        (4, "", "x", 1, 5),
        (None, "shared line of text here\nonly the null id has this one", "x", 1, 5),
        (5, long, "x", 1, 5),
        (6, long + " tail", "x", 1, 5),
        (7, "the end \t\n \n", "x", 1, 5),
        (8, "éàü ñ 漢字 🎉 <|endoftext|> \r\n  two  spaces", "x", 1, 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, owner string, part long, gone long")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
