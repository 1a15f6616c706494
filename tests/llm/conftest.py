import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use themselves."""
    long = "Some very long text with many words. " * 6000
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta eta theta.", "en", None, 1), (2, "Alpha beta gamma delta epsilon zeta eta theta.", "en", "s", 2), (3, None, None, None, None), (4, "", "en", "s", 0), (5, long, "en", "s", 9),
        (6, "short", "de", "s", 1), (6, "short", "de", "s", 1), (None, "no identifier here at all, none whatever", "fr", "s", 3), (7, "été çà et là   double  spaces\n\n\ttabs ", "fr", "s", 4), (8, "12345 !!! ???", "en", "s", 5), (9, long + "end", "en", "s", 9),
    ]
    return spark.createDataFrame([(*r, 0, "x", 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rank int, id string, score double")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, 0, None), (5, None, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
