import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls, empty and long texts, repeats, and extra columns with the operators' own names."""
    long = " ".join(f"w{i % 977} the of" for i in range(40_000))
    rows = [
        (1, None, None, "a"), (2, "", "en", None), (3, "   \n\t ", "en", "a"), (4, long, "en", "a"), (5, "the cat sat on the mat and it was a good day for all of us", "en", "x"),
        (6, "the cat sat on the mat and it was a good day for all of us", "en", "x"), (6, "the cat sat on the mat and it was a good day for all of us", "en", "x"),
        (None, "a text without an id but with some words in it", "en", None), (8, "12345 !!! 678", None, "x"), (9, "日本語 \U0001f600 ñandú", "xx", "x"), (-3, "le chat est sur la table et il dort dans la maison", "fr", "y"),
    ]
    return spark.createDataFrame([(*r, 1, "z", 0.5, "k", [1]) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars int, digest string, score double, part string, spans array<int>")
