import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(n: int, seed: int = 0) -> str:
    vowels, stops = "aeiou", "bdfgklmnprst"
    out = []
    for i in range(n):
        k = (i * 7919 + seed * 104729) % 9973
        out.append("".join(stops[(k >> s) % 12] + vowels[(k >> s) % 5] for s in range(1 + k % 3)))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows, and columns that clash with the operators' own."""
    base = sentence(60)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base.replace("a", "e", 1), "en", "b"), (4, None, "en", "b"), (5, "", "fr", None),
        (6, " \t\n ", None, "b"), (7, "one", "en", ""), (None, base, None, None), (None, None, None, None), (8, sentence(6000, 3), "de", "c"), (9, "é🙂　x\u0000y <|endoftext|> z  \n\n ", "es", "c"),
        (10, "same line here\n" * 50, "en", "a"), (11, "Mixed CASE words " * 9, "en", "c"), (12, base + " more words", "en", "b"), (13, sentence(80, 5), "en", "a"), (-4, sentence(90, 6), "en", "a"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    clash = ("score", "size", "key", "id", "component", "held", "lang_", "kept", "y", "words", "target", "finish", "start", "length", "row", "n")
    return df.select("*", *[F.lit("x").alias(c) for c in clash]).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labelled(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 1, 0), (3, None, 1), (None, 0, 1), (10, 0, 1), (11, 0, None), (99, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(labelled):
    return labelled.limit(0)


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
