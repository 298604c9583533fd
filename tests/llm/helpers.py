"""Fixtures of the operators' tests: a small table of awkward documents and copies, and the driver's smallest tables."""

import random

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"  # `kept` clashes with a result's name


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(random.Random(3).choices(["then", "which", "à", "straße", "no."], k=30_000))
    rows = [
        (1, "a plain text with seven words here", "en", "s", 34, "x"),
        (2, "a plain text with seven words here", None, None, None, None),
        (2, "a plain text with seven words here", None, None, None, None),
        (3, None, None, None, None, None),
        (4, "", "en", "s", 0, "x"),
        (5, " \t\n", "en", "s", 3, "x"),
        (6, "A Plain text  with seven words HERE", "de", "s", 35, "x"),
        (7, long, "fr", "t", len(long), "y"),
        (8, "one two", "en", "t", 7, "y"),
        (None, "a plain text with seven words here", "en", "s", 34, "x"),
        (None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
