import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = " ".join(f"word{k % 977} und{k % 31}" for k in range(20_000))
BASE = " ".join(f"w{k}" for k in range(120))
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog."),
    (1, "The quick  brown fox\njumps over the lazy dog."),
    (2, "The quick brown fox jumps over the lazy dog."),
    (2, "The quick brown fox jumps over the lazy dog."),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r"),
    (None, "A row without an id, seen once."),
    (None, None),
    (6, LONG),
    (7, LONG + " and one more line"),
    (8, BASE),
    (9, BASE.replace("w60 ", "other ")),
    (10, BASE.replace("w30 ", "this ").replace("w90 ", "that ")),
    (11, "one two three"),
    (12, "ONE two three"),
    (13, "Größe naïve 中文 😀 É\u0301 ﬁ <|endoftext|> <|ENDOFTEXT|> \x1c x"),
    (14, "first line\n\nthird line; more, and more! end\n"),
    (15, "  two  spaces   and\ttabs 's 're 123 4.5"),
]
EXTRA = ["kept", "score", "piece", "_row", "hash", "key", "evidence", "batch", "word", "component", "_text", "size", "shard"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns that clash with our names."""
    from pyspark.sql import functions as F

    rows = [(i, t, None, "s", len(t or "")) for i, t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(name) for name in EXTRA])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")
