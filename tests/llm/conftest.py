from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside or return.
CLASHING = ["score", "lang_pred", "kept", "n", "pid", "key", "removed", "n_removed", "ids", "rank", "place", "size", "s", "h", "ws", "digest", "cls", "row_key", "_row_key", "found", "label", "comp", "shard", "host", "path", "bins", "quality"]


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and shared ids."""
    rng = random.Random(5)
    base = words(rng, 200)
    long = ". ".join(words(rng, 12) for _ in range(4000))
    near = base.rsplit(" ", 4)[0] + " other end of this text"
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, base.upper(), "de", "b", 2), (3, near, "en", None, None),
        (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, " \t\n\x0b\x0c\r ", None, "c", 7), (7, "one", "en", "a", 3), (8, "one two three four", "en", "a", 3), (9, "one two three four", "fr", "a", 3),
        (10, long, "en", "a", len(long)), (11, long[: len(long) // 2] + " and something else", "en", "a", 9), (None, base, "en", "a", 1), (None, None, None, None, None), (12, "###$$$ " * 30, "en", "a", 5),
        (13, "Zürich größer straße é " * 12, "de", "ü", 8), (14, "日本語 テキスト 12 😀 ́x " * 20, "ja", "日", 8), (15, "a<|endoftext|>b <|startoftext|> c'll", "en", "a", 9), (16, "x" * 5000, "en", "a", 5000), (17, "\x00퟿ nul \x00", "en", "a", 9),
        (-3, "Released under the MIT License. " + base, "en", "a", 1), (18, "line one is here with many words.\n" * 40, "en", "a", 1), (2**62, words(rng, 40), "es", "a", 1), (19, words(rng, 60), "en", "d", 1), (19, words(rng, 61), "en", "d", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    d = spark.createDataFrame(edge_rows, SCHEMA)
    return d.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def small(spark):
    """The documents of the smallest test tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
