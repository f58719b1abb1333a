from __future__ import annotations

import random

import pytest

#: Names that operators use for columns of their own.
CLASHING = ("row", "id", "rank", "key", "h", "digest", "tokens", "domain", "epoch", "score", "votes", "kept", "spans")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, count: int) -> str:
    syllables = ("the", "an", "in", "er", "on", "re", "st", "ou", "ti", "ly")
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(count))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, other scripts."""
    rng = random.Random(5)
    base = words(rng, 60)
    near = base.rsplit(" ", 1)[0] + " end"
    long = words(rng, 30_000)
    rows = [
        (1, base, "en", "src0", 1), (2, base.upper(), "en", "src1", 2), (3, near, "en", "src0", 3),
        (4, None, None, None, None), (5, "", "en", "src2", 0), (6, " \n\t ", "de", "src2", 4),
        (7, long, "en", "src3", 5), (8, long + " tail", "en", "src3", 6), (9, "Übergröße ÄÖ é ñ", "de", None, 7),
        (9, "Übergröße ÄÖ é ñ", "de", None, 7), (9, "another text with the same id", "de", "src4", 8),
        (None, base, "en", "src5", 9), (None, "no id at all", None, "src5", 10), (10, "12 34 56", "en", "src0", 11),
        (11, "日本語のテキスト", None, "src0", 12), (12, "x", "en", "src0", 13),
    ]
    rows += [(100 + i, f"{base}\n{words(rng, 40)}\n{words(rng, 8)}", "en", f"src{i % 12}", i) for i in range(12)]
    rows += [(200 + i, words(rng, 50), "de", f"src{i % 12}", i) for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows with more columns, several files, and a stored order."""
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    for name in CLASHING:
        docs = docs.selectExpr("*", f"'x' as {name}")
    return docs


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
