import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, shard string, part string"


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows():
    """Nulls, empty and blank texts, a very long one, ties, copies, a repeated row, other scripts; further columns with clashing names."""
    rng = random.Random(4)
    texts = [None, "", "   \n\t ", "one", "Two words", "日本語の 文章 です", "123 456 !!!", words(rng, 40_000), "The MIT License applies", "under the GNU General Public License, CC BY"]
    base = words(rng, 120)
    texts += [base] * 5 + [base + " " + w for w in ("x", "yy")] + [words(rng, rng.randint(1, 300)) for _ in range(40)]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "ü"][i % 4], -1, 7, "fp", "s", "p") for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], rows[0]] + [(None, "no id at all", "en", "a", 1, 1, "", "", "")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
