"""Small tables with what goes wrong: nulls, empty and long texts, copies, clashing names."""

import random

import pytest

WORDS = "the of and to in for on with rate news market price trade bank oil report growth port".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ing(rnd), ","]) for _ in range(n))


def ing(rnd):
    return "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(1, 6)))


def odd_rows():
    base = prose(1, 200)
    near = base.replace("the", "teh", 1)
    return [
        (1, base, "en", "src0", 5),
        (2, base, "en", "src0", 5),
        (3, near, "en", "src1", 5),
        (3, near, "en", "src1", 5),  # a repeated row
        (4, None, None, None, None),
        (5, "", "en", None, 0),
        (6, " \t\n ", None, "src1", 4),
        (7, "Zwei Wörter", "de", "src2", 11),
        (8, "x" * 50_000, "en", "src2", 50_000),
        (9, "1234 !!! 5678 ???", "en", "src2", 17),
        (10, prose(2, 30_000), "en", "src0", None),
        (11, "日本語のテキスト 🙂 \U0010ffff", "ja", "src3", None),
        (12, "first line\n\n  second  line\r\n\tthird <|endoftext|> end", "en", "src3", None),
        (None, "no id here", "en", "src3", None),
        *[(100 + i, prose(100 + i), "en", "src0", None) for i in range(30)],
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """With further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), DOCS)
    for name in ("key", "fp", "score", "ids", "label", "features", "x", "media", "slot", "raw", "block", "id", "th", "a.b", "toxicity score", "node", "root", "rows", "hash", "c0", "judged", "odd`name"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3, "source").persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
