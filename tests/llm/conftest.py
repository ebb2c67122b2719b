import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, toxic int, `key` string, fp string, slot string, shard string, start string, score string, n string, u string, media string, round string, rank string, `__text` string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    words = ["alpha", "Béta", "gamma's", "δέλτα", "日本", "x1", "don't", "WE'LL", "idiot", "the", "of", "1,234.5", "😀", "<|endoftext|>"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = "\n".join(prose(30) for _ in range(400))
    texts = [None, "", " ", "\n\n", "a", "A", "a ", "one two", "one two three", "one two three", long, long, long + " end", "z" * 30000, "line\nline\nother", "▁a▁ b", "tab\tand\x0bmore\x00nul", "é ﬁ İ ẞ", "!!! ???", "12 345"]
    texts += [prose(rng.randint(1, 80)) for _ in range(60)]
    texts += [texts[-1], texts[-2] + " more"]
    rows = [(i if i != 3 else None, t, rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "cold", None]), None, rng.choice([0, 1, None]), *["x"] * 12) for i, t in enumerate(texts)]
    rows += [rows[7], rows[8], rows[0], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
