import random

import pytest
from samples import prose

#: Rows with nulls, empty and blank texts, a very long one, other scripts, repeated rows, equal ids, and columns whose names operators use themselves.
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, fp string, score double, key int, block int, row long, tokens string, shard int"


@pytest.fixture(scope="session")
def odd_rows():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "one two", "ÄÖ ñ 日本語 𝔘𝔘", prose(rng, 30), prose(rng, 30), "x" * 200_000, prose(rng, 40_000), "!!!", "same text here again", "same text here again", "same text here again"]
    ids = [1, 2, 3, 4, 5, 6, 7, None, 9, 10, 11, 12, 12, 13]
    return [(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), "s", "f", 0.5, k, k, k, "t", k) for k, (i, t) in enumerate(zip(ids, texts))]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
