import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, kept int, rank int, key string, node string"


def words(rng, n):
    return " ".join("".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edge_rows():
    """Nulls in every column, empty, blank, short and very long texts, copies, near copies, repeated rows, odd characters."""
    rng = random.Random(5)
    base, long = words(rng, 120), words(rng, 30_000)
    near = base.split()
    near[60] = "changed"
    passage = words(rng, 60)
    texts = [None, "", " \n\t", "word", "Four words are here", base, base, base.upper(), " ".join(near), long, f"{words(rng, 40)} {passage} {words(rng, 40)}", f"{words(rng, 50)} {passage}", "é ß 日本語 \U0001f600 \x00 end", "ab " * 400, "x" * 5000, "Released under the MIT License"]
    rows = [(k, t, (None, "en", "de")[k % 3], (None, "s1", "s2", "s3")[k % 4], None, 7, "r", 1, 2, "k", "n") for k, t in enumerate(texts)]
    rows += [rows[5], rows[9], (None, base, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
