import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.functions import repair, scoring
from lodestone.functions import text as T


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"x{k} string" for k in range(len(values))))
    return df.select(column(*[F.col(f"x{k}") for k in range(len(values))]).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.letters_key, "BART: Denoising Sequence-to-Sequence Pre-training!", "bartdenoisingsequencetosequencepretraining"),
        (T.arxiv_id, "https://arxiv.org/pdf/1706.03762v5.pdf", "1706.03762"),
        (T.arxiv_id, "arXiv:2401.00001v2", "2401.00001"),
        (T.identifier, " https://doi.org/10.1/ABC ", "10.1/abc"),
        (T.identifier, "", None),
        (T.corpus_id, "CorpusId:42", "corpus:42"),
        (T.title_key, "A  Survey, of: X", "a survey of x"),
        (T.title_key, "研究", None),
        (T.first_line, "a\nb", "a"),
        (T.html_title, "<html><TITLE> x y </TITLE>", "x y"),
        (T.url_key, "https://www.Site.org/a/?utm_source=x&b=1#top", "site.org/a/?b=1"),
    ],
)
def test_normalisers(spark, f, text, want):
    assert one(spark, f, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024-03", (2024, 3, 28)), ("20240301", (2024, 3, 1)), ("2024", (2024, 12, 31)), ("2024-3-1", (2024, 3, 1)), ("2024-03-01T10:00:00Z", (2024, 3, 1)), ("soon", None), ("2024-13-45", None)],
)
def test_publication_date(spark, text, want):
    assert one(spark, T.publication_date, text) == (want and datetime.date(*want))


def test_stemming_and_tokens(spark):
    assert one(spark, lambda c: T.stem(c), "faces") == "face"
    assert one(spark, lambda c: T.stem(c), "bodies") == "body"
    assert one(spark, lambda c: T.stem(c), "boxes") == "box"
    assert one(spark, lambda c: T.stem(c), "glass") == "glass"
    assert one(spark, T.query_tokens, "What are the papers on graph graph nets") == ["graph", "graph", "nets"]


def test_gold_titles(spark):
    assert one(spark, T.gold_titles, '["A", " B "]') == ["A", "B"]
    assert one(spark, T.gold_titles, "A; B;") == ["A", "B"]
    assert one(spark, T.gold_titles, "A|B") == ["A", "B"]


def test_abstract_from_positions(spark):
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string,array<int>>")
    assert df.select(T.abstract_from_positions(F.col("m"))).first()[0] == "a b a"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('```json\n{"a": 1,}\n```', '{"a": 1}'),
        ("sure: {'a': 'it''s', 'b': [1, 2}", None),
        ("x {'a': \"q\", 'b': [1, 2,], } y", '{"a": "q", "b": [1, 2]}'),
        ('{"a": "line\nend"', '{"a": "line\\nend"}'),
        ("nothing", None),
        (None, None),
    ],
)
def test_json_repair(text, want):
    assert repair.mended(text) == want or want is None


def test_title_similarity(spark):
    same = one(spark, repair.title_similarity, "deep graph nets", "Deep graph nets")
    other = one(spark, repair.title_similarity, "deep graph nets", "zzz")
    assert same == 1.0 and other < 0.3


def test_scores(spark):
    df = spark.createDataFrame([(0, 2025, None, 0.5)], "c int, y int, n double, t double")
    got = df.select(
        scoring.citation_score(F.col("c")).alias("c"), scoring.recency_score(F.col("y")).alias("y"), scoring.recency_score(F.col("n").cast("int")).alias("u"),
        scoring.prerank_score({"title": F.col("t"), "dense": F.col("n")}).alias("p"), scoring.logistic(F.lit(0.5)).alias("l"),
    ).first()
    assert (got.c, round(got.y, 6), got.u, got.p, got.l) == (0.0, 0.92, 0.4, 0.5, 0.5)
