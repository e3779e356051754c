"""Golden values: matching against gold, strict and relaxed."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.functions.text import title_key
from lodestone.operators import evaluation


def results(spark, rows, strict=False):
    df = spark.createDataFrame(rows, "q int, rank int, paper_id string, doi string, title string")
    keys = evaluation.match_keys([F.col("paper_id"), F.col("doi")], title=F.col("title"), strict=strict)
    return df.select("q", "rank", "paper_id", keys.alias("keys"), title_key(F.col("title")).alias("title"))


def gold(spark, rows, strict=False):
    df = spark.createDataFrame(rows, "q int, gold_id int, doi string, name string")
    keys = evaluation.match_keys([F.col("doi")], title=F.col("name"), strict=strict)
    return df.select("q", "gold_id", keys.alias("keys"), title_key(F.col("name")).alias("title"))


def test_half_of_each(spark):
    got = evaluation.scored_against_gold(results(spark, [(1, 1, "p1", None, "Alpha Study"), (1, 2, "p2", None, "Other")]), gold(spark, [(1, 1, None, "alpha study!"), (1, 2, None, "Gamma")]), "q").first()
    assert (got.true_positive, got.predicted_count, got.gold_count, got.precision, got.recall, got.f1) == (1, 2, 2, 0.5, 0.5, 0.5)


def test_strict_and_relaxed(spark):
    rows = [(1, 1, "p1", None, "Deep Learning for Graphs: a longer title")]
    wanted = [(1, 1, None, "deep learning for graphs")]
    assert evaluation.relaxed_matches(results(spark, rows), gold(spark, wanted), "q", "rank").count() == 1
    assert evaluation.scored_against_gold(results(spark, rows, True), gold(spark, wanted, True), "q").first().true_positive == 0
    swept = evaluation.relaxed_sweep(results(spark, rows), results(spark, rows, True), gold(spark, wanted), gold(spark, wanted, True), "q", (1, 2)).collect()
    assert [(r.k, r.hit, r.relaxed_f1, r.strict_f1) for r in sorted(swept)] == [(1, 1, 0.0, 0.0), (2, 1, 0.0, 0.0)]


def test_hit_at_rank_two(spark):
    rows = [(1, 1, "p1", None, "Nothing"), (1, 2, "p2", "10.1/x", "Anything")]
    got = evaluation.hits_at(results(spark, rows), gold(spark, [(1, 1, "https://doi.org/10.1/X", "Some title")]), "q", (1, 2)).collect()
    assert {r.k: r.hit for r in got} == {1: 0, 2: 1}


def test_gold_items_that_a_result_joins_are_one(spark):
    wanted = gold(spark, [(1, 1, "10.1/a", None), (1, 2, None, "Second name"), (1, 3, "10.1/c", None), (2, 1, "10.1/a", None)])
    found = results(spark, [(1, 1, "p", "10.1/a", "second name"), (1, 2, "p", "10.1/a", "x")])
    rows = {r.q: (r.true_positive, r.predicted_count, r.gold_count) for r in evaluation.scored_against_gold(found, wanted, "q").collect()}
    assert rows == {1: (1, 2, 2), 2: (0, 0, 1)}


def test_selector_errors(spark):
    pool = results(spark, [(1, 1, "a", None, "Gold one"), (1, 2, "b", None, "Noise"), (1, 3, "c", None, "Gold two")])
    chosen = spark.createDataFrame([(1, "a", "low"), (1, "b", "high"), (1, "c", "medium")], "q int, paper_id string, level string")
    got = evaluation.selector_errors(pool, chosen, gold(spark, [(1, 1, None, "gold one"), (1, 2, None, "Gold Two")]), "q").first()
    assert (got.false_positive, got.false_negative) == (1, 1)


@pytest.mark.parametrize(
    ("prior", "level", "local", "signals", "confidence", "want"),
    [(0.9, "medium", 0.2, 2, None, 0.585), (0.3, "medium", 0.9, 2, None, 0.3), (None, "medium", 0.9, 2, None, 0.7075), (0.1, "unknown", 0.9, 3, None, 0.115),
     (0.9, "high", None, 0, None, 0.8913), (0.9, "low", 0.9, 2, None, 0.15), (0.9, "irrelevant", 0.9, 2, None, 0.05), (0.2, "high", 0.0, 2, 1.0, 0.75)],
)
def test_calibration(spark, prior, level, local, signals, confidence, want):
    row = spark.createDataFrame([(prior, level, local, signals, confidence)], "p double, l string, m double, n int, c double")
    assert row.select(S.calibrated(F.col("p"), F.col("l"), F.col("m"), F.col("n"), F.col("c"))).first()[0] == pytest.approx(want, abs=1e-4)


def test_final_recency_and_missing_features(spark):
    row = spark.createDataFrame([(2025, 50)], "year int, citations int")
    parts = S.final_subscores({"year": F.col("year"), "citations": F.col("citations")})
    got = row.select(*[c.alias(n) for n, c in parts.items()]).first()
    assert (got.recency, got.authority, got.source, got.constraint, got.evidence) == (0.9, 0.5, 0.5, 0.5, 0.0)
    score = S.prerank_score({"title": F.lit(2.0), "dense": F.lit(None).cast("double"), "citation": F.lit(0.0)})
    assert row.select(score).first()[0] == pytest.approx(0.18 / 0.26)


def test_evidence_checks(spark):
    row = spark.createDataFrame([("Large foundation models for text", ["retrieval"], ["RETRIEVAL augmented", "x"], ["  Large Foundation", "absent", ""], "low")], "t string, w array<string>, m array<string>, q array<string>, l string")
    met = [S.constraint_met(F.col("t"), F.lit(c)) for c in ("llm", "text foundation", "graph", "")]
    got = row.select(*met, S.plan_coverage(F.col("w"), F.col("m"), F.col("l")), S.evidence_ratio(F.col("q"), F.col("t"))).first()
    assert tuple(got)[:5] == (True, True, False, True, 1.0) and got[5] == pytest.approx(1 / 3)
