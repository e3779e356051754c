import pytest
from pyspark.sql import functions as F

from lodestone.operators import cutoffs, evaluation, graphs, resolve, search, selection, usage


def ranked(spark, scores, kind="unknown"):
    rows = [("q", k + 1, float(s), kind) for k, s in enumerate(scores)]
    return spark.createDataFrame(rows, "q string, rank long, p double, query_type string")


def f_beta(ps, beta):
    best, at, total = -1.0, 0, sum(ps)
    for k in range(1, len(ps) + 1):
        f = (1 + beta**2) * sum(ps[:k]) / (k + beta**2 * total)
        if f > best + 1e-12:
            best, at = f, k
    return at


@pytest.mark.parametrize("ps", [[0.9, 0.8, 0.1], [0.95, 0.7, 0.55, 0.41], [0.2], [0.5] * 6, [0.9, 0.1, 0.9, 0.1]])
def test_f_beta(spark, ps):
    for beta in (1.0, 1.5):
        assert cutoffs.f_beta_cutoff(ranked(spark, ps), "q", "p", beta).first().k == f_beta(ps, beta)


def test_expected_f1_golden(spark):
    got = cutoffs.expected_f1(ranked(spark, [0.95, 0.70, 0.55, 0.41], "specific_paper"), "q", "p").first()
    assert got.k == 3  # 0.41 is under the least probability of its type, 0.45


def test_score_gap(spark):
    assert cutoffs.score_gap(ranked(spark, [0.9, 0.88, 0.5, 0.49]), "q", "p").first().k == 2
    assert cutoffs.score_gap(ranked(spark, [0.9, 0.89, 0.88]), "q", "p").first().k is None
    assert cutoffs.score_gap(ranked(spark, [0.9]), "q", "p").first().k == 1


def test_percentile_drop(spark):
    assert cutoffs.percentile_drop(ranked(spark, [0.9, 0.89, 0.88, 0.4, 0.39]), "q", "p").first().k == 3
    assert cutoffs.percentile_drop(ranked(spark, [0.0, 0.0]), "q", "p").first().k == 1


def test_dynamic_k(spark):
    assert cutoffs.dynamic_k(ranked(spark, [0.9, 0.6, 0.5], "exact_title"), "q", "p", "query_type").first().k == 1
    assert cutoffs.dynamic_k(ranked(spark, [0.9, 0.85, 0.5], "specific_paper"), "q", "p", "query_type").first().k == 2
    assert cutoffs.dynamic_k(ranked(spark, [0.3] * 9), "q", "p", "query_type").first().k == 5
    assert cutoffs.dynamic_k(ranked(spark, [0.5] * 30), "q", "p", "query_type").first().k == 12


def test_diagnosis(spark):
    rows = [(0, 3, 0.5, 1.0, 2, False), (3, 4, 0.01, 1.0, 2, False), (8, 2, 0.5, 1.0, 9, False), (2, 9, 0.5, 5.0, 2, False), (2, 9, 0.5, 5.0, 2, True)]
    df = spark.createDataFrame(rows, "oracle_k int, dynamic_k int, gap double, g_hat double, gold_count int, uniform boolean")
    assert [r.diagnosis for r in cutoffs.k_diagnosis(df).collect()] == ["ranking_failure", "good_match", "g_hat_underestimate_failure", "over_output", "probability_calibration_failure"]


def test_metrics(spark):
    gold = spark.createDataFrame([("q", 1), ("q", 2), ("r", 9)], "q string, d long")
    found = spark.createDataFrame([("q", 7, 1), ("q", 1, 2)], "q string, d long, rank long")
    got = {(r.q, r.k): r for r in evaluation.at_k(found, gold, "q", "d", (1, 2)).collect()}
    assert (got["q", 1].hit, got["q", 2].hit, got["q", 2].precision, got["q", 2].recall, got["q", 2].f1) == (0, 1, 0.5, 0.5, 0.5)
    assert (got["r", 2].predicted, got["r", 2].recall) == (0, 0.0)


def test_greedy_score(spark):
    schema = "case string, pos long, keys array<string>"
    gold = spark.createDataFrame([("c", 1, ["a"]), ("c", 2, ["b"]), ("c", 3, ["a"])], schema)
    papers = spark.createDataFrame([("c", 1, ["a", "x"]), ("c", 2, ["b"]), ("c", 3, ["z"]), ("c", 4, ["A"]), ("c", 5, ["x"])], schema)
    got = resolve.greedy_score(papers, gold, "case", "pos").first()
    assert (got.true_positive, got.false_positive, got.false_negative, got.recall) == (2, 2, 0, 1.0)
    empty = resolve.greedy_score(papers, gold.limit(0), "case", "pos").first()
    assert (empty.true_positive, empty.false_positive, empty.precision) == (0, 0, 0.0)


def test_resolve_entities(spark):
    rows = spark.createDataFrame([(1, "d1", None), (2, "d1", "a1"), (3, None, "a1"), (4, "d4", None), (5, None, None)], "pos long, doi string, arxiv string")
    got = {r.pos: r.entity for r in resolve.resolve_entities(rows, ["doi", "arxiv"], "pos").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_merged(spark):
    rows = spark.createDataFrame([("k", 1, None, 3, ["x"]), ("k", 2, "abs", 9, ["y", "x"])], "k string, pos long, abstract string, cited int, path array<string>")
    got = resolve.merged(rows, F.col("k"), "pos", ["abstract"], ["cited"], ["path"]).first()
    assert (got.pos, got.abstract, got.cited, got.path, got.merged) == (1, "abs", 9, ["x", "y"], 2)


def test_components_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in resolve.components(edges).collect()}
    assert all(got[k] == 1 for k in range(1, 61)) and got[101] == 100


def test_rrf_keeps_zero_based_ranks(spark):
    lists = spark.createDataFrame([("q", "a", 0, 1.0), ("q", "a", 2, 1.5), ("q", "b", 0, 1.5)], "q string, d string, rank long, weight double")
    got = {r.d: r.score for r in search.reciprocal_rank_fusion(lists, ["q"], "d").collect()}
    assert got == {"a": pytest.approx(1 / 60 + 1.5 / 62), "b": pytest.approx(1.5 / 60)}


def test_posting_guard(spark):
    docs = spark.createDataFrame([(1, "Common alpha"), (2, "Common beta"), (3, "Common Rare Signal")], "d long, title string")
    asked = spark.createDataFrame([("q", "common rare")], "q string, text string")
    got = search.title_scores(docs, asked, "d", "title", "q", "text", most_postings=2).collect()
    assert [r.d for r in got] == [3]


def test_round_robin_and_noise(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "b string, d long")
    assert [r.d for r in selection.round_robin(rows, "b", ["d"], 3).orderBy("place").collect()] == [1, 3, 2]
    pool = spark.createDataFrame([(1, k, k) for k in range(10)], "q int, c long, d long")
    assert selection.noise_dropped(pool, ["q"], F.col("d") < 5, "c", "d").count() == 8


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, "reference", 1), (1, 3, "reference", 2), (2, 9, "reference", 1), (1, 1, "reference", 3)], "source long, target long, route string, position long")
    nodes = spark.createDataFrame([(1,), (2,), (5,)], "node long")
    assert [tuple(r) for r in graphs.induced(edges, nodes).collect()] == [(1, 2)]
    assert {r.node: r.prior for r in graphs.link_prior(nodes, edges).collect()} == {1: 1.0, 2: 1.0, 5: 0.0}
    assert graphs.expand(nodes.withColumnRenamed("node", "seed"), edges, 1).count() == 2
    assert graphs.circular_layout(nodes, "node").count() == 3


def test_usage(spark):
    df = spark.createDataFrame([("retrieval.evidence", 1.0), ("planning", 2.0)], "component string, v double")
    assert sorted(r.stage for r in usage.stages(df, "component").collect()) == ["evidence", "other", "retrieval"]
    assert df.select(usage.progress(F.lit(10), F.lit(50), F.lit(5.0), F.lit(10.0), F.lit(0))).first()[0] == 30


def test_uniform_low_probabilities_are_capped(spark):
    assert cutoffs.expected_f1(ranked(spark, [0.3] * 15), "q", "p").first().k <= 5
    assert cutoffs.expected_f1(ranked(spark, [0.3] * 15, "survey"), "q", "p").first().k <= 10
