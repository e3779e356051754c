import pytest
from pyspark.sql import functions as F

from lodestone.operators import candidates as C

GATE = "query_id string, paper_id string, pos int, level string, relevance double, local double, matched int, validated boolean, year_broken boolean, path array<string>"


def test_rough_score(spark):
    df = spark.createDataFrame([(0.0, ["title_exact", "provider:x"], 0, 2, 0.5, 1.0)], "d double, p array<string>, c int, o int, r double, v double")
    got = df.select(C.rough_score(*[F.col(c) for c in "dpcorv"])).first()[0]
    assert got == pytest.approx(0.5 + 0.02 + 1.0 + 0.2 + 0.325 + 0.35)


def test_evidence_score_is_capped(spark):
    df = spark.createDataFrame([(1.0, 1.0, 9, 9, ["title_exact"], 1.0, 2024, 10**6), (0.0, 0.0, 0, 0, [], 0.0, None, None)], "a double, b double, c int, d int, p array<string>, s double, y int, n int")
    got = [r[0] for r in df.select(C.evidence_score(*[F.col(c) for c in "abcdpsyn"])).collect()]
    assert got == [1.0, 0.0]


def test_shield(spark):
    df = spark.createDataFrame([("q", k, 0.8 if k == 60 else 0.1) for k in range(80)], "q string, pos int, s double")
    got = C.shielded(df, ["q"], "s", k=52).collect()
    assert min(got, key=lambda r: r["rank"]).pos == 60 and {r.pos for r in got} >= set(range(50))


def test_listwise_gate(spark):
    rows = [
        ("q", "h", 0, "high", 0.9, 0.1, 0, True, False, []), ("q", "m", 1, "medium", 0.25, 0.1, 0, True, False, []), ("q", "n", 2, "medium", 0.2, 0.9, 0, True, False, []),
        ("q", "e", 3, "low", 0.0, 0.3, 0, False, False, ["title_exact"]), ("q", "y", 4, "low", 0.0, 0.9, 3, True, True, ["title_exact"]), ("q", "f", 5, "low", 0.0, 0.9, 1, False, False, []), ("q", "g", 6, "low", 0.0, 0.7, 1, True, False, []),
    ]
    df = spark.createDataFrame(rows, GATE)
    assert {(r.paper_id, r.bridge) for r in C.listwise_gate(df, "query_id").collect()} == {("h", False), ("m", False), ("e", True), ("g", True)}
    assert {r.paper_id for r in C.listwise_gate(df, "query_id", most=3).collect()} == {"h", "m", "g"}


def test_staged_selection(spark):
    rows = [("q", k, ["provider:a"] if k % 3 else ["title_like"]) for k in range(30)] + [("q", 30, ["provider:b"])]
    df = spark.createDataFrame(rows, "query_id string, pos int, path array<string>")
    got = {r.pos: (r.stage, r.place) for r in C.staged_selection(df, "query_id", 14).collect()}
    assert len(got) == 14 and [p for p, (s, _) in got.items() if s == 1] and all(k % 3 == 0 for k, (s, _) in got.items() if s == 1)
    assert got[1] == (2, 11) and got[30] == (2, 12) and got[2] == (2, 13)


def test_phase_recall(spark):
    gold = spark.createDataFrame([("q", 1), ("q", 2)], "q string, d int")
    got = C.phase_recall(gold, {"pool": gold, "final": gold.filter("d = 1")}, "q", "d").first()
    assert (got.gold, got.pool_recall, got.final_hits, got.final_recall) == (2, 1.0, 1, 0.5)


def test_breaker(spark):
    kinds = ["error", "success", "success", "error", "error", "error", "error", "error", "success"]
    rows = [("p", k, kind) for k, kind in enumerate(kinds)] + [("d", 0, "permanent"), ("d", 1, "success"), ("t", 0, "timeout"), ("t", 1, "timeout"), ("t", 2, "timeout")]
    got = {(r.p, r.k): (r.errors, r.open) for r in C.breaker(spark.createDataFrame(rows, "p string, k int, kind string"), "p", ["k"], "kind").collect()}
    assert got["p", 2] == (0, False) and got["p", 6] == (4, False) and got["p", 7] == (5, True) and got["p", 8] == (4, True)
    assert got["d", 1][1] and not got["t", 1][1] and got["t", 2][1]
