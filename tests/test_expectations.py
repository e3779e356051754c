"""Tables of expected values, written from the rules themselves: scores, gates, stages, noise, budgets and health."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators import candidates, pools, selection, usage
from lodestone.streaming import health

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def column_of(spark, rows, schema, made):
    names = [c.split()[0] for c in schema.split(", ")]
    return [r[0] for r in spark.createDataFrame(rows, schema).select(made(*map(F.col, names))).collect()]


LEVELS = [  # level, failed, earlier notes, year noted, evidence, coverage, has constraints, fallback -> level
    ("high", 0, 0, False, 1.0, 1.0, True, False, "high"), ("high", 1, 0, False, 1.0, 1.0, True, False, "medium"), ("medium", 1, 0, False, 1.0, 1.0, True, False, "low"),
    ("low", 1, 0, False, 1.0, 1.0, True, False, "irrelevant"), ("irrelevant", 1, 0, False, 1.0, 1.0, True, False, "irrelevant"), ("high", 2, 0, False, 1.0, 1.0, True, False, "low"),
    ("irrelevant", 2, 0, False, 1.0, 1.0, True, False, "low"), ("high", 1, 1, False, 1.0, 1.0, True, False, "low"), ("high", 0, 3, True, 1.0, 1.0, True, False, "high"),
    ("high", 1, 0, True, 1.0, 1.0, True, False, "low"), ("high", 0, 0, False, 0.4, 1.0, True, False, "medium"), ("high", 0, 0, False, 0.4, 1.0, True, True, "high"),
    ("high", 0, 0, False, 1.0, 0.4, True, True, "medium"), ("high", 0, 0, False, 1.0, 0.4, False, False, "high"), ("high", 0, 0, False, 0.1, 1.0, False, False, "low"),
    ("medium", 0, 0, False, 0.1, 1.0, False, False, "low"), ("medium", 0, 0, False, 0.4, 0.2, False, False, "low"), ("medium", 0, 0, False, 0.4, 0.2, False, True, "medium"), ("low", 0, 0, False, 0.0, 0.0, True, False, "low"),
]


def test_validated_level(spark):
    schema = "level string, failed int, notes int, year boolean, evidence double, coverage double, constrained boolean, fallback boolean"
    assert column_of(spark, [r[:-1] for r in LEVELS], schema, scoring.validated_level) == [r[-1] for r in LEVELS]


def test_heuristic_level(spark):
    rows = [(0, 300, 2024, False, "medium"), (0, 300, 2024, True, "medium"), (1, 300, 2024, True, "high"), (2, 0, None, True, "medium"), (1, 11, 2019, True, "low"), (5, 300, 2024, True, "high"), (0, None, None, True, "low"), (2, 51, 2020, True, "high")]
    assert column_of(spark, [r[:-1] for r in rows], "hits int, cited int, year int, constrained boolean", candidates.heuristic_level) == [r[-1] for r in rows]


ROUGH = [  # dense, path, citations, overlap, prerank, coverage -> score
    (0.7, ["title_exact"], 0, 0, 0.0, 0.0, 0.7 + 0.01 + 1.0), (None, [], None, 0, None, None, 0.5 + 0.01), (None, None, -3, 0, None, None, 0.51), (0.0, ["citation", "reference"], 0, 9, 0.0, -1.0, 0.5 + 0.02 + 0.5),
    (0.0, ["x.citation_expansion", "reference_expansion.title_like"], 0, 1, 1.0, 1.0, 0.5 + 0.02 + 0.05 + 0.25 + 0.1 + 1.0), (0.2, ["title_exact title_like"], 0, 0, 0.0, 0.0, 0.2 + 0.01 + 1.0),
]


def test_rough_score(spark):
    got = column_of(spark, [r[:-1] for r in ROUGH], "d double, p array<string>, c int, o int, r double, v double", candidates.rough_score)
    assert got == pytest.approx([r[-1] for r in ROUGH])


@pytest.mark.parametrize(("tag", "worth"), [("title_exact", 0.6), ("a.title_like", 0.4), ("core_topic", 0.15), ("method_task", 0.12), ("entity_dataset", 0.12), ("evolved", 0.1), ("hybrid", 0.1), ("query2doc", 0.1), ("hyde", 0.1), ("provider:arxiv", 0.05)])
def test_route_worth(spark, tag, worth):
    rows = [(0.0, 0.0, 0, 0, [tag], 0.0, None, None), (0.0, 0.0, 3, 0, ["other", tag], 0.0, 0, -5), (0.0, 0.0, 1, 1, [tag], 1.0, 2016, 0)]
    got = column_of(spark, rows, "a double, b double, c int, d int, p array<string>, s double, y int, n int", candidates.evidence_score)
    assert got == pytest.approx([worth, 0.3 + max(worth, 0.05), 0.25 + worth + 0.1 + 0.01])


def test_evidence_features(spark):
    rows = [
        ("Graph Studies of Boxes", "Indexes, policies and glasses", ["graph neural", "Indexes", "policy", "raph stu", ""], ["provider:arxiv", "arxiv:x", "prov:s2", "web:y"], "pubmed"),
        (None, None, ["a"], None, None), ("Cats", "", None, ["openalex"], ""),
    ]
    df = spark.createDataFrame(rows, "title string, abstract string, wanted array<string>, path array<string>, source string")
    asked = candidates.text_constraints(F.col("wanted"), F.array(F.lit("Year 2020"), F.lit("since 2021 >"), F.lit(" indexes "), F.lit(None)))
    query = candidates.evidence_tokens(F.lit("graph index of a class"))
    got = candidates.evidence_features(df.withColumn("asked", asked), "title", "abstract", query, F.col("asked"), "path", "source").collect()
    assert got[0].asked == ["graph neural", "Indexes", "policy", "raph stu"]
    assert (got[0].title_match, got[0].abstract_match) == (0.5, 0.25) and (got[0].worded, got[0].literal, got[0].providers) == (2, 1, 1.0)
    assert (got[1].worded, got[1].literal, got[1].providers, got[1].title_match) == (0, 0, 0.0, 0.0)
    assert got[2].providers == 0.0 and got[2].asked == ["indexes"]
    assert (got[0].matched, got[0].missing) == (["Indexes", "policy", "raph stu"], ["graph neural"]) and (got[1].matched, got[1].missing) == ([], ["a", "indexes"])


def test_local_selection(spark):
    rows = [(0.6, ["a"], ["b"], "high", 0.9, 0.75, 0.7, 0.7), (0.95, ["a"], [], "high", 0.95, 1.0, 0.7, 0.9), (0.2, [], ["b"], "medium", 0.55, 0.45, 0.45, 0.3), (0.1, ["a"], ["b"], "low", 0.2, 0.5, 0.15, 0.2), (0.0, [], [], "irrelevant", 0.0, 0.0, 0.0, 0.1)]
    df = spark.createDataFrame([r[:3] for r in rows], "s double, matched array<string>, missing array<string>")
    got = candidates.local_selection(df, "s").select("level", "relevance_score", "constraint_score", "evidence_score", "confidence").collect()
    assert [r.level for r in got] == [r[3] for r in rows]
    assert [tuple(r)[1:] for r in got] == [pytest.approx(r[4:]) for r in rows]


STAGES = {
    "retrieval.arxiv": ["retrieval"], "retrieval": ["other"], "selector": ["other"], "listwise_rerank": ["evidence"], "batch_llm": ["evidence"], "llm_pool_reviewer": ["synthesis"], "Evidence.Synthesis": ["evidence", "synthesis"],
    "retrieval.rerank": ["evidence", "retrieval"], "planning": ["other"],
}


def test_stages(spark):
    got = usage.stages(spark.createDataFrame([(k,) for k in STAGES], "c string"), "c").groupBy("c").agg(F.sort_array(F.collect_list("stage")).alias("s"))
    assert {r.c: r.s for r in got.collect()} == STAGES


@pytest.mark.parametrize(
    ("rows", "gone"),
    [  # (position, citations, noise) -> positions that go
        ([(0, 5, True), (1, 5, True), (2, 5, True)], {2}), ([(0, 1, False), (1, 9, True)], {1}), ([(0, 1, False)], set()),
        ([(k, 10 - k, k >= 5) for k in range(10)], {8, 9}), ([(k, None, True) for k in range(10)], {8, 9}), ([(0, 3, None), (1, 4, True), (2, 1, False)], {1}),
    ],
)
def test_noise_dropped(spark, rows, gone):
    df = spark.createDataFrame([("q", *r) for r in rows], "q string, pos int, cited int, noise boolean")
    kept = {r.pos for r in selection.noise_dropped(df, ["q"], F.col("noise"), "cited", "pos").collect()}
    assert kept == {r[0] for r in rows} - gone


def test_is_noise(spark):
    rows = [("The Cat", "", [], False), ("Dogs", "about a cat", [], False), ("Dogs", None, [], True), ("Dogs", "", ["x.core_topic"], False), (None, None, None, True), ("of the", "", [], True)]
    df = spark.createDataFrame(rows, "t string, a string, p array<string>, want boolean")
    asked = selection.topic_words(F.lit("the CAT of it"))
    assert all(r.got == r.want for r in df.withColumn("got", selection.is_noise(F.col("t"), F.col("a"), F.col("p"), asked)).collect())


def test_verdict_ties_discard_the_later(spark):
    pool = spark.createDataFrame([("q", k, 7, 30 - k) for k in range(20)], "q string, id int, cited int, pos int")
    said = pool.select("q", "id", F.lit("discard").alias("action"), F.lit("r").alias("reason"))
    kept = {r.id: r.action for r in pools.verdicts_applied(pool, said, "q", "id", "cited", "pos").collect()}
    assert set(kept) == set(range(2, 20)) and set(kept.values()) == {"noise"}


@pytest.mark.parametrize(("message", "kind"), [("HTTP 429", "rate_limit"), ("Too Many Requests", "rate_limit"), ("read timed out", "timeout"), ("SSL handshake 503", "timeout"), ("502 bad gateway", "server_error"), ("boom", "error"), (None, "error")])
def test_error_kind(spark, message, kind):
    assert column_of(spark, [(message,)], "m string", health.error_kind) == [kind]


HEALTH = [  # provider, ts, kind, elapsed, items -> rows (ts, kind, state, errors, allowed, budget)
    ("openalex", [(0.5, "success", 1.0, 3)], [(0.5, "success", "healthy", 0, True, 35.0)]),
    ("pasa_local", [(0.5, "success", 11.0, 0), (1.0, "success", 99.0, 0)], [(0.5, "success", "healthy", 0, True, 15.0), (1.0, "success", "healthy", 0, True, 15.0)]),
    ("web", [(0.5, "success", 11.0, 0)], [(0.5, "success", "healthy", 0, True, 45.0 * 0.7)]),
    ("arxiv", [(5.0, "timeout", None, None), (9.0, "success", 1.0, 1), (16.0, "success", 1.0, 1)],
     [(5.0, "timeout", "cooldown", 1, True, 15.0), (9.0, "success", "cooldown", 0, False, 15.0), (15.0, "recovered", "degraded", 0, True, 7.5), (16.0, "success", "healthy", 0, True, 15.0)]),
    ("pubmed", [(1.0, "timeout", None, None), (30.0, "timeout", None, None)], [(1.0, "timeout", "cooldown", 1, True, 15.0), (11.0, "recovered", "degraded", 1, True, 7.5), (30.0, "timeout", "blocked", 2, True, 0.0)]),
    ("semantic_scholar", [(1.0, "rate_limit", None, None), (7.0, "rate_limit", None, None), (20.0, "rate_limit", None, None)],
     [(1.0, "rate_limit", "cooldown", 1, True, 20.0), (6.0, "recovered", "degraded", 1, True, 10.0), (7.0, "rate_limit", "cooldown", 2, True, 20.0), (12.0, "recovered", "degraded", 2, True, 10.0), (20.0, "rate_limit", "blocked", 3, True, 0.0)]),
    ("faiss_vector", [(1.0, "server_error", None, None)], [(1.0, "server_error", "cooldown", 1, True, 30.0), (11.0, "recovered", "degraded", 1, True, 15.0)]),
    ("late", [(1.0, "error", None, None), (2.0, "error", None, None), (3.0, "error", None, None), (4.0, "error", None, None), (5.0, "error", None, None), (6.0, "success", 1.0, 1), (100_000.0, "success", 1.0, 1)],
     [(1.0, "error", "healthy", 1, True, 45.0), (2.0, "error", "healthy", 2, True, 45.0), (3.0, "error", "healthy", 3, True, 45.0), (4.0, "error", "healthy", 4, True, 45.0), (5.0, "error", "blocked", 5, True, 0.0), (6.0, "success", "blocked", 4, False, 0.0),
      (100_000.0, "success", "healthy", 0, True, 45.0)]),
]
EVENTS = "provider string, ts double, kind string, elapsed double, items int"


def expected_health():
    return sorted((p, *r) for p, _, rows in HEALTH for r in rows)


def given_health():
    return [(p, *e) for p, events, _ in HEALTH for e in events]


def test_health_replay_equals_the_table(spark):
    got = health.replay(spark.createDataFrame(given_health(), EVENTS).repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == expected_health()


def test_health_stream_equals_the_table(spark, tmp_path):
    """Batches of a few events each; the last, far later, lets every timer end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        source, events = tmp_path / "events", sorted(given_health(), key=lambda e: e[1])
        source.mkdir()
        rows = spark.readStream.schema(EVENTS).parquet(str(source))
        writer = health.stream(rows).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck"))
        query = writer.format("memory").queryName("timed_health").start()
        ends = [0, 3, 9, 15, len(events) - 1, len(events)]
        for a, b in zip(ends, ends[1:], strict=False):
            pd.DataFrame(events[a:b], columns=[c.split()[0] for c in EVENTS.split(", ")]).astype({"items": "Int32"}).to_parquet(source / f"{a:03}.parquet")
            query.processAllAvailable()
        query.stop()
        assert sorted(tuple(r) for r in spark.table("timed_health").collect()) == expected_health()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
