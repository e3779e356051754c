import json

import pytest
from pyspark.sql import functions as F

from lodestone.sources import cases, papers, sessions


def test_typed_lines(spark, tmp_path):
    lines = [
        {"type": "user", "message": {"role": "user", "content": "Hello\nthere"}, "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w", "sessionId": "s1"},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "Hi"}, {"type": "tool_use", "name": "run"}]}, "timestamp": "2024-01-01T00:01:00Z", "sessionId": "s1"},
        {"type": "summary"},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = sessions.load(spark, "typed_lines", str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.role, r.plain_text) for r in got] == [(0, "user", "Hello\nthere"), (1, "assistant", "Hi\n[Tool: run] ")]
    one = sessions.sessions(sessions.load(spark, "typed_lines", str(tmp_path))).first()
    assert (one.title, one.message_count, one.started_at) == ("Hello", 2, "2024-01-01T00:00:00Z")


def test_other_shapes(spark, tmp_path):
    name = "rollout-2024-01-01-12345678-1234-1234-1234-123456789abc.jsonl"
    (tmp_path / name).write_text(json.dumps({"type": "x", "timestamp": "t", "payload": {"role": "user", "content": [{"text": "q"}]}}) + "\n")
    (tmp_path / "log.md").write_text("#### <user>\nask\n</user>\n#### <assistant>\nanswer\n</assistant>\n")
    (tmp_path / "s.json").write_text(json.dumps({"sessionId": "z", "projectDir": "/p", "messages": [{"role": "user", "content": "m", "timestamp": "1700000000"}]}))
    assert sessions.load(spark, "rollout_lines", str(tmp_path)).first().session_id.startswith("12345678-")
    assert [r.plain_text for r in sessions.load(spark, "markdown", str(tmp_path)).orderBy("ordinal").collect()] == ["ask", "answer"]
    got = sessions.load(spark, "session_json", str(tmp_path)).first()
    assert (got.session_id, got.ts, got.workspace) == ("z", "2023-11-14T22:13:20Z", "/p")


def test_upsert_and_bundles(spark):
    store = spark.createDataFrame([("a", "s", 0, "user", "t", "x", "w"), ("a", "u", 0, "user", "t", "y", "w")], sessions.MESSAGES)
    again = sessions.upserted(sessions.upserted(store, store.filter("session_id = 's'")), store.filter("session_id = 's'"))
    assert again.count() == 2
    assert sessions.deleted(store, store.filter("session_id = 's'")).count() == 1
    assert sessions.from_bundles(sessions.bundles(store)).exceptAll(store.select(sessions.from_bundles(sessions.bundles(store)).columns)).count() == 0
    with pytest.raises(Exception, match="version"):
        sessions.from_bundles(spark.createDataFrame([('{"bundle_version": 2}',)], "bundle string")).collect()


def test_cases(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question": "q1", "answer": ["A", "B"], "source_meta": {"published_time": "20240301"}}\n\n{"query": "q2", "gold": "A; B"}\n')
    (tmp_path / "b.json").write_text('{"cases": [{"query": "q", "gold": ["G"]}]}')
    (tmp_path / "c.csv").write_text("prompt,expected\nq,A|B\n")
    assert [(r.question, r.gold) for r in cases.load_cases(spark, str(tmp_path / "a.jsonl")).orderBy("case_index").collect()] == [("q1", ["A", "B"]), ("q2", ["A", "B"])]
    assert cases.load_cases(spark, str(tmp_path / "b.json")).first().gold == ["G"]
    assert cases.load_cases(spark, str(tmp_path / "c.csv")).first().gold == ["A", "B"]
    assert cases.by_gold_count(cases.load_cases(spark, str(tmp_path / "a.jsonl"))).count() == 2


def test_papers(spark, tmp_path):
    assert papers.fixture(spark).count() == 5
    (tmp_path / "t.json").write_text(json.dumps({"1": "A b", "2": "ab", "3": "!!"}))
    assert [(r.title_key, r.arxiv_id) for r in papers.titles(spark, str(tmp_path / "t.json")).collect()] == [("ab", "2")]
    work = json.dumps({"id": "W1", "display_name": "T", "doi": "https://doi.org/10.1/X", "abstract_inverted_index": {"b": [1], "a": [0]}, "authorships": [{"author": {"display_name": "N"}}]})
    got = papers.from_works(spark.createDataFrame([(work,), ("{}",)], "value string")).first()
    assert (got.title, got.abstract, got.doi, got.authors) == ("T", "a b", "10.1/x", ["N"])
    atom = "<entry><id>http://arxiv.org/abs/2401.1v2</id><title> T </title><summary>S</summary><published>2024-01-02T00:00:00Z</published></entry>"
    assert papers.from_atom(spark.createDataFrame([(atom,)], "value string")).first().paper_id == "2401.1"
    asked = spark.createDataFrame([("x",), ("y",)], "q string")
    hits, misses = papers.cached(asked, asked.filter("q = 'x'").select(F.sha1("q").alias("sha1"), F.lit("p").alias("payload")), "q")
    assert (hits.count(), misses.count()) == (1, 1)


def test_stores(spark, tmp_path):
    from lodestone.sources import stores

    names = [c.split()[0] for c in stores.RUNS.split(", ")]
    row = lambda **x: tuple(x.get(n) for n in names)
    store = spark.createDataFrame([row(job_id="a", status="running", started_at="1", created_at="1", updated_at="1"), row(job_id="b", status="done", updated_at="1")], stores.RUNS)
    new = spark.createDataFrame([row(job_id="a", status="half", started_at="5", updated_at="2"), row(job_id="a", status="done", started_at="6", updated_at="3"), row(job_id="c", status="queued", started_at="7", updated_at="1")], stores.RUNS)
    got = {r.job_id: r for r in stores.upserted_runs(store, new).collect()}
    assert (got["a"].status, got["a"].started_at, got["a"].created_at, got["b"].status, got["c"].started_at) == ("done", "1", "1", "done", "7")
    assert {r.job_id: r.status for r in stores.recovered_runs(store).collect()} == {"a": "failed", "b": "done"}
    path = str(tmp_path / "sessions")
    rows = spark.createDataFrame([("x", "s", 0), ("y", "t", 0)], "agent string, session_id string, ordinal int")
    stores.write_sessions(rows, path)
    stores.write_sessions(rows.filter("agent = 'x'").withColumn("session_id", F.lit("new")), path)
    assert sorted((r.agent, r.session_id) for r in spark.read.parquet(path).collect()) == [("x", "new"), ("y", "t")]
    papers_ = spark.createDataFrame([(1, "T", None), (2, " ", "a"), (3, "U", "b")], "id int, title string, abstract string")
    assert [r.text for r in stores.missing_vectors(papers_, papers_.filter("id = 3"), "id").collect()] == ["T"]


def test_hooks(spark):
    from lodestone.operators import hooks

    answers = spark.createDataFrame([("q", '{"results": [{"paper_id": "1", "relevance_score": 1.7, "relevance_probability": 0.9, "relevance_level": "top"}, {"x": 1}]}')], "q string, a string")
    got = hooks.judged(answers, "q", "a").collect()
    assert [(r.paper_id, r.score, r.level, r.confidence) for r in got] == [("1", 1.0, "low", 0.5)]
    pool = spark.createDataFrame([("q", "1", 0.6), ("q", "2", 0.1)], "q string, paper_id string, local double")
    out = {r.paper_id: r for r in hooks.reviewed(pool, "q", "local", lambda c: hooks.judged(answers, "q", "a")).collect()}
    assert (out["1"].score, out["2"].score, out["2"].level) == (1.0, 0.1, "low")
    assert hooks.reviewed(pool, "q", "local").filter("level = 'high'").count() == 1
