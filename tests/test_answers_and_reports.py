"""Model answers of odd shapes, paired gold, cut-offs, provider costs; reports that no query shows."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation, pools, usage
from lodestone.operators.cutoffs import guessed_type
from lodestone.planning import answers as A
from lodestone.sources import cases


def plan_of(spark, answer, query="graphs", previous=None):
    asked = spark.createDataFrame([(1, query, answer)], "id int, query string, answer string")
    behind = spark.createDataFrame([(1, "en", "broad_topic", ["fm"], 1999)], "id int, language string, query_type string, methods array<string>, start_year int")
    before = None if previous is None else spark.createDataFrame([(1, *previous)], "id int, query_type string, methods array<string>, venues array<string>")
    return A.plans_of_answers(asked, behind, "id", "query", "answer", before).first()


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (None, {"from_model": False, "methods": ["fm"], "query_type": "broad_topic", "start_year": 1999, "datasets": []}),
        ("", {"from_model": False}), ("[1]", {"from_model": False}), ('"text"', {"from_model": False}), ('{"methods": ["a", null]}', {"from_model": False}), ('{"methods": [["a"]]}', {"from_model": False}),
        ('{"query_type": "other"}', {"from_model": False}), ("{}", {"from_model": True, "methods": [], "query_type": "broad_topic", "start_year": None, "language": "en"}),
        ('{"methods": "NONE", "datasets": " ", "entities": 3.5, "venues": false}', {"methods": [], "datasets": [], "entities": ["3.5"], "venues": ["False"]}),
        ('{"methods": {"a": 1}, "language": "zh-CN"}', {"methods": ['{"a":1}'], "language": "zh"}), ('{"language": "German"}', {"language": "en"}), ('{"language": 5}', {"language": "en"}),
        ('{"time_range": {"start_year": " 2020 ", "end_year": null}}', {"start_year": 2020, "end_year": None}), ('{"time_range": "2020"}', {"start_year": None}), ('{"time_range": {"start_year": [1], "end_year": "2020.5"}}', {"start_year": None, "end_year": None}),
        ('{"query_type": "survey", "task": "t", "methods": ["b", "b", "a"]}', {"query_type": "survey", "task": "t", "methods": ["b", "b", "a"]}),
    ],
)
def test_answers_become_plans(spark, answer, want):
    got = plan_of(spark, answer)
    assert {k: got[k] for k in want} == want


def test_plans_only_grow(spark):
    got = plan_of(spark, '{"methods": ["m", "m", "z"], "query_type": "unknown"}', "图", ("latest_work", ["z", "y", "x"], None))
    assert (got.methods, got.query_type, got.language, got.venues) == (["m", "z", "x", "y"], "latest_work", "zh", [])
    assert plan_of(spark, "no", previous=("survey", ["p"], ["v"])).methods == ["fm"]


def test_recalled_queries_take_the_first_items(spark):
    titles = [f"Title Number {k} of Many" for k in range(14)]
    plans = spark.createDataFrame([(k, ["Graph Nets"], "Molecule Design Tasks", None) for k in range(4)], "id int, methods array<string>, research_topic string, entities array<string>")
    rows = [(0, '{"title_queries": ' + str(["x", *titles]).replace("'", '"') + "}"), (1, None), (2, "[]"), (9, "[]")]
    answers = spark.createDataFrame(rows, "id int, answer string")
    got = {}
    for r in A.recalled_queries(plans, answers, "id", "answer").orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.search)
        assert (r.route, r.priority, r.start_year) == ("title_like", 8, None)
    assert got == {0: titles[:9], 1: ["Graph Nets: Molecule Design Tasks", "Molecule Design Tasks"]}
    long = "word " * 60
    terms = A.recalled_queries(plans, spark.createDataFrame([(0, f'["{long}", "a b", "one", 4]')], "id int, answer string"), "id", "answer", A.TERM_QUERIES).collect()
    assert [len(t.search) for t in terms] == [120, 3] and A.recalled_queries(plans, answers.limit(0), "id", "answer").count() == 0


def test_paired_cases(spark):
    records = ['{"qid": "a", "question": "q", "answer": ["t1", {"title": "t2", "arxiv_id": "own"}, "t3"], "answer_arxiv_id": ["1", "2"]}', " ", '{"query": "p", "answers": ["t"], "answer": [], "answer_arxiv_ids": [""]}', '{"question": ""}']
    got = cases.paired_cases(spark.createDataFrame([(r,) for r in records], "value string").coalesce(1)).collect()
    assert [(r.name, r.question, [tuple(g) for g in r.gold]) for r in got] == [("a", "q", [("t1", "1"), ("t2", "own"), ("t3", None)]), ("case-2", "p", [("t", None)]), ("case-3", "", [])]


def test_types_are_guessed_where_unknown(spark):
    rows = [("unknown", "Review and compare", "survey"), (None, "compare benches", "method_comparison"), ("unknown", "MedEval", "dataset_constraint"), ("unknown", "最新 work", "latest_work"), ("survey", "latest", "survey"), ("unknown", None, "unknown")]
    df = spark.createDataFrame(rows, "k string, q string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", guessed_type(F.col("k"), F.col("q"))).collect())


def test_cutoffs_and_recency(spark):
    rows = spark.createDataFrame([("q", 1, 5), ("q", 2, None), ("q", 3, 9), ("r", 4, 9), (None, 5, 9)], "q string, id int, day int")
    cuts = spark.createDataFrame([("q", 6), ("q", 8), (None, 9)], "q string, cutoff int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(pools.before_cutoff(rows, "day", cuts, "q")) == [1, 2, 4, 5] and ids(pools.before_cutoff(rows, "day")) == [1, 2, 3, 4, 5]
    assert ids(pools.before_cutoff(rows, "day", cuts.limit(1))) == [1, 2] and ids(pools.before_cutoff(rows, "day", cuts.limit(0))) == [1, 2, 3, 4, 5]
    assert [r.id for r in pools.most_recent(rows, "day", ["id"], 4).orderBy("rank").collect()] == [3, 4, 5, 1]
    assert {(r.id, r["rank"]) for r in pools.most_recent(rows, "day", ["id"], 2, ["q"]).collect()} == {(3, 1), (1, 2), (4, 1), (5, 1)}


def test_providers_of_costs(spark):
    rows = spark.createDataFrame([("retrieval.arxiv.title", 1), ("retrieval.arxiv", 2), ("retrieval.", 4), ("retrieval", 8), ("synthesis.x", 16), (None, 32)], "c string, n int")
    got = {(r.kind, r.name): r.n for r in usage.by_provider(rows, "c", ["n"]).collect()}
    assert got == {("retrieval", "arxiv"): 3, ("retrieval", ""): 4, ("component", "retrieval"): 8, ("component", "synthesis.x"): 16, ("component", None): 32}


def test_run_reports(spark):
    runs = spark.createDataFrame([("1", "run", "succeeded"), ("2", "eval", "failed"), ("3", "run", "failed"), ("4", "run", "queued")], "job_id string, kind string, status string")
    logs = spark.createDataFrame([(1,), (2,)], "n int")
    got = pools.run_counts(runs, logs).first()
    assert (got.runs, got.succeeded, got.failed, got.running, got.logs) == (4, 1, 2, 0, 2)
    assert [r.job_id for r in pools.recent_runs(runs, 2).collect()] == ["4", "3"] and pools.run_counts(runs.limit(0), logs.limit(0)).first().runs == 0


def test_lost_cases_and_ablation(spark):
    scored = spark.createDataFrame([("a", "x", 0), ("a", "y", 2), ("b", "x", 0), ("b", "y", 0)], "case string, setting string, hits int")
    assert [r.case for r in evaluation.lost_cases(scored, "case", "hits").collect()] == ["b"]
    one = lambda *v: spark.createDataFrame([(str(k), x) for k, x in enumerate(v)], "case string, recall double")
    got = evaluation.ablation({"base": one(0.5, 0.1), "more": one(0.75, 0.25), "all": one(0.6)}, "case", "recall").collect()
    assert {r.setting: (r.cases, r["mean"], r.delta) for r in got} == {"base": (2, 0.3, None), "more": (2, 0.5, pytest.approx(0.2)), "all": (1, 0.6, pytest.approx(0.1))}


def test_vector_rerank_and_levels_from_checks(spark):
    pool = spark.createDataFrame([("q", k, ["provider:a"]) for k in range(5)], "q string, id int, retrieval_path array<string>")
    scores = spark.createDataFrame([("q", 1, 0.5), ("q", 3, 0.9), ("q", 4, 0.5), ("q", 77, 1.0)], "q string, id int, score double")
    got = pools.vector_reranked(pool, scores, "q", "id", 2).orderBy("rank").collect()
    assert [(r.id, r.vector_score, r.retrieval_path) for r in got] == [(3, 0.9, ["provider:a", "provider:vector_rerank", "route:vector_semantic"]), (1, 0.5, ["provider:a", "provider:vector_rerank", "route:vector_semantic"])]
    chosen = spark.createDataFrame([("q", 1, "high"), ("q", 9, "high")], "q string, id int, level string")
    papers = spark.createDataFrame([("q", 1, 2000)], "q string, id int, year int")
    level = F.when(F.col("year") < 2010, "low").otherwise(F.col("level"))
    assert {r.id: r.level for r in pools.passed_through(chosen, papers, "q", "id", level).collect()} == {1: "low", 9: "high"}


def test_sessions_are_discovered_under_their_roots(spark, tmp_path):
    from lodestone.sources import sessions

    notes, lines = tmp_path / "notes", tmp_path / "lines"
    notes.mkdir()
    lines.mkdir()
    (notes / "a.md").write_text("#### <user> hello </user>")
    (lines / "b.jsonl").write_text('{"type": "user", "message": {"role": "user", "content": "hi"}, "timestamp": "2024-01-01T00:00:00Z"}\n')
    roots = {"markdown": str(notes), "typed_lines": str(lines), "session_json": str(tmp_path / "missing"), "unknown": str(notes), "rollout_lines": ""}
    assert sessions.discovered(spark, roots) == {"typed_lines": str(lines), "markdown": str(notes)}
    assert {(r.agent, r.plain_text) for r in sessions.load_all(spark, roots).collect()} == {("markdown", "hello"), ("typed_lines", "hi")}
    assert sessions.load_all(spark, {}).count() == 0
