"""Pools, providers, models and deadlines."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import deadlines, models, pools
from lodestone.sources import papers, providers, sessions


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl)


def test_fused_records_keep_and_merge(spark):
    ddl = "q int, key string, list_no int, rank int, weight double, record struct<id:string,abstract:string,arxiv_id:string>, metadata map<string,string>"
    data = [
        (1, "a", 0, 0, 1.0, ("a0", None, None), {"x": "1"}), (1, "b", 0, 1, 1.0, ("b0", "has", None), {}), (1, "a", 1, 0, 1.5, ("a1", "text", None), {"x": "2", "y": "3"}),
        (1, "a", 2, 5, 1.0, ("a2", "longer", None), None), (1, "b", 1, 1, 1.5, ("b1", "x", "2401.1"), {"z": "1"}), (1, "c", 2, 5, 1.0, ("c", None, None), None),
    ]
    got = {r.key: r for r in pools.fused_records(rows(spark, data, ddl), ["q"], "key").collect()}
    assert got["a"].record.id == "a1" and got["a"].metadata == {"x": "2", "y": "3"} and got["b"].record.id == "b1"
    assert got["a"].score == pytest.approx(1 / 60 + 1.5 / 60 + 1 / 65) and [got[k]["rank"] for k in "abc"] == [1, 2, 3]


def test_appended_takes_parts_in_order(spark):
    a, b = (rows(spark, [(1, k, n) for n, k in enumerate(ks, 1)], "q int, key string, rank long") for ks in (("x", "y"), ("y", "z", "w")))
    got = pools.appended([a, b], ["q"], "key", 3).collect()
    assert [(r.key, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [("x", 1), ("y", 2), ("z", 3)]


def test_verdicts_spare_the_cited(spark):
    pool = rows(spark, [(1, k, k) for k in range(20)], "q int, id int, cited int")
    said = rows(spark, [(1, k, "discard" if k < 5 else "soft_drop", "r") for k in range(6)], "q int, id int, action string, reason string")
    got = {r.id: r.action for r in pools.verdicts_applied(pool, said, "q", "id", "cited").collect()}
    assert set(range(20)) - set(got) == {0, 1} and [got[k] for k in (2, 3, 4, 5, 6)] == ["noise", "noise", "noise", "soft_drop", "keep"]


def test_broad_search(spark):
    df = rows(spark, [(100, ["semantic_scholar"], "unknown"), (130, ["arxiv"], "unknown"), (130, ["semantic_scholar"], "unknown"), (130, ["semantic_scholar"], "survey")], "n int, p array<string>, t string")
    got = df.select(pools.needs_broad_search(F.col("n"), F.lit(120), F.col("p"), F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == [True, True, False, True]


def test_rounds_end_request_by_request(spark):
    """Requests end in different rounds, each as if it ran alone: nothing new, the target reached, rounds used up."""
    last = {1: 0, 2: 2, 3: 50, None: 1, 5: 4}
    start = [(q, 0) for q in last] + [(2, 0)]
    limits = rows(spark, [(q, n) for q, n in last.items()], "q2 int, most int")
    asked = []

    def search(pool, n):
        asked.append((n, {r.q for r in pool.select("q").distinct().collect()}))
        more = pool.join(limits, F.col("q").eqNullSafe(F.col("q2"))).filter("id < most").select("q", (F.col("id") + 1).alias("id"))
        return more.unionByName(pool.select("q", "id"))

    found = pools.in_rounds(rows(spark, start, "q int, id int"), search, "q", ["id"], ["id"], 7, 6).collect()
    ends = {}
    for q in last:
        alone = pools.in_rounds(rows(spark, [r for r in start if r[0] == q], "q int, id int"), search, "q", ["id"], ["id"], 7, 6)
        ends[q] = sorted((r.id, r.rounds) for r in alone.collect())
        assert sorted((r.id, r.rounds) for r in found if r.q == q) == ends[q]
    assert {q: v[0][1] for q, v in ends.items()} == {1: 1, 2: 3, 3: 5, None: 2, 5: 5}
    assert [q for _, q in asked[:5]] == [set(last), {2, 3, None, 5}, {2, 3, 5}, {3, 5}, {3, 5}]


def test_rounds_are_limited(spark):
    found = pools.in_rounds(rows(spark, [(1, 0), (2, 0)], "q int, id int"), lambda p, n: p.select("q", (F.col("id") + 1).alias("id")), "q", ["id"], ["id"], 2, 99).collect()
    assert sorted((r.q, r.id, r.rounds) for r in found) == [(q, k, 2) for q in (1, 2) for k in range(3)]
    none = rows(spark, [], "q int, id int")
    assert pools.in_rounds(none, lambda p, n: p, "q", ["id"], ["id"], 3, 9).count() == 0


def test_titles_tokens_and_dates(spark):
    texts = {
        "Attention Is All You Need": True, "BERT pretraining survey": True, "graph neural nets": False, "What is a good model for text": False, "find papers on deep learning nets": False,
        "deep learning for graphs and text": True, "two words": False, "A: study of things": True, "the latest papers about large nets": False,
    }
    df = rows(spark, [(t,) for t in texts], "t string")
    assert {r.t: r.x for r in df.select("t", T.looks_like_title(F.col("t")).alias("x")).collect()} == texts
    one = rows(spark, [("Stories of Faces, é Übungen a matches", {"published": "x", "updated": "2024-03"}, 2020)], "t string, m map<string,string>, y int")
    got = one.select(T.stemmed_words(F.col("t")).alias("w"), T.paper_date(F.col("m"), F.col("y")).cast("string").alias("d"), T.paper_date(F.lit(None).cast("map<string,string>"), F.col("y")).cast("string").alias("e"), T.is_biomedical(F.col("t"), F.array(F.lit("Gene x"))).alias("b")).first()
    assert (sorted(got.w), got.d, got.e, got.b) == (["face", "matche" if "matche" in got.w else "match", "of", "story", "übungen"], "2024-03-28", "2020-12-31", True)


def test_snippets_and_flat_content(spark):
    blocks = '[{"type":"text","text":"hi"},{"type":"tool_use","name":"run","input":{"cmd":"ls"}},{"type":"tool_result","content":"%s"},{"type":"thinking","thinking":"hm"},{"type":"image"}]' % ("r" * 3000)
    got = rows(spark, [(blocks,), ("plain",), ("",)], "c string").select(sessions.flat_content(F.col("c")).alias("flat"), sessions.snippets(F.col("c")).alias("s")).collect()
    assert got[0].flat == "hi\n[Tool: run] cmd=ls\n[ToolResult] " + "r" * 400 + "\n[Thinking] hm"
    assert [(s.kind, len(s.content)) for s in got[0].s] == [("text", 2), ("tool_use", 11), ("tool_result", 2000), ("thinking", 2)] and got[0].s[1].meta == {"cmd": "ls"}
    assert (got[1].flat, [s.content for s in got[1].s], got[2].s) == ("plain", ["plain"], [])


def test_records_of_two_services(spark):
    data = '{"paperId":"p1","title":"T","year":2020,"citationCount":3,"authors":[{"name":"A"},{"name":""}],"externalIds":{"DOI":"10.1/x"}}'
    got = papers.from_scholar(rows(spark, [(data,), ('{"url":"u"}',)], "value string")).collect()
    assert (got[0].paper_id, got[0].authors, got[0].doi, got[1].paper_id, got[1].title) == ("p1", ["A"], "10.1/x", "u", "Untitled")
    days = rows(spark, [("2020", "Mar", "5"), ("2021", None, None), ("x", "1", "1"), ("2022", "odd", "1")], "y string, m string, d string")
    assert [r[0] for r in days.select(papers.assembled_date(F.col("y"), F.col("m"), F.col("d"))).collect()] == ["2020-03-05", "2021-12-31", None, "2022-12-31"]


def test_providers(spark):
    asked = rows(spark, [(1, "Fixture paper number 2 on retrieval", "core"), (2, "x", "core")], "query_id int, search string, route string")
    [mock] = providers.build(spark, {"openalex": True, "unknown": True}, "mock")
    found = mock.tagged(asked, 2).collect()
    assert len(found) == 4 and all(r.retrieval_path == ["provider:mock", "route:core"] and r.source == "mock" for r in found)
    named = providers.Fixture(spark, rows(spark, [("p1", "On Graphs!"), ("p2", "On trees")], "paper_id string, title string"))
    assert [r.paper_id for r in named.exact_title(rows(spark, [(1, "on graphs")], "query_id int, search string")).collect()] == ["p1"]
    cache = rows(spark, [("s2|x|core|2",)], "key string").select(F.sha1("key").alias("sha1"), F.lit('["{\\"paperId\\":\\"c1\\",\\"title\\":\\"T\\"}"]').alias("payload"))
    parse = lambda r: r.select("query_id", "rank").join(papers.from_scholar(r).select("paper_id", "title"))
    served = providers.Cached("s2", cache, parse, mock).search(asked, 2).collect()
    assert sorted((r.query_id, r.paper_id) for r in served) == [(1, "paper-001"), (1, "paper-002"), (2, "c1")]
    assert providers.build(spark, {"unknown": True, "mock": True}) == [] and mock.can("search") and not mock.can("expand")


def test_models_and_breaker(spark):
    got = models.completed(rows(spark, [(1, "judge this"), (2, "other")], "id int, prompt string"), "id", "prompt", models.canned({"judge": "```json\n{'a': 1,}\n```"})).collect()
    assert {r.id: r.answer for r in got} == {1: '{"a": 1}', 2: "{}"}
    breaker, calls = models.Breaker(), []

    def refusing(prompt, seconds):
        calls.append(prompt)
        raise models.Refused("no credit")

    assert breaker.call(refusing, "x", 3, 1.0)[1].startswith("refused") and breaker.call(refusing, "y", 3, 1.0) == (None, "breaker open") and calls == ["x"]


def test_deadlines():
    now = [0.0]
    whole = deadlines.Deadline(90, clock=lambda: now[0])
    part = whole.child(50, reserve=60)
    assert part.remaining() == 30 and whole.child(200).remaining() == 90
    now[0] = 31.0
    assert part.expired() and not whole.expired() and part.timeout(20) == 1.0 and whole.timeout(20) == 20


def test_reports(spark):
    found = rows(spark, [(1, "a", "high", "x", 2020, "Uses BERT"), (1, "b", None, None, None, "plain"), (1, "c", "medium", "x", 2022, "bert and GNN")], "q int, id string, level string, source string, year int, text string")
    assert pools.level_counts(found, ["q"]).first()[1:] == (1, 1, 1)
    assert {r.source: r.hits for r in pools.provider_counts(found, ["q"]).collect()} == {"x": 2, "unknown": 1}
    assert [r.id for r in sorted(pools.timeline(found, ["q"], "id").collect(), key=lambda r: r["rank"])] == ["c", "a", "b"]
    methods = rows(spark, [(1, "BERT"), (1, "GNN")], "q int, method string")
    assert {r.topic: r.papers for r in pools.method_clusters(found, methods, "q", "id", "text").collect()} == {"BERT": ["a", "c"], "GNN": ["c"], "General Method": ["b"]}
    curve = rows(spark, [(1, k, k in (1, 3)) for k in range(1, 6)], "q int, rank int, gold boolean")
    cuts = rows(spark, [(1, 2)], "q int, k int")
    assert tuple(pools.simulated_cutoffs(curve, {"two": cuts}, "q").first())[2:] == (2, 0.5, 0.5, 0.5)


def test_absorbing_isnt_transitive(spark):
    from lodestone.operators import resolve

    data = [
        (1, 1, "a", "d1", "", "t1"), (1, 2, "b", "", "x2", "t2"), (1, 3, "c", "d1", "x2", "t3"),  # 3 goes to 1 by its doi, though 2 has its arXiv id
        (1, 4, "z", "", "x2", ""), (1, 5, "c", "", "", "t9"), (1, 6, "y", None, None, "t3"), (2, 1, "a", "d1", "", "t1"),
    ]
    df = rows(spark, data, "q int, pos int, paper_id string, doi string, arxiv_id string, title string")
    got = {(r.q, r.pos): r.entity for r in resolve.absorbed(df, "q", "pos").collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 1, (1, 4): 2, (1, 5): 5, (1, 6): 1, (2, 1): 1}


def test_settings_prompts_and_datasets(spark, tmp_path):
    from lodestone.sources import settings

    (tmp_path / ".env").write_text("# no\nexport A='1'\nB=2\nC = x=y\n")
    env = {"B": "old", "LOD_SEARCH_LIMIT": "7"}
    assert settings.env_file(tmp_path / ".env", env) == {"A": "1", "C": "x=y"} and env["B"] == "old"
    (tmp_path / "c.json").write_text('{"search": {"route": "all"}, "extra": 1}')
    got = settings.settings({"search": {"limit": 5, "route": "x"}}, tmp_path / "c.json", environ=env, prefix="lod_")
    assert got == {"search": {"limit": 7, "route": "all"}, "extra": 1}
    prompts = settings.Prompts()
    prompts.add(settings.Prompt("judge", "Judge $paper for $query", ("paper", "query"), ("level",)))
    assert prompts.get("judge").render(paper="P", query="Q") == "Judge P for Q" and prompts.get("judge").accepts({"level": 1})
    for bad in (lambda: prompts.get("judge").render(paper="P"), lambda: prompts.add(settings.Prompt("judge", ""))):
        with pytest.raises(ValueError):
            bad()
    (tmp_path / "b.csv").write_text("q\n1\n")
    assert [r.name for r in settings.datasets(spark, str(tmp_path)).collect()] == ["b.csv", "c.json"]


def test_feedback_makes_new_searches(spark):
    from lodestone.planning import feedback

    found = rows(spark, [(1, 1, "Graph neural nets for molecules; graph neural nets scale"), (1, 2, "the molecules of proteins")], "q int, rank int, text string")
    terms = feedback.candidate_terms(found, "q", "text")
    got = [(r.term, r.weight) for r in sorted(terms.collect(), key=lambda r: r["rank"])]
    assert got == [("graph neural", 4), ("neural nets", 4), ("graph neural nets", 4), ("graph", 2), ("neural", 2), ("nets", 2), ("molecules", 2)]
    asked = rows(spark, [(1, "Graph neural models", None, ["x"])], "q int, search string, required array<string>, optional array<string>")
    topics = rows(spark, [(1, "chemistry")], "q int, topic string")
    made = feedback.feedback_queries(asked, terms, topics, "q").collect()
    assert [r.search for r in sorted(made, key=lambda r: r.nth)] == ["chemistry neural nets", "chemistry graph neural nets", "chemistry nets"]


def test_corpus_and_vectors_are_stored(spark, tmp_path):
    from lodestone.sources import stores

    path = str(tmp_path / "corpus")
    assert stores.read_corpus(spark, path) is None
    rows_in = rows(spark, [("1", "On Graphs", None, ["a", "b", "a"]), ("2", "123", "x", [])], "arxiv_id string, title string, abstract string, references array<string>")
    stores.write_corpus(rows_in, path)
    assert [tuple(r) for r in stores.read_corpus(spark, path).collect()] == [("1", "On Graphs", "", "a b", "ongraphs")] and stores.read_corpus(spark, path, False) is None
    embed = lambda df: df.select("arxiv_id", F.array(F.length("text").cast("float")).alias("embedding"))
    vectors = str(tmp_path / "vectors")
    assert [stores.append_vectors(rows_in.filter("arxiv_id = '1'"), vectors, "arxiv_id", embed), stores.append_vectors(rows_in, vectors, "arxiv_id", embed), stores.append_vectors(rows_in, vectors, "arxiv_id", embed)] == [1, 1, 0]
    titles = rows(spark, [("1", "On Graphs"), ("2", " ")], "arxiv_id string, title string")
    assert [r.title for r in stores.vector_index(spark.read.parquet(vectors), titles).collect()] == ["On Graphs"]
    cache = rows(spark, [("t",)], "text string").select(stores.cache_key("m").alias("hash"), F.lit(1.0).alias("embedding"))
    assert [r.embedding for r in stores.with_cached_vectors(rows(spark, [("t",), ("u",)], "text string"), cache, "m").orderBy("text").collect()] == [1.0, None]
