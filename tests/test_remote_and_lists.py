"""Requests, retries, round reviews, ranked lists, call components and settings files, with fixed answers and no network."""

import json
import sys
import threading
import time
import urllib.error

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.operators import evaluation, listwise, runs, search, usage, vectors
from lodestone.planning import review
from lodestone.sources import remote, settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


def refused(code):
    return urllib.error.HTTPError("http://x", code, "no", {}, None)


def paced(answers, **kw):
    """An Http over a list of answers and errors, with the waits it took."""
    waits, now = [], [0.0]

    def sleep(seconds):
        waits.append(seconds)
        now[0] += seconds

    def opener(url, headers, seconds):
        now[0] += 0.5
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    return remote.Http(opener=opener, clock=lambda: now[0], sleep=sleep, **kw), waits


def test_retries_wait_longer_each_time():
    http, waits = paced([refused(500), refused(429), "ok"])
    assert http.get("u") == "ok" and waits == [1.0, 4.0]
    http, waits = paced([TimeoutError(), urllib.error.URLError("x"), TimeoutError()], wait=20.0)
    with pytest.raises(TimeoutError):
        http.get("u")
    assert waits == [20.0, 30.0]
    http, waits = paced([refused(404), "late"])
    with pytest.raises(urllib.error.HTTPError):
        http.get("u")
    assert waits == []


def test_requests_keep_their_distance():
    http, waits = paced(["a", "b"], interval=2.0)
    assert [http.get("u"), http.get("u")] == ["a", "b"] and waits == [1.5]


def works():
    def opener(url, headers, seconds):
        item = {"id": url, "display_name": "Paper", "publication_year": 2020}
        return json.dumps({"results": [item, {**item, "display_name": "Second"}, {**item, "display_name": "Third"}]})

    return remote.Http(retries=0, opener=opener)


def test_works_search_and_exact_title(spark):
    ddl = "query_id int, search string, route string, first_year int, last_year int"
    asked = spark.createDataFrame([(1, 'graph "nets" & more', "core", 2019, None), (2, "x", "core", None, None)], ddl)
    got = remote.Works("http://w", works).search(asked, 2).collect()
    assert sorted((r.query_id, r["rank"], r.title) for r in got) == [(1, 1, "Paper"), (1, 2, "Second"), (2, 1, "Paper"), (2, 2, "Second")]
    urls = {r.query_id: r.paper_id for r in got}
    assert urls[1] == "http://w?search=graph+%22nets%22+%26+more&per-page=2&filter=from_publication_date%3A2019-01-01" and urls[2] == "http://w?search=x&per-page=2"
    titles = spark.createDataFrame([(1, "Attention Is All You Need"), (2, "find papers on graphs and nets")], "query_id int, search string")
    found = remote.Works("http://w", works).exact_title(titles, 5).collect()
    assert {r.query_id for r in found} == {1} and "title.search%3A%22Attention+Is+All" in found[0].paper_id


def test_a_refused_access_gives_way(spark):
    # PYTHONPATH and HOME are set where workers run, so they stand for keys
    turns = [remote.Access(params=(("first", "PYTHONPATH"),)), remote.Access(params=(("second", "HOME"),))]

    def http():
        def opener(url, headers, seconds):
            if "first=" in url:
                raise refused(429)
            return url

        return remote.Http(retries=0, opener=opener)

    asked = spark.createDataFrame([(1, "http://w?a=1"), (2, None)], "q int, u string").coalesce(1)
    rows = {r.q: (r.body, r.error) for r in remote.fetched(asked, ["q"], "u", http, turns).collect()}
    assert rows[2] == (None, None)
    assert rows[1][1] is None and rows[1][0].startswith("http://w?a=1&second=")


def test_scholar_and_articles(spark):
    def scholar():
        return remote.Http(opener=lambda url, headers, seconds: json.dumps({"data": [{"paperId": "s1", "title": url, "year": 2021, "authors": [{"name": "A"}], "externalIds": {"DOI": "10.1/x"}}]}))

    def articles():
        record = "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>a</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"

        def opener(url, headers, seconds):
            if "esearch" in url:
                return "<eSearchResult><IdList><Id>7</Id><Id>8</Id></IdList></eSearchResult>" if "cells" in url else "<eSearchResult><IdList/></eSearchResult>"
            return f"<PubmedArticleSet>{record}</PubmedArticleSet>" if "id=7%2C8" in url else ""

        return remote.Http(opener=opener)

    asked = spark.createDataFrame([(1, "cells", "core"), (2, "stars", "core")], "query_id int, search string, route string")
    got = remote.Scholar("http://s", scholar).search(asked, 3).collect()
    assert sorted((r.query_id, r["rank"], r.paper_id, r.doi) for r in got) == [(1, 1, "s1", "10.1/x"), (2, 1, "s1", "10.1/x")]
    assert [(r.query_id, r["rank"], r.paper_id, r.title) for r in remote.Articles("http://p/", articles).search(asked, 3).collect()] == [(1, 1, "7", "T")]
    assert not remote.Scholar("http://s", scholar, key="NO_SUCH_KEY_SET").available()


def test_round_without_papers_goes_on(spark):
    rounds = spark.createDataFrame([(1, 0, 3, "t", []), (2, 30, 3, "t", ["a", "b", "c", "d"]), (3, 10, 1, None, ["a"])], "q int, papers int, round int, topic string, candidates array<string>")
    seen = review.reviewed_round(rounds)
    got = {r.q: r for r in review.next_round(seen).collect()}
    assert [got[q].next_action for q in (1, 2, 3)] == ["continue_search", "stop_search", "continue_search"]
    assert [got[q].enough_candidates for q in (1, 2, 3)] == [False, True, False] and got[3].need_citation_expansion
    assert [[s.query for s in got[q].searches] for q in (1, 2, 3)] == [[review.NOTHING_FOUND], ["t"], []] and got[2].seeds == ["a", "b", "c"]
    suggested = seen.withColumns({"suggested_new_keywords": F.array(F.lit("x"), F.lit("y")), "missing_aspects": F.when(F.col("q") == 1, F.array(*[F.lit(str(n)) for n in range(7)]))})
    rows = review.new_searches(review.next_round(suggested), "q").collect()
    assert sorted((r.q, r.search) for r in rows) == [(1, str(n)) for n in range(5)] + [(2, "x y"), (3, "x y")]


def test_listed_answers(spark):
    answer = {"recommended_k": "99", "recommended_k_min": 7, "recommended_k_max": 3, "ranked_papers": [
        {"paper_id": "a", "listwise_score": 0.2}, {"paper_id": "a", "listwise_score": 1.7, "relevance_probability": "x", "relevance_level": "best", "should_include": True, "matched_aspects": ["m"]},
        {"paper_id": "b", "listwise_score": "bad", "confidence": -1}, {"paper_id": "unasked", "listwise_score": 1}, {"listwise_score": 1}]}
    answers = spark.createDataFrame([(1, json.dumps(answer)), (2, None), (3, "{}")], "q int, answer string")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "q int, paper_id string")
    got = {r.paper_id: tuple(r)[2:] for r in listwise.listed(answers, asked, "q").collect()}
    assert got == {"a": (1.0, None, None, 0.5, ["m"], True), "b": (0.0, 0.0, None, 0.0, [], None)}
    sizes = {r.q: (r.k, r.least, r.most) for r in listwise.wanted_sizes(answers, "q").collect()}
    assert sizes == {1: (50, 7, 7), 2: (10, 1, 20), 3: (10, 1, 20)}


def test_imagined_abstracts(spark):
    plans = spark.createDataFrame([(1, "why", "t", ["m"], None), (2, "how", None, None, None)], "q int, query string, topic string, methods array<string>, entities array<string>")
    client = lambda: lambda prompt, seconds: json.dumps({"hypothetical_abstract": prompt.splitlines()[-1]}) if "Methods" in prompt else "{}"
    assert [tuple(r) for r in listwise.imagined_abstracts(plans, "q", client).collect()] == [(1, "Methods: m")]


def test_prompt_components(spark):
    rows = [("You are", "QueryPlan"), ("StructuredSynthesis", "evidence"), (None, "请审阅"), ("Round 2", None), (None, None)]
    df = spark.createDataFrame(rows, "s string, u string")
    got = [r[0] for r in df.select(usage.prompt_component(F.col("s"), F.col("u"))).collect()]
    assert got == ["query_understanding", "synthesis", "result_review", "search_planning", "other_llm_task"]


def test_loose_numbers_and_titles(spark):
    gold = spark.createDataFrame([(1, "arXiv:2012.07805v2", None), (2, None, "A Title"), (3, None, None)], "q int, number string, name string")
    rows = [(1, "a", 1, ["10.1/z"], "x"), (1, "a", 2, ["https://arxiv.org/pdf/2012.07805v1.pdf"], "x"), (1, "b", 1, [None, "10.48550/ARXIV.2012.07805"], None), (2, "a", 1, [], "a title: and more"), (2, "b", 1, None, ""), (3, "a", 1, ["1"], "t")]
    got = {(r.q, r.variant): (r.results, r["rank"], r.found) for r in evaluation.vocabulary_gap(spark.createDataFrame(rows, "q int, variant string, rank int, ids array<string>, title string"), gold, "q").collect()}
    assert got == {(1, "a"): (2, 2, True), (1, "b"): (1, 1, True), (2, "a"): (1, 1, True), (2, "b"): (1, None, False), (3, "a"): (1, None, False)}


def test_overdue(spark):
    assert tuple(evaluation.overdue(spark.createDataFrame([(1.0,), (9.0,), (None,)], "s double"), "s", 5.0).first()) == (3, 1)


def test_taxonomy_and_configuration(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "t.yaml").write_text("acronyms:\n  RAG: [retrieval augmented generation]\ntask_synonyms:\n  ranking: [ordering, sorting]\n", encoding="utf-8")
    rows = settings.taxonomy(spark, tmp_path / "t.yaml").collect()
    assert sorted((r.section, r.term, r.place, r.synonym) for r in rows) == [("acronyms", "RAG", 0, "retrieval augmented generation"), ("task_synonyms", "ranking", 0, "ordering"), ("task_synonyms", "ranking", 1, "sorting")]
    assert settings.taxonomy(spark, tmp_path / "none.yaml").count() == 0
    (tmp_path / "s.yaml").write_text("llm:\n  timeout: 9\n", encoding="utf-8")
    assert settings.settings({"llm": {"timeout": 1, "mode": "auto"}}, tmp_path / "s.yaml", environ={"X_LLM_MODE": "off"}, prefix="x_") == {"llm": {"timeout": 9, "mode": "off"}}


def letters():
    """States: a token per word, (its length, 1); a text's padding does not count."""

    def encode(texts):
        words = [t.split() for t in texts]
        states, mask = np.full((len(texts), 9, 2), 99.0), np.zeros((len(texts), 9))
        for k, w in enumerate(words):
            for n, word in enumerate(w):
                states[k, n], mask[k, n] = (len(word), 1), 1
        return states, mask

    return encode


def test_embedded_takes_the_mean_of_tokens(spark):
    texts = spark.createDataFrame([(1, "a bbb"), (2, None), (3, ""), (4, "a bbb"), (5, "known")], "id int, t string")
    known = texts.filter("id = 5").selectExpr("sha2(t, 256) AS sha256", "array(7D, 8D) AS embedding")
    got = {r.id: r.embedding for r in vectors.embedded(texts, "id", "t", letters, known).collect()}
    assert got == {1: [2.0, 1.0], 2: None, 3: [0.0, 0.0], 4: [2.0, 1.0], 5: [7.0, 8.0]}


def test_references_count_as_a_field(spark):
    docs = spark.createDataFrame([(1, "alpha", None, ["beta gamma", "delta"]), (2, "beta", "alpha alpha", []), (3, "other", "words", None)], "d int, title string, text string, refs array<string>")
    terms = spark.createDataFrame([(1, "beta"), (2, "alpha")], "q int, token string")
    got = {(r.q, r.d): r.score for r in search.field_bm25(docs, terms, "d", {"title": 1.0, "text": 0.35, "refs": 1.0}, "q").collect()}
    mean = (4 + 3 + 2) / 3
    want = lambda tf, n: max(1e-6, np.log(1.5 / 2.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    assert got == {k: pytest.approx(round(v, 6), abs=1e-6) for k, v in {(1, 1): want(1, 4), (1, 2): want(1, 3), (2, 1): want(1, 4), (2, 2): want(0.7, 3)}.items()}


def test_cases_end_in_one_state_each(spark):
    def run(case):
        if case == "bad":
            raise ValueError("no")
        if case == "slow":
            spark.range(10**10).selectExpr("pow(id, 0.3) AS s").filter("sin(s) > 2").selectExpr("sum(s)").collect()
        return spark.range(5).count()

    seen = []
    got = runs.run_cases(spark, ["good", "bad", "slow", "good"], run, 8.0, 1, on_result=seen.append)
    assert [(o.case, o.state, o.value) for o in got] == [("good", "succeeded", 5), ("bad", "failed", None), ("slow", "timed_out", None), ("good", "succeeded", 5)]
    assert sorted(map(id, seen)) == sorted(map(id, got)) and "ValueError" in got[1].error


def test_a_stop_cancels_what_has_not_begun(spark):
    begun = threading.Event()

    def run(case):
        begun.set()
        time.sleep(0.3)

    got = runs.run_cases(spark, [1, 2, 3], run, 60.0, 1, should_stop=begun.is_set)
    assert [o.state for o in got] == ["succeeded", "cancelled", "cancelled"]
    with pytest.raises(ValueError, match="above 0"):
        runs.run_cases(spark, [], run, 0)


def test_works_expand_references_and_citations(spark, tmp_path):
    """A work that two seeds refer to is asked once; a dead one gives no row; only works' ids are asked."""
    log = tmp_path / "asked"
    log.mkdir()

    def http():
        def opener(url, headers, seconds):
            import uuid

            (log / uuid.uuid4().hex).write_text(url)
            if "W404" in url:
                raise refused(404)
            if "cites" in url:
                return json.dumps({"results": [{"id": f"c{k}", "display_name": f"Citing {k}"} for k in range(5)]})
            return json.dumps({"id": url, "display_name": "Work " + url.rsplit("/", 1)[-1], "publication_year": 2020})

        return remote.Http(retries=0, opener=opener)

    rows = [(1, ["http://x/W7", "w8", "W404", "W9"], "http://w/works?filter=cites:W1"), (2, [" W8 ", "", "doi:1", None], None), (3, None, ""), (4, [], "http://w/cites")]
    seeds = spark.createDataFrame(rows, "seed int, references array<string>, cited_by_url string")
    got = sorted((r.seed, r.route, r.position, r.title) for r in remote.Works("http://w/works", http).expand(seeds, 3).collect())
    refs = [(1, "reference_expansion", 1, "Work W7"), (1, "reference_expansion", 2, "Work W8"), (2, "reference_expansion", 1, "Work W8")]
    assert got == sorted(refs + [(s, "citation_expansion", k + 1, f"Citing {k}") for s in (1, 4) for k in range(3)])
    asked = sorted(p.read_text() for p in log.iterdir())
    assert asked == ["http://w/cites?per-page=3", "http://w/works/W404", "http://w/works/W7", "http://w/works/W8", "http://w/works?filter=cites:W1&per-page=3"]


def test_scholar_expands(spark):
    def http():
        def opener(url, headers, seconds):
            part = "citedPaper" if "/references?" in url else "citingPaper"
            return json.dumps({"data": [{part: {"paperId": f"{part}{k}", "title": url}} for k in range(2)] + [{part: None}, {part: {"title": "no id"}}]})

        return remote.Http(retries=0, opener=opener)

    seeds = spark.createDataFrame([(1, "DOI:10.1/a b"), (2, None), (3, "")], "seed int, lookup_id string")
    got = {(r.seed, r.route, r.position): (r.paper_id, r.title) for r in remote.Scholar("http://s/paper/search", http).expand(seeds, 9).collect()}
    assert set(got) == {(1, route, k) for route in ("reference_expansion", "citation_expansion") for k in (1, 2)}
    assert got[1, "reference_expansion", 1][0] == "citedPaper0" and got[1, "citation_expansion", 2][1].startswith("http://s/paper/DOI%3A10.1%2Fa+b/citations?fields=")


FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>{0}</title>
<entry><id>http://arxiv.org/abs/2401.1v2</id><title>Graph
  nets</title><summary> S </summary><published>2024-01-02T00:00:00Z</published><author><name>N</name></author><author><name> </name></author></entry>
<entry><title>No id</title><published>soon</published></entry><entry><id>x/3</id></entry></feed>"""


def test_preprints_search_and_exact_title(spark):
    def http():
        def opener(url, headers, seconds):
            if "broken" in url:
                return "<feed><entry>"
            return "<feed/>" if "nothing" in url else FEED.replace("{0}", url.replace("&", "&amp;"))

        return remote.Http(retries=0, opener=opener)

    asked = spark.createDataFrame([(1, "graph nets"), (2, "the of"), (3, "nothing"), (4, "broken")], "query_id int, search string")
    found = remote.Preprints("http://a", http).search(asked, 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.paper_id, r.title, r.year, r.arxiv_id, r.authors, r.published) for r in found if r.query_id == 1] == [
        (1, 1, "http://arxiv.org/abs/2401.1v2", "Graph nets", 2024, "2401.1v2", ["N"], "2024-01-02"), (1, 2, "No id", "No id", None, None, [], "soon")
    ]
    assert {r.query_id for r in found} == {1, 2}
    titles = spark.createDataFrame([(1, "A \n title"), (2, " ")], "query_id int, search string")
    assert {r.query_id for r in remote.Preprints("http://a", http).exact_title(titles).collect()} == {1}


def test_calls_within_a_budget(spark):
    from lodestone.operators import models

    rows = spark.createDataFrame([("a", k) for k in range(4)] + [("b", 0), (None, 1)], "q string, n int")
    used = spark.createDataFrame([("a", 1), (None, 3)], "q string, calls int")
    got = {(r.q, r.n): r.reserved for r in models.within_budget(rows, ["q"], ["n"], 3, used).collect()}
    assert got == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("a", 3): False, ("b", 0): True, (None, 1): False}
    assert models.within_budget(rows, ["q"], ["n"], 2).filter("reserved").count() == 4


def test_batches_are_reviewed_in_steps(spark):
    """q answers at once but for one paper; h only in halves, the first; t with short abstracts; l with local features; n never; two papers are not halved."""
    from lodestone.operators import models

    def client():
        def answer(prompt, seconds):
            papers = json.loads(prompt)["papers"]
            ids, longest = [p["paper_id"] for p in papers], max(len(p["abstract"]) for p in papers)
            judged = lambda names: json.dumps({"selections": [{"paper_id": "other"}] + [{"paper_id": n, "relevance_level": v} for v in ("low", "high") for n in names]})
            kind = ids[0][0]
            if kind == "q":
                return judged(ids[1:])
            if kind == "h":
                return judged(ids) if ids[0] == "h0" and len(ids) == 4 else "[]"
            if kind == "t":
                return judged(ids) if longest == 200 else '{"selections": "none"}'
            if kind == "l":
                return judged(ids[:1]) if "local" in papers[0] and longest == 100 else "{}"
            raise TimeoutError("late")

        return answer

    rows = [(kind, f"{kind}{k}", k, "T", "word " * 300, 0.5) for kind, n in (("q", 11), ("h", 8), ("t", 2), ("l", 3), ("n", 3)) for k in range(n)]
    extra = ["CAST(NULL AS int) AS year", "CAST(NULL AS string) AS venue", "CAST(NULL AS int) AS citation_count", "array('x') AS retrieval_path"]
    papers_ = spark.createDataFrame(rows, "q string, paper_id string, pos int, title string, abstract string, local double").selectExpr("*", *extra)
    got = models.reviewed_in_steps(papers_, "q", ["pos"], client, features=["local"], most=10).collect()
    steps = {}
    for r in got:
        steps.setdefault((r.q, r.step), set()).add(r.paper_id)
        assert json.loads(r.selection)["relevance_level"] == "high"
    assert steps == {("q", 1): {f"q{k}" for k in (1, 2, 3, 4, 5, 6, 7, 9)}, ("h", 2): {"h0", "h1", "h2", "h3"}, ("t", 3): {"t0", "t1"}, ("l", 4): {"l0"}}
    assert models.reviewed_in_steps(papers_.limit(0), "q", ["pos"], client).count() == 0
