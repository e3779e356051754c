"""Steps that must not grow faster than their input: what their plans hold, and their results on copies."""

import pyarrow as pa
from helpers import DATA
from pyspark.sql import Row

from lodestone.functions import text
from lodestone.operators import cutoffs, evaluation, listwise, pools, resolve, search
from lodestone.planning import answers
from lodestone.plans import report_queries, tables
from lodestone.sources import cases, postings, vector_blocks


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exact_titles_meet_only_the_first_of_equal_letters(spark):
    asked = rows(spark, [(n, "A Title") for n in range(50)] + [(99, "Other")], "q int, text string")
    titles = rows(spark, [("atitle", f"{n:03}") for n in range(200)] + [("other", "x"), ("none", "y")], "title_key string, title string")
    out = pools.exact_titles(asked, titles, "q", "text", 2)
    assert sorted((r.q, r.title, r["rank"]) for r in out.collect()) == [(n, f"{k:03}", k + 1) for n in range(50) for k in (0, 1)] + [(99, "x", 1)]
    assert any("WindowGroupLimit" in line and "title_key" in line for line in plan_of(out).splitlines())


def test_key_pairs_of_copies_arent_shuffled(spark):
    left = [(1, ["a", "b", "b"]), (2, ["b", "b", "a"]), (3, ["c", None]), (4, []), (5, None), (6, ["x"]), (1, ["c"]), (None, ["a"])]
    right = [(10, ["b", "a"]), (11, ["a", "b", "z"]), (12, ["c", "b"]), (13, ["y"]), (14, [None])]
    a, b = rows(spark, left, "l int, keys array<string>"), rows(spark, right, "r long, keys array<string>")
    out = resolve.key_pairs(a, b, "l", "r")
    want = {}
    for n, own in left:
        for m, other in right:
            shared = sum(x == y for x in own or [] if x for y in other if y)
            if shared:
                want[n, m] = want.get((n, m), 0) + shared
    assert {(r.l, r.r): r.shared for r in out.collect()} == want and out.count() == len(want)
    plan = plan_of(out)
    assert plan.index("Repartition") < plan.index("Aggregate")


def test_key_pairs_come_in_cells_of_two_lists(spark, monkeypatch):
    for name, n in (("IDS_A_CELL", 8), ("IDS_A_RUN", 3), ("ROWS_HELD", 12), ("PAIRS_A_TASK", 500), ("SETS_TO_BROADCAST", 2)):
        monkeypatch.setattr(resolve, name, n, raising=False)
    left = [(n, ["a", "b", "a"]) for n in range(40)] + [(n, ["c"]) for n in (None, *range(40, 45))] + [(3, ["c", "d"]), (50, ["x"])]
    right = [(n, ["b", "a", None, f"own{n}"]) for n in range(30)] + [(n, ["c"]) for n in (*range(30, 50), None)]
    out = resolve.key_pairs(rows(spark, left, "l long, keys array<string>"), rows(spark, right, "r int, keys array<string>"), "l", "r")
    want = {(n, m): 3 for n in range(40) for m in range(30)} | {(n, m): 1 for n in (None, 3, *range(40, 45)) for m in (None, *range(30, 50))}
    assert {(r.l, r.r): r.shared for r in out.collect()} == want and out.count() == len(want)
    steps = [line for line in out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].splitlines() if "Generate explode" in line][:4]
    assert ["*(" in line for line in steps] == [True, True, False, False]  # compiled steps hold all rows that they make from one
    assert "RepartitionByExpression [_a_class" in plan_of(out) and ", 8" in plan_of(out)  # 3,747 pairs at most


def test_files_of_key_pairs_are_small(spark, tmp_path):
    ids = spark.range(400).withColumns({"k": text.F.col("id") % 2, "keys": text.F.expr("array(concat('k', id % 2))")})
    resolve.key_pairs(ids.select(text.F.col("id").alias("l"), "keys"), spark.range(8000).selectExpr("id * 7919 AS r", "array(concat('k', id % 2)) AS keys"), "l", "r").write.parquet(str(tmp_path / "pairs"))
    written = spark.read.parquet(str(tmp_path / "pairs"))
    assert written.count() == written.distinct().count() == 1_600_000 and written.filter("shared = 1 AND l % 2 = r % 2").count() == 1_600_000
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 600_000


def test_simulated_cutoffs_need_no_union(spark):
    curve = rows(spark, [(q, k, k % q == 0) for q in (1, 2, 3) for k in range(1, 7)], "q int, rank int, gold boolean")
    cuts = {"two": rows(spark, [(1, 2), (2, None), (9, 1)], "q int, k int"), "five": rows(spark, [(1, 5), (2, 5), (3, 5)], "q int, k int")}
    out = pools.simulated_cutoffs(curve, cuts, "q")
    assert {(r.q, r.approach): tuple(r)[2:] for r in out.collect()} == {
        (1, "two"): (2, 1.0, 0.3333, 0.5), (2, "two"): (None, 0.0, 0.0, 0.0),
        (1, "five"): (5, 1.0, 0.8333, 0.9091), (2, "five"): (5, 0.4, 0.6667, 0.5), (3, "five"): (5, 0.2, 0.5, 0.2857),
    }
    assert "Union" not in plan_of(out)


def test_bm25_deals_documents_once_and_by_their_words(spark, monkeypatch):
    docs = rows(spark, [(n, f"graph word{n % 7} graph") for n in range(300)] + [(300, None)], "id int, body string")
    terms = rows(spark, [(1, "graph"), (1, "word3"), (2, "word3")], "q int, token string")
    want = {(r.q, r.id): (round(r.score, 9), r.held) for r in search.bm25(docs, terms, "id", "body", "q").collect()}
    monkeypatch.setattr(search, "WORDS_A_TASK", 50)
    out = search.bm25(docs, terms, "id", "body", "q")
    assert {(r.q, r.id): (round(r.score, 9), r.held) for r in out.collect()} == want and len(want) == 343
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.rdd.getNumPartitions() == 18  # 900 words
    assert "hashpartitioning(q#" not in plan


def test_stored_postings_are_dealt_by_the_words_indexed(spark, tmp_path, monkeypatch):
    docs = rows(spark, [(n, f"graph word{n % 7} graph") for n in range(300)], "id int, body string")
    terms = rows(spark, [(1, "graph"), (2, "word3")], "q int, token string")
    monkeypatch.setattr(search, "WORDS_A_TASK", 50)
    postings.add_to_index(docs, "id", "body", f"file://{tmp_path}/index", buckets=2)
    out = postings.stored_bm25(spark, f"file://{tmp_path}/index", terms, "id", "q")
    assert out.count() == 343 and out.rdd.getNumPartitions() == 18  # 900 words


def test_pairs_of_queries_and_blocks_come_a_few_at_a_time(monkeypatch):
    known = vector_blocks.Bounds([Row(block=str(b), middle=[float(b), 1.0], radius=0.5, n=3) for b in range(20)])
    ids = list(range(100))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([[n / 50 - 1, 1.0] for n in ids]), pa.array([0] * 100), pa.array([float("-inf")] * 100)], ["query_id", "asked", "part", "floor"])
    whole = [pa.Table.from_batches(vector_blocks.chosen(known, batch, 5, 6, first)) for first in (True, False)]
    monkeypatch.setattr(vector_blocks, "PAIRS", 60)
    for first, want in zip((True, False), whole, strict=True):
        parts = list(vector_blocks.chosen(known, batch, 5, 6, first))
        assert max(p.num_rows for p in parts) <= 60 and pa.Table.from_batches(parts).to_pylist() == want.to_pylist()
    assert sum(t.num_rows for t in whole) == 100 * 20


def test_paired_lists_are_read_once(spark):
    out = cases.paired_cases(rows(spark, [('{"qid":"a","answers":["x",null,"z"],"answer_arxiv_id":["1","","3","4"]}',), ('{"answer":[],"answers":["y"]}',), ("{}",)], "value string"))
    assert [[tuple(g) for g in r.gold] for r in out.collect()] == [[("x", "1"), (None, None), ("z", "3")], [("y", None)], []]
    assert plan_of(out).count("from_json(") == 4


def test_attempts_are_stored_so_that_no_plan_holds_all_of_them(spark):
    candidates = rows(spark, [(q, str(n), "q", "t", "a", float(-n)) for q in (1, 2, 3) for n in range(1, 9)], "q int, paper_id string, query string, title string, abstract string, score double")
    papers, sizes = listwise.ranked_lists(candidates, "q", "score", report_queries.every_other_paper)
    assert {(r.q, int(r.paper_id), r.attempt) for r in papers.collect()} == {(q, n, 1) for q in (1, 2, 3) for n in (2, 4, 6, 8)} and sizes.count() == 3
    assert plan_of(papers).count("Join") <= 3 and plan_of(sizes).count("Join") <= 3


def test_score_lists_are_dealt_by_their_rows(spark, tmp_path, monkeypatch):
    data = [(n % 5 if n % 7 else None, n, 10.0 + n % 3) for n in range(60)] + [(9, 100, 1.0)]
    rows(spark, data, "o_custkey long, o_orderkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(tables, "ROWS_A_TASK", 5)
    out = tables.customer_scores(spark, str(tmp_path))
    assert plan_of(out).count("Join") == 0 and "RepartitionByExpression [o_custkey" in plan_of(out) and ", 11" in plan_of(out)  # 52 rows have a customer
    want = []
    for c in range(5):
        own = [(k, p) for q, k, p in data if q == c]
        top = max(p for _, p in own)
        want += [(c, k, s, n) for n, (s, k) in enumerate(sorted(((round(p / top, 6), k) for k, p in own), key=lambda x: (-x[0], x[1])), 1)]
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_components_look_up_edges_once_and_deal_them_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(resolve, "EDGES_A_TASK", 30)
    cuts = []
    data = [(n, n + 1) for n in range(100, 160)] + [(500, n) for n in range(501, 560)] + [(n, 900) for n in range(880, 900)] + [(7, 7), (None, 8), (600, 100)]
    out = resolve.components(rows(spark, data, "a long, b long"), lambda df: cuts.append(df) or df.checkpoint())
    want = {n: 100 for n in [*range(100, 161), 600]} | {n: 500 for n in range(500, 560)} | {n: 880 for n in range(880, 901)} | {7: 7, 8: 8, None: None}
    assert {r.node: r.component for r in out.collect()} == want and out.count() == len(want)
    plans = [plan_of(df) for df in cuts[1:]]
    assert plans and all(p.count("Join") == 1 and ", 5" in p for p in plans)  # 144 edges in 5 tasks


def test_keys_of_one_record_make_no_edges(spark):
    cuts = []
    out = resolve.resolve_entities(rows(spark, [(1, "x", "p"), (2, "y", "p"), (3, "z", None), (4, None, None)], "pos int, doi string, other string"), ["doi", "other"], "pos", lambda df: cuts.append(df.checkpoint()) or cuts[-1])
    assert {r.pos: r.entity for r in out.collect()} == {1: 1, 2: 1, 3: 3, 4: 4} and cuts[0].count() == 1


def test_greedy_cases_pass_as_streams(spark, monkeypatch):
    monkeypatch.setattr(resolve, "ROWS_A_TASK", 40)
    gold = [(c, n, [f"g{n}", f"h{n % 3}"]) for c in (None, *range(30)) for n in range(4)] + [(99, 1, [])]
    found = [(c, n, [f"g{n + (c or 0) % 3}"]) for c in (None, *range(30)) for n in range(4)] + [(77, 1, ["x"]), (78, 1, None)]
    schema = "q int, pos int, keys array<string>"
    out = resolve.greedy_score(rows(spark, found, schema), rows(spark, gold, schema), "q", "pos")
    # of gold, 3 shares h0 with 0 and goes
    want = {c: (3 - (c or 0) % 3, 1 + (c or 0) % 3, (c or 0) % 3) for c in (None, *range(30))} | {77: (0, 0, 0)}
    assert {r.q: tuple(r)[1:4] for r in out.collect()} == want
    assert "FlatMapGroups" not in plan_of(out) and ", 7" in plan_of(out)  # 252 rows


def test_answers_are_dealt_and_titles_read_once(spark, monkeypatch):
    plan = "q int, methods array<string>, research_topic string, entities array<string>"
    plans = rows(spark, [(n, ["Graph Nets"], "Deep Models", ["one two three four five"]) for n in range(40)], plan)
    asked = rows(spark, [(n, '{"title_queries": ["A Survey of Graphs", "find papers about graphs and more"]}' if n % 2 else "{}") for n in range(40)], "q int, answer string")
    monkeypatch.setattr(answers, "ANSWERS_A_TASK", 5)
    out = answers.recalled_queries(plans, asked, "q", "answer")
    want = {(n, 1, "A Survey of Graphs") for n in range(1, 40, 2)} | {(n, k, t) for n in range(0, 40, 2) for k, t in ((1, "Graph Nets: Deep Models"), (2, "one two three four five"))}
    assert {(r.q, r["rank"], r.search) for r in out.collect()} == want
    assert "RepartitionByExpression [q" in plan_of(out) and ", 8" in plan_of(out)
    assert plan_of(rows(spark, [("A",)], "c string").select(text.looks_like_title(text.F.col("c")).alias("t"))).count("regexp_extract_all") == 1


def test_gold_is_counted_item_by_item(spark):
    gold = rows(spark, [(1, 1, ["a", "b"]), (1, 2, ["b", "c"]), (1, 3, ["z"]), (1, 4, ["y"]), (2, 1, ["a"]), (3, 1, [None])], "q int, gold_id int, keys array<string>")
    found = rows(spark, [(1, 1, ["a"]), (1, 2, ["c", "x"]), (1, 3, ["z", "y"]), (1, 4, ["n", None]), (4, 1, ["a"])], "q int, rank int, keys array<string>")
    out = evaluation.scored_against_gold(found, gold, "q")
    assert {r.q: tuple(r)[1:4] for r in out.collect() if r.q != 3} == {1: (2, 4, 2), 2: (0, 0, 1)}
    assert "count(distinct" not in plan_of(out)


def test_lists_of_a_transfer_report_are_stored_once(spark):
    assert "parquet" not in plan_of(report_queries.transfer_report(spark, DATA))


def test_bounds_of_composed_cutoffs_are_stored(spark):
    lists = rows(spark, [(q, n, 1 / n, "survey") for q in (1, 2) for n in range(1, 9)], "q int, rank int, score double, query_type string")
    assert plan_of(cutoffs.score_gap(lists, "q", "score")).count("Join") == 0
    out = cutoffs.composed_k(lists, "q", "score", "score")
    assert plan_of(out).count("Join") <= 5 and out.count() == 2
