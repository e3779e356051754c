"""Queries over reports and model steps: constraints in the cut-off, call costs, transfer of gold, wordings, result pages, round reviews, ranked lists."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scoring
from lodestone.operators import cutoffs, evaluation, graphs, listwise, usage
from lodestone.operators.models import Client
from lodestone.planning import review
from lodestone.plans.ranking_queries import _EXPECTED, _typed
from lodestone.plans.tables import CUSTOMER_SCORES_SQL, PART_STATS_SQL, customer_scores, part_stats, table


def constrained_k(spark: SparkSession, d: str) -> DataFrame:
    """The controller's k where customers have none to six constraints."""
    rows = _typed(spark, d).withColumn("must", F.when(F.col("o_custkey") % 8 < 7, F.col("o_custkey") % 8))
    return cutoffs.expected_f1(rows, "o_custkey", "score", must_have="must")


def year_range(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose last year lies outside a range, open to one side for some."""
    k = F.col("p_partkey")
    first, last = F.when(k % 3 > 0, 1996), F.when(k % 5 > 0, F.lit(1997))
    return part_stats(spark, d).select("p_partkey", scoring.year_broken(F.col("year"), first, last).alias("broken"))


_PROMPTS = ("HIGHLY_RELEVANT_PAPERS", "give the relevance_level", "coverage_analysis", "审阅", "subqueries", "a QueryPlan", "nothing")


def model_calls(spark: SparkSession, d: str) -> DataFrame:
    """Turns as model calls, charged to the components that their prompts name."""
    n = F.col("conv_id") + F.col("turn")
    said = F.element_at(F.array(*map(F.lit, _PROMPTS)), (n % len(_PROMPTS) + 1).cast("int"))
    calls = table(spark, d, "conversations").select(F.concat(F.lit("m"), F.col("conv_id") % 2).alias("model"), (n / 4).alias("elapsed"), F.col("turn").cast("long").alias("tokens"), F.col("text").alias("system"), said.alias("user"))
    return usage.model_calls(calls, "model", "elapsed", "tokens", "system", "user")


def transfer_report(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as a pool, of which some are gold, some selected, some final."""
    rows = customer_scores(spark, d).select("o_custkey", "o_orderkey", "rank", F.array(F.col("o_orderkey").cast("string")).alias("keys")).checkpoint()
    k = F.col("o_orderkey")
    gold = rows.filter(k % 3 == 0).select("o_custkey", k.alias("gold_id"), "keys")
    return evaluation.transfer_report(rows.filter("rank <= 12"), rows.filter((F.col("rank") <= 12) & (k % 2 == 0)), rows.filter((F.col("rank") <= 6) & (k % 2 == 0)), gold, "o_custkey", (2, 5, 10))


def vocabulary_gap(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a brand, found under the flags of their lines as wordings; the brand's smallest part is sought by number and name."""
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("variant")).distinct()
    ids = F.array(F.concat(F.lit("https://arxiv.org/abs/"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("v2")), F.lit(None).cast("string"))
    results = lines.join(parts, "p_partkey").select("p_brand", "variant", F.col("p_partkey").alias("rank"), ids.alias("ids"), F.col("p_name").alias("title"))
    one = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("p"), F.min_by("p_name", "p_partkey").alias("n"))
    gold = one.select("p_brand", F.concat(F.lit("arXiv:"), F.lpad(F.col("p").cast("string"), 9, "0"), F.lit("v1")).alias("number"), F.when(F.col("p") % 2 == 0, F.upper("n")).alias("name"))
    return evaluation.vocabulary_gap(results, gold, "p_brand")


def _pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as jobs and their orders as papers, which cite the customer's other orders."""
    o = customer_scores(spark, d)
    jobs = o.groupBy(F.col("o_custkey").alias("job_id")).agg(F.concat(F.lit("What is known about the orders of customer "), F.first("o_custkey")).alias("query"))
    k = F.col("job_id")
    jobs = jobs.withColumns({"methods": F.transform(F.sequence(F.lit(0), (k % 7).cast("int")), lambda n: F.concat(F.lit("M"), n)), "datasets": F.when(k % 2 == 0, F.array(F.lit("D")))})
    key = F.col("o_orderkey")
    papers = o.select(
        F.col("o_custkey").alias("job_id"), (F.col("rank") - 1).cast("int").alias("place"), key.cast("string").alias("paper_id"), F.concat(F.lit("Order by m"), key % 7, F.lit(" number "), key).alias("title"),
        "score", (key % 400).alias("citations"), F.when(F.col("rank") <= 3, "highly_relevant").otherwise("supporting").alias("relevance"),
        F.array(F.concat(F.lit(" 10.1/"), F.col("rank") + 1), F.concat(F.lit("A"), F.col("rank") - 2)).alias("references"), F.concat(F.lit("10.1/"), F.col("rank")).alias("doi"), F.concat(F.lit("a"), F.col("rank")).alias("arxiv_id"),
    )
    return jobs, papers


def page_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graphs.page_nodes(*_pages(spark, d))


def page_edges(spark: SparkSession, d: str) -> DataFrame:
    return graphs.page_edges(*_pages(spark, d))


def page_stats(spark: SparkSession, d: str) -> DataFrame:
    return graphs.page_stats(*_pages(spark, d)).withColumn("core", F.array_join("core", ","))


def round_review(spark: SparkSession, d: str) -> DataFrame:
    """Searches of the next round for requests with the orders of a customer as papers found."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("papers"), F.slice(F.array_sort(F.collect_list("o_orderkey")), 1, 5).alias("candidates"))
    k = F.col("c_custkey")
    rounds = table(spark, d, "customer").select("c_custkey", (k % 4 + 1).alias("round"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("topic")).join(o, "c_custkey", "left").withColumn("candidates", F.col("candidates").cast("array<string>"))
    planned = review.next_round(review.reviewed_round(rounds))
    first = F.get("searches", F.lit(0))
    return planned.select("c_custkey", "next_action", "recall_risk", "hard_constraint_coverage", "need_citation_expansion", F.col("next_round").cast("long").alias("next_round"), first["query"].alias("search"), first["reason"].alias("search_reason"), F.array_join("seeds", ",").alias("seeds"))


def every_other_paper() -> Client:
    """A client without a network: scores papers of even number, and, when asked without abstracts, those whose number 5 does not divide."""

    def answer(prompt: str, seconds: float) -> str:
        papers = [json.loads(line) for line in prompt.splitlines()[2:]]
        chosen = [int(p["paper_id"]) for p in papers if (int(p["paper_id"]) % 2 == 0 if "abstract" in p else int(p["paper_id"]) % 5)]
        return json.dumps({"recommended_k": len(chosen), "ranked_papers": [{"paper_id": str(n), "listwise_score": n % 131 / 100, "relevance_level": "high" if n % 3 else "best"} for n in chosen]})

    return answer


def ranked_lists(spark: SparkSession, d: str, make_client: Callable[[], Client] = every_other_paper) -> DataFrame:
    """Orders of a customer, ranked as a list by a client without a network, in up to three attempts."""
    o = customer_scores(spark, d)
    rows = o.select("o_custkey", F.col("o_orderkey").cast("string").alias("paper_id"), F.lit("orders").alias("query"), F.lit("t").alias("title"), F.lit("abstract").alias("abstract"), (-F.col("rank")).alias("score"))
    papers, sizes = listwise.ranked_lists(rows, "o_custkey", "score", make_client)
    out = papers.join(sizes, "o_custkey")
    return out.select("o_custkey", F.col("paper_id").cast("long").alias("o_orderkey"), F.round("listwise", 6).alias("listwise"), "probability", "level", "confidence", F.col("attempt").cast("long").alias("attempt"), F.col("k").cast("long").alias("k"))


QUERIES = {
    "constrained_k": constrained_k, "year_range": year_range, "model_calls": model_calls, "transfer_report": transfer_report, "vocabulary_gap": vocabulary_gap, "page_nodes": page_nodes, "page_edges": page_edges,
    "page_stats": page_stats, "round_review": round_review, "ranked_lists": ranked_lists,
}

_COMPONENT = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(low, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in (*usage.PROMPT_COMPONENTS[:2], ("result_review", (*usage.PROMPT_COMPONENTS[2][1], usage.REVIEW_WORD)), *usage.PROMPT_COMPONENTS[3:])) + " ELSE 'other_llm_task' END"
_SAID = "[" + ", ".join(f"'{p}'" for p in _PROMPTS) + "]"
_PAGES = f"""{CUSTOMER_SCORES_SQL}, j AS (SELECT o_custkey AS job_id, count(*) AS n, least(5, o_custkey % 7 + 1) AS m FROM scores GROUP BY 1),
p AS (SELECT o_custkey AS job_id, rank - 1 AS place, o_orderkey AS k, o_orderkey::VARCHAR AS id, 'Order by m' || (o_orderkey % 7) || ' number ' || o_orderkey AS title, score, rank FROM scores WHERE rank <= 20),
mm AS (SELECT job_id, m, unnest(range(m)) AS nth FROM j)"""
_EDGES = """e AS (SELECT job_id, 'query_center' AS source, 'method_' || nth AS target, 'association' AS type, 1.0::DOUBLE AS weight FROM mm UNION ALL SELECT job_id, 'query_center', id, 'association', score FROM p
  UNION ALL SELECT job_id, id, 'method_' || nth, 'association', 0.8::DOUBLE FROM p JOIN mm USING (job_id) WHERE contains(lower(title), 'm' || nth)
  UNION ALL SELECT a.job_id, a.id, b.id, 'reference', 1.0::DOUBLE FROM p a JOIN p b ON a.job_id = b.job_id AND b.rank IN (a.rank + 1, a.rank - 2))"""
ORACLE_SQL = {
    "constrained_k": _EXPECTED.replace("FROM a JOIN prof USING (query_type)", "FROM a JOIN (SELECT o_custkey AS c, x.query_type AS t, x.least, greatest(1, prior * CASE WHEN o_custkey % 8 IN (4, 5, 6) THEN 0.7::DOUBLE WHEN o_custkey % 8 = 0 THEN 1.3::DOUBLE ELSE 1 END) AS prior FROM (SELECT DISTINCT o_custkey FROM a) CROSS JOIN prof x) px ON px.c = a.o_custkey AND px.t = a.query_type"),
    "year_range": f"WITH {PART_STATS_SQL} SELECT p_partkey, coalesce(p_partkey % 3 > 0 AND year < 1996, false) OR coalesce(p_partkey % 5 > 0 AND year > 1997, false) AS broken FROM part_stats",
    "model_calls": f"""WITH c AS (SELECT 'm' || (conv_id % 2) AS model, (conv_id + turn) / 4 AS elapsed, turn AS tokens, lower(coalesce(text, '') || chr(10) || {_SAID}[(conv_id + turn) % {len(_PROMPTS)} + 1]) AS low FROM conversations), x AS (SELECT *, {_COMPONENT} AS component FROM c)
      SELECT model, component, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(elapsed), 4) AS elapsed FROM x GROUP BY ROLLUP (model, component)""",
    "transfer_report": f"""WITH {CUSTOMER_SCORES_SQL}, a AS (SELECT o_custkey, count(*) AS g, {", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}" for k in (2, 5, 10, 12))}, count(*) FILTER (rank <= 12 AND o_orderkey % 2 = 0) AS s, count(*) FILTER (rank <= 6 AND o_orderkey % 2 = 0) AS f FROM scores WHERE o_orderkey % 3 = 0 GROUP BY 1)
      SELECT o_custkey, {", ".join(f"round(h{k} / g, 4) AS recall_at_{k}" for k in (2, 5, 10))}, round(s / g, 4) AS selector_recall, CASE WHEN h12 > 0 THEN round(f / h12, 4) ELSE 0 END::DOUBLE AS final_transfer FROM a""",
    "vocabulary_gap": """WITH r AS (SELECT DISTINCT p_brand, l_returnflag AS variant, p_partkey, p_name FROM part JOIN lineitem ON l_partkey = p_partkey), g AS (SELECT p_brand, min(p_partkey) AS p, arg_min(p_name, p_partkey) AS n FROM part GROUP BY 1),
      x AS (SELECT p_brand, variant, p_partkey, p_partkey = p OR (p % 2 = 0 AND (contains(lower(p_name), lower(n)) OR contains(lower(n), lower(p_name)))) AS met FROM r JOIN g USING (p_brand))
      SELECT p_brand, variant, count(*) AS results, min(p_partkey) FILTER (met) AS rank, count(*) FILTER (met) > 0 AS found FROM x GROUP BY 1, 2""",
    "page_nodes": f"""WITH {_PAGES}, q AS (SELECT job_id, substr('What is known about the orders of customer ' || job_id, 1, 30) || '...' AS label FROM j)
      SELECT job_id, 'query_center' AS id, 'topic' AS type, label, label AS short, 400.0::DOUBLE AS x, 300.0::DOUBLE AS y, 35.0::DOUBLE AS size FROM q
      UNION ALL SELECT job_id, 'method_' || nth, 'method', 'M' || nth, 'M' || nth, round(400 + 150 * cos(2 * pi() * nth / m), 6), round(300 + 150 * sin(2 * pi() * nth / m), 6), 20.0 FROM mm
      UNION ALL SELECT job_id, id, 'paper', title, CASE WHEN length(title) > 15 THEN substr(title, 1, 15) || '...' ELSE title END, round(400 + 300 * cos(2 * pi() * place / n + 0.3::DOUBLE), 6), round(300 + 300 * sin(2 * pi() * place / n + 0.3::DOUBLE), 6), round(15 + least(15, (k % 400) / 10) + 5 * score, 6) FROM p JOIN j USING (job_id)""",
    "page_edges": f"WITH {_PAGES}, {_EDGES} SELECT * FROM e",
    "page_stats": f"""WITH {_PAGES}, {_EDGES}, n AS (SELECT job_id, count(*) AS edges FROM e GROUP BY 1), c AS (SELECT job_id, count(*) AS papers, string_agg(id, ',' ORDER BY place) FILTER (rank <= 3) AS core FROM p GROUP BY 1)
      SELECT job_id, papers, m AS methods, CASE WHEN job_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS datasets, edges, 1::BIGINT AS clusters, core FROM j JOIN n USING (job_id) JOIN c USING (job_id)""",
    "round_review": f"""WITH o AS (SELECT o_custkey, count(*) AS n, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS seeds FROM orders GROUP BY 1), x AS (SELECT c_custkey, c_custkey % 4 + 1 AS r, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS t, coalesce(n, 0) AS n, coalesce(seeds, '') AS seeds FROM customer LEFT JOIN o ON o_custkey = c_custkey)
      SELECT c_custkey, CASE WHEN n > 0 AND r >= 3 THEN 'stop_search' ELSE 'continue_search' END AS next_action, CASE WHEN n >= 20 THEN 'low' ELSE 'medium' END AS recall_risk, CASE WHEN n >= 15 THEN 'high' ELSE 'medium' END AS hard_constraint_coverage, n > 0 AND n < 15 AS need_citation_expansion, r + 1 AS next_round,
        CASE WHEN n = 0 THEN '{review.NOTHING_FOUND}' ELSE t END AS search, CASE WHEN n = 0 THEN '{review.ASPECT_REASON}{review.NOTHING_FOUND}' WHEN t IS NOT NULL THEN '{review.TOPIC_REASON}' END AS search_reason, seeds FROM x""",
    "ranked_lists": f"""WITH {CUSTOMER_SCORES_SQL}, s AS (SELECT o_custkey, {", ".join(f"greatest(1, count(*) FILTER (rank <= {n}) // 2) <= count(*) FILTER (rank <= {n} AND o_orderkey % {m} {cmp})" + f" AS a{i}" for i, (n, m, cmp) in enumerate(((40, 2, "= 0"), (20, 2, "= 0"), (20, 5, "<> 0")), 1))} FROM scores GROUP BY 1),
      w AS (SELECT o_custkey, CASE WHEN a1 THEN 1 WHEN a2 THEN 2 WHEN a3 THEN 3 END AS attempt FROM s), x AS (SELECT o_custkey, o_orderkey, attempt FROM scores JOIN w USING (o_custkey) WHERE (attempt = 1 AND rank <= 40 AND o_orderkey % 2 = 0) OR (attempt = 2 AND rank <= 20 AND o_orderkey % 2 = 0) OR (attempt = 3 AND rank <= 20 AND o_orderkey % 5 <> 0))
      SELECT o_custkey, o_orderkey, round(least(1, (o_orderkey % 131) / 100), 6)::DOUBLE AS listwise, 0.0::DOUBLE AS probability, CASE WHEN o_orderkey % 3 > 0 THEN 'high' END AS level, 0.5::DOUBLE AS confidence, attempt::BIGINT AS attempt, least(50, count(*) OVER (PARTITION BY o_custkey)) AS k FROM x""",
}
