"""The whole path from queries to recommended documents, and its planning half."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.operators import cutoffs, hooks
from lodestone.operators.search import ranked
from lodestone.planning import searches, understanding
from lodestone.plans.tables import table
from lodestone.plans.text_queries import hybrid_search


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as requests of several kinds."""
    opening = F.element_at(F.array(*map(F.lit, ("Find papers on ", "A survey of ", "compare ", "latest work on LLM ", ""))), (F.col("item_id") % 5 + 1).cast("int"))
    return table(spark, d, "benchmark").select("item_id", F.concat(opening, F.array_join(F.split("text", r"\s+"), " ")).alias("query"))


def query_plans(spark: SparkSession, d: str) -> DataFrame:
    plans = understanding.understand(_asked(spark, d))
    return plans.select("item_id", "language", "query_type", F.array_join("methods", ",").alias("methods"), F.array_join("entities", ",").alias("entities"), "research_topic")


def routed_searches(spark: SparkSession, d: str) -> DataFrame:
    made = searches.search_queries(searches.for_routing(understanding.understand(_asked(spark, d))), "item_id")
    return searches.routed(made, searches.routing_table(spark), "item_id").select("item_id", "provider", "route", "priority", "nth", "search")


def query_types(spark: SparkSession, d: str) -> DataFrame:
    return understanding.understand(_asked(spark, d)).groupBy("query_type").agg(F.count("*").alias("queries"))


def recommend(spark: SparkSession, d: str) -> DataFrame:
    """Plan, retrieve, fuse, score, review (fallback), rank, cut: the documents recommended for every request."""
    plans = understanding.understand(_asked(spark, d)).select("item_id", "query_type", F.size("must_have").alias("musts"))
    pool = hybrid_search(spark, d).select("item_id", F.col("doc_id"), F.col("score").alias("fused"))
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", T.first_line(F.col("text")).alias("title"))
    rows = pool.join(docs, "doc_id").join(plans, "item_id").withColumn("paper_id", F.col("doc_id").cast("string"))
    best = F.max("fused").over(Window.partitionBy("item_id"))
    rows = rows.withColumn("dense", F.col("fused") / best)
    local = S.prerank_score({"title": F.col("dense"), "source": F.lit(1.0) / 3, "citation": S.citation_score(F.col("n_chars")), "dense": F.col("dense")})
    rows = hooks.reviewed(rows.withColumn("local", local), "item_id", "local")
    parts = S.final_subscores({"level": F.col("level"), "prerank": F.col("local"), "dense": F.col("dense"), "citations": F.col("n_chars")})
    final = S.paper_score(parts, F.lit(0.0))
    p = S.calibrated(F.col("probability"), F.col("level"), F.col("local"), F.lit(2))
    scored = rows.withColumns({"final_score": F.round(final, 6), "p": p})
    order = ranked(scored, ["item_id"], [F.desc("final_score"), "doc_id"])
    k = cutoffs.expected_f1(order.select("item_id", "rank", "p", "query_type"), "item_id", "p")
    return order.join(k.select("item_id", "k"), "item_id").filter(F.col("rank") <= F.col("k")).select("item_id", "doc_id", "rank", "final_score", "level", F.col("p").alias("probability"))


QUERIES = {"query_plans": query_plans, "routed_searches": routed_searches, "query_types": query_types, "recommend": recommend}
ORACLE_SQL = {
    "query_types": """WITH q AS (SELECT item_id % 5 AS m, ['Find papers on ', 'A survey of ', 'compare ', 'latest work on LLM ', ''][item_id % 5 + 1] || array_to_string(regexp_split_to_array(text, '\\s+'), ' ') AS q FROM benchmark),
t AS (SELECT lower(q) AS q, q AS raw FROM q) SELECT CASE WHEN regexp_matches(q, 'survey|review') THEN 'survey' WHEN regexp_matches(q, 'comparison|compare') THEN 'method_comparison' WHEN regexp_matches(q, 'dataset|bench|eval') THEN 'dataset_constraint'
  WHEN regexp_matches(q, 'latest|recent|newest') THEN 'latest_work' WHEN regexp_matches(q, 'author|et al|written by|published by') AND len(list_filter(regexp_split_to_array(raw, '\\s+'), lambda w: len(w) > 4)) >= 5 THEN 'specific_paper'
  WHEN contains(q, 'papers on') THEN 'broad_topic' ELSE 'unknown' END AS query_type, count(*) AS queries FROM t GROUP BY 1""",
}
