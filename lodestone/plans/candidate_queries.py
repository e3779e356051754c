"""Queries over candidate scores, gates and phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import candidates as C
from lodestone.plans.tables import PART_STATS_SQL, PASSAGES_SQL, part_stats, passages, table
from lodestone.plans.text_queries import BM25_SQL, _bm25

TAGS = ("title_exact", "title_like", "core_topic", "method_task", "evolved", "reference", "reference_expansion", "citation_expansion", "citation_note", "hyde", "query2doc", "hybrid", "entity_dataset", "other")


def _path():
    """None, one or two tags a part, by its number."""
    tags, k = F.array(*map(F.lit, TAGS)), F.col("p_partkey")
    one, two = F.element_at(tags, (k % 14 + 1).cast("int")), F.element_at(tags, (k % 5 + 1).cast("int"))
    return F.when(k % 9 == 0, F.array().cast("array<string>")).when(k % 2 == 0, F.array(one)).otherwise(F.array(one, two))


PATH_SQL = f"""tagged AS (SELECT *, CASE WHEN p_partkey % 9 = 0 THEN []::VARCHAR[] WHEN p_partkey % 2 = 0 THEN [{list(TAGS)}[p_partkey % 14 + 1]] ELSE [{list(TAGS)}[p_partkey % 14 + 1], {list(TAGS)}[p_partkey % 5 + 1]] END AS path FROM part_stats)"""


def rough_score(spark: SparkSession, d: str) -> DataFrame:
    rows = part_stats(spark, d).withColumn("path", _path())
    k = F.col("p_partkey")
    score = C.rough_score((k % 10) / 10, F.col("path"), F.col("citations"), k % 8, F.col("p_size") / 50, (k % 4 - 1) / 4)
    return rows.select("p_partkey", F.round(score, 6).alias("score"))


def evidence_score(spark: SparkSession, d: str) -> DataFrame:
    rows = part_stats(spark, d).withColumn("path", _path())
    k = F.col("p_partkey")
    score = C.evidence_score((k % 3) / 2, (k % 5) / 4, k % 2, k % 4, F.col("path"), (k % 4) / 3, F.col("year") + 20, F.col("citations"))
    return rows.select("p_partkey", F.round(score, 6).alias("score"), C.heuristic_level(k % 4, F.col("citations") * 10, F.col("year") + 20, k % 3 == 0).alias("level"))


def local_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Features and score of every part, its name as title, its type and brand as abstract, their parts as constraints."""
    rows = part_stats(spark, d).withColumns({"path": _path(), "abstract": F.concat_ws(" ", "p_type", "p_brand"), "source": F.when(F.col("p_partkey") % 4 > 0, F.element_at(F.array(*map(F.lit, ("arxiv", "", "pubmed"))), (F.col("p_partkey") % 3 + 1).cast("int")))})
    tagged = F.concat("path", F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("provider:arxiv"), F.lit("openalex:title"))).otherwise(F.array(F.lit("prov:s2"), F.lit("web:x"))))
    asked = C.text_constraints(F.array(F.col("p_type"), F.lit(" year >= 2020")), F.array(F.get(F.split("p_name", " "), F.lit(0)), F.lit("2021 < x"), F.lit("")), F.array(F.upper("p_type"), F.substring("p_brand", 2, 4), F.col("p_brand")))
    rows = rows.withColumns({"tags": tagged, "asked": asked, "words": C.evidence_tokens(F.concat_ws(" ", F.col("p_brand"), F.substring_index("p_name", " ", 2), F.lit("boxes STEEL glass")))})
    got = C.evidence_features(rows, "p_name", "abstract", F.col("words"), F.col("asked"), F.col("tags"), "source")
    score = C.evidence_score(*map(F.col, ("title_match", "abstract_match", "worded", "literal", "tags", "providers")), F.col("year") + 20, F.col("citations"))
    six = lambda c: F.round(c, 6).alias(c)
    got = C.local_selection(got.withColumn("score", F.round(score, 6)), "score")
    return got.select("p_partkey", "level", six("relevance_score"), six("constraint_score"), six("confidence"), F.size("missing").cast("long").alias("missing"), "score", six("title_match"), six("abstract_match"), F.col("worded").cast("long").alias("worded"), F.col("literal").cast("long").alias("literal"), six("providers"))


def three_phase_recall(spark: SparkSession, d: str) -> DataFrame:
    pool = _bm25(spark, d, 10)
    return C.phase_recall(passages(spark, d), {"pool": pool, "selection": pool.filter("rank <= 3"), "final": pool.filter("rank = 1")}, "item_id", "doc_id")


def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "ts", (F.col("user_id") % 25).alias("client"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type").isin("view", "click"), "success").otherwise("other").alias("kind"))
    out = C.breaker(e, "client", ["ts", "event_id"], "kind", most_errors=4)
    return out.groupBy("client").agg(F.max("errors").alias("worst"), F.count(F.when(F.col("open"), 1)).alias("open_events"))


# Words of two letters or more with their plurals cut, each once.
TOKENS_SQL = r"""list_distinct(list_transform(regexp_extract_all(lower({0}), '\b\w{{2,}}\b'), lambda w: CASE WHEN len(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y'
      WHEN len(w) > 4 AND regexp_matches(w, '(ches|shes|xes|zes)$') THEN w[:-3] WHEN len(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END))"""

QUERIES = {"rough_score": rough_score, "evidence_score": evidence_score, "local_evidence": local_evidence, "three_phase_recall": three_phase_recall, "circuit_breaker": circuit_breaker}
ORACLE_SQL = {
    "rough_score": f"""WITH {PART_STATS_SQL}, {PATH_SQL} SELECT p_partkey, round(CASE WHEN p_partkey % 10 > 0 THEN (p_partkey % 10) / 10 ELSE 0.5 END + 0.01 * greatest(len(path), 1) + 0.01 * ln(1 + citations)
      + coalesce(list_sum(list_transform(path, lambda p: CASE WHEN p = 'title_exact' THEN 1.0 WHEN p = 'title_like' THEN 0.2 WHEN p IN ('reference_expansion', 'citation_expansion') THEN 0.05 ELSE 0 END::DOUBLE)), 0) + least(0.1 * (p_partkey % 8), 0.5)::DOUBLE + 0.65 * (p_size / 50) + 0.35 * greatest(0, (p_partkey % 4 - 1) / 4), 6) AS score FROM tagged""",
    "evidence_score": f"""WITH {PART_STATS_SQL}, {PATH_SQL} SELECT p_partkey, round(least(1, 0.25 * ((p_partkey % 3) / 2) + 0.2 * ((p_partkey % 5) / 4) + least(0.15::DOUBLE * (p_partkey % 2) + 0.1::DOUBLE * (p_partkey % 4), 0.3::DOUBLE)
      + CASE WHEN list_contains(path, 'title_exact') THEN 0.6 WHEN list_contains(path, 'title_like') THEN 0.4 WHEN list_contains(path, 'core_topic') THEN 0.15 WHEN list_has_any(path, ['method_task', 'entity_dataset']) THEN 0.12 WHEN list_has_any(path, ['evolved', 'hybrid', 'query2doc', 'hyde']) THEN 0.1 WHEN len(path) > 0 THEN 0.05 ELSE 0 END::DOUBLE
      + 0.1 * ((p_partkey % 4) / 3) + CASE WHEN year + 20 >= 2023 THEN 0.05 WHEN year + 20 >= 2021 THEN 0.04 WHEN year + 20 >= 2019 THEN 0.03 WHEN year + 20 >= 2017 THEN 0.02 WHEN year IS NOT NULL THEN 0.01 ELSE 0 END::DOUBLE + least(0.008 * ln(1 + citations), 0.05)), 6) AS score,
      CASE WHEN s >= 0.5 THEN 'high' WHEN s >= 0.3 THEN 'medium' ELSE 'low' END AS level FROM (SELECT *, CASE WHEN p_partkey % 3 <> 0 THEN 0.35 ELSE round(least(0.2 * (p_partkey % 4), 0.4)::DOUBLE
      + least(CASE WHEN citations * 10 > 200 THEN 0.15 WHEN citations * 10 > 50 THEN 0.08 WHEN citations * 10 > 10 THEN 0.03 ELSE 0 END::DOUBLE + CASE WHEN year + 20 >= 2022 THEN 0.15 WHEN year + 20 >= 2020 THEN 0.08 ELSE 0 END::DOUBLE, 0.3), 6) END AS s FROM tagged)""",
    "local_evidence": f"""WITH {PART_STATS_SQL}, {PATH_SQL}, raw AS (SELECT p_partkey, citations, year, p_name AS title, p_type || ' ' || p_brand AS abstract, p_type,
      path || CASE WHEN p_partkey % 2 = 0 THEN ['provider:arxiv', 'openalex:title'] ELSE ['prov:s2', 'web:x'] END AS tags,
      CASE WHEN p_partkey % 4 > 0 THEN ['arxiv', '', 'pubmed'][p_partkey % 3 + 1] END AS source,
      [p_type, split_part(p_name, ' ', 1), upper(p_type), substr(p_brand, 2, 4), p_brand] AS named,
      p_brand || ' ' || split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) || ' boxes STEEL glass' AS wanted FROM tagged),
    once AS (SELECT *, list_filter(named, lambda c, i: NOT list_contains(list_transform(named[1:i - 1], lambda e: lower(trim(e))), lower(trim(c)))) AS uniq FROM raw),
    tok AS (SELECT *, {TOKENS_SQL.format("title")} AS t, {TOKENS_SQL.format("abstract")} AS a, {TOKENS_SQL.format("wanted")} AS q FROM once),
    con AS (SELECT p_partkey, trim(unnest(uniq)) AS c FROM once),
    met AS (SELECT p_partkey, count(*) FILTER (w) AS worded, count(*) FILTER (NOT w AND contains(lower(title || ' ' || abstract), lower(c))) AS literal
      FROM (SELECT *, len(ct) > 0 AND list_has_all(list_concat(t, a), ct) AS w FROM (SELECT tok.*, c, {TOKENS_SQL.format("c")} AS ct FROM tok JOIN con USING (p_partkey))) GROUP BY 1),
    f AS (SELECT p_partkey, citations, year, tags, len(uniq) AS asked, len(list_intersect(q, t)) / len(q) AS title_match, len(list_intersect(q, a)) / len(q) AS abstract_match, coalesce(worded, 0) AS worded, coalesce(literal, 0) AS literal,
      least(len(list_distinct(list_filter(CASE WHEN p_partkey % 2 = 0 THEN ['arxiv', 'openalex', source] ELSE ['s2', source] END, lambda p: p <> ''))) / 3, 1) AS providers FROM tok LEFT JOIN met USING (p_partkey)),
    s AS (SELECT p_partkey, asked, round(title_match, 6) AS title_match, round(abstract_match, 6) AS abstract_match, worded, literal, round(providers, 6) AS providers,
      round(least(1, 0.25 * title_match + 0.2 * abstract_match + least(0.15::DOUBLE * worded + 0.1::DOUBLE * literal, 0.3::DOUBLE)
      + CASE WHEN list_contains(tags, 'title_exact') THEN 0.6 WHEN list_contains(tags, 'title_like') THEN 0.4 WHEN list_contains(tags, 'core_topic') THEN 0.15 WHEN list_has_any(tags, ['method_task', 'entity_dataset']) THEN 0.12 WHEN list_has_any(tags, ['evolved', 'hybrid', 'query2doc', 'hyde']) THEN 0.1 ELSE 0.05 END::DOUBLE
      + 0.1 * providers + CASE WHEN year + 20 >= 2023 THEN 0.05 WHEN year + 20 >= 2021 THEN 0.04 WHEN year + 20 >= 2019 THEN 0.03 WHEN year + 20 >= 2017 THEN 0.02 WHEN year IS NOT NULL THEN 0.01 ELSE 0 END::DOUBLE + least(0.008 * ln(1 + citations), 0.05)), 6) AS score FROM f)
    SELECT p_partkey, title_match, abstract_match, worded, literal, providers, score, asked - worded - literal AS missing, round(least(score + 0.1, 0.9), 6) AS confidence,
      CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.2 THEN 'medium' WHEN score >= 0.08 THEN 'low' ELSE 'irrelevant' END AS level,
      round(greatest(score, CASE WHEN score >= 0.5 THEN 0.9 WHEN score >= 0.2 THEN 0.55 WHEN score >= 0.08 THEN 0.2 ELSE 0 END), 6) AS relevance_score,
      round(greatest((worded + literal) / asked, CASE WHEN score >= 0.5 THEN 0.75 WHEN score >= 0.2 THEN 0.45 WHEN score >= 0.08 THEN 0.2 ELSE 0 END), 6) AS constraint_score FROM s""",
    "three_phase_recall": f"""WITH {BM25_SQL}, {PASSAGES_SQL}, g AS (SELECT item_id, count(*) AS gold, count(rank) FILTER (rank <= 10) AS p, count(rank) FILTER (rank <= 3) AS s, count(rank) FILTER (rank = 1) AS f FROM gold LEFT JOIN bmr USING (item_id, doc_id) GROUP BY 1)
      SELECT item_id, gold, p AS pool_hits, round(p / gold, 4) AS pool_recall, s AS selection_hits, round(s / gold, 4) AS selection_recall, f AS final_hits, round(f / gold, 4) AS final_recall FROM g""",
    "circuit_breaker": """WITH e AS (SELECT event_id, ts, user_id % 25 AS client, CASE WHEN event_type = 'error' THEN 1 WHEN event_type IN ('view', 'click') THEN -1 ELSE 0 END AS step FROM events),
      w AS (SELECT *, sum(step) OVER (PARTITION BY client ORDER BY ts, event_id) AS walk FROM e), l AS (SELECT *, walk - least(0, min(walk) OVER (PARTITION BY client ORDER BY ts, event_id)) AS errors FROM w),
      o AS (SELECT *, max(errors) OVER (PARTITION BY client ORDER BY ts, event_id) >= 4 AS open FROM l) SELECT client, max(errors)::BIGINT AS worst, count(*) FILTER (open) AS open_events FROM o GROUP BY 1""",
}
