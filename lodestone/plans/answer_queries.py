"""Queries over model answers, paired gold, guessed types and provider costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import cutoffs, pools, usage
from lodestone.planning import answers as A
from lodestone.plans.tables import CUSTOMER_SCORES_SQL, customer_scores, table
from lodestone.sources import cases

PLAN_ANSWERS = (
    '{"query_type":"survey","methods":["b","a"],"datasets":"none","entities":"x","language":"Chinese ","time_range":{"start_year":"2020","end_year":2021.9},"task":"t"}',
    "no json", '{"query_type":"nonsense"}', '{"methods":[1,"a"]}',
    '{"methods":null,"datasets":["d"],"uncertainty":7,"venues":true,"time_range":{"start_year":"20x"}}',
    "[]", None, '{"query_type":"unknown","methods":["prev2","m"],"language":"","time_range":[]}',
)
TITLE_ANSWERS = (
    '{"title_queries":["Deep Graph Networks for Molecules","short one","  A   Survey of Large\\n Language Models ",7,null]}', '["Attention Is All You Need","find papers about graphs and more of them"]',
    "none", '{"title_queries":"Deep Graph Networks for Molecules"}', "{}", None,
)
TERM_ANSWERS = ('{"term_queries":["graph learning","one"," spectral   filter "]}', '["safe policy search", 3]', '{"term_queries":"x y"}', None)


def _one_of(values: tuple, number: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(number) % len(values) + 1).cast("int"))


def _sql_one_of(values: tuple, number: str) -> str:
    quoted = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][{number} % {len(values)} + 1]"


def model_plans(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a query whose answer is one of eight shapes; every second customer's has a plan from before."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_custkey") % 5 == 0, "图 learning").otherwise("graph learning").alias("query"), _one_of(PLAN_ANSWERS, "o_orderkey").alias("answer"))
    texts = lambda *v: F.array(*map(F.lit, v))
    fallback = o.select("o_orderkey", F.lit("en").alias("language"), F.lit("broad_topic").alias("query_type"), texts("fm").alias("methods"), F.lit(1999).alias("start_year"))
    before = o.filter("o_custkey % 2 = 0").select("o_orderkey", F.lit("latest_work").alias("query_type"), texts("prev2", "prev1").alias("methods"), texts("v").alias("venues"))
    got = A.plans_of_answers(o, fallback, "o_orderkey", "query", "answer", before)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return got.select("o_orderkey", "from_model", "language", "query_type", "task", *map(joined, ("methods", "datasets", "entities", "venues", "uncertainty")), "start_year", "end_year")


def _plans(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.array(F.initcap("p_name")).alias("methods"), F.when(F.col("p_partkey") % 3 > 0, F.initcap("p_type")).alias("research_topic"), F.array(F.initcap(F.concat_ws(" ", "p_brand", "p_name", "p_type"))).alias("entities"), F.col("p_size").cast("int").alias("start_year"))


def title_queries(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "part").select("p_partkey", _one_of(TITLE_ANSWERS, "p_partkey").alias("answer")).filter("p_partkey % 7 > 0")
    return A.recalled_queries(_plans(spark, d), answers, "p_partkey", "answer").select("p_partkey", "rank", "search", "route", "priority", "start_year")


def term_queries(spark: SparkSession, d: str) -> DataFrame:
    answers = table(spark, d, "part").select("p_partkey", _one_of(TERM_ANSWERS, "p_partkey").alias("answer"))
    return A.recalled_queries(_plans(spark, d), answers, "p_partkey", "answer", A.TERM_QUERIES).select("p_partkey", "rank", "search", "route", "priority")


def paired_gold(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as answers of their order, numbered by line; every third id is missing and every fifth order has plain ids."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    listed = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    ids = F.slice(F.transform("l", lambda x: F.when(x["l_linenumber"] % 3 == 0, "").otherwise(F.concat(F.lit("id"), x["l_suppkey"]))), F.lit(1), (F.size("l") - F.col("l_orderkey") % 2).cast("int"))
    record = F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("qid"), F.lit("q").alias("query"), F.transform("l", lambda x: F.concat(F.lit("t"), x["l_partkey"])).alias("answers"), ids.alias("answer_arxiv_id")))
    found = cases.paired_cases(listed.select(record.alias("value")))
    flat = found.select(F.col("name").cast("long").alias("l_orderkey"), F.posexplode("gold").alias("place", "g"))
    return flat.select("l_orderkey", F.col("place").cast("long").alias("place"), "g.title", "g.arxiv_id")


REQUESTS = ("a Survey of x", "COMPARE a and b", "the newest benchmark", "recent work", "图 综述", "plain words", None)


def guessed_k(spark: SparkSession, d: str) -> DataFrame:
    """The rule-based cut-off where types are read from requests."""
    rows = customer_scores(spark, d).withColumn("query_type", cutoffs.guessed_type(F.when(F.col("o_custkey") % 4 == 0, "specific_paper").when(F.col("o_custkey") % 4 == 1, "unknown"), _one_of(REQUESTS, "o_custkey")))
    kinds = rows.select("o_custkey", "query_type").distinct()
    return cutoffs.dynamic_k(rows, "o_custkey", "score", "query_type").join(kinds, "o_custkey")


def provider_costs(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("event_type") == "view", F.concat(F.lit("retrieval.p"), F.col("user_id") % 5, F.lit(".route"))).when(F.col("event_type") == "click", "retrieval.").when(F.col("event_type") == "error", "retrieval").otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select(name.alias("component"), F.lit(1).alias("calls"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return usage.by_provider(rows, "component", ["calls", "cents"])


def recent_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    newest = pools.most_recent(e.withColumn("at", F.when(F.col("event_id") % 11 > 0, F.col("at"))), "at", ["event_id"], 3, ["user_id"])
    return newest.select("user_id", "event_id", "rank")


def _looks_like_title(c: str) -> str:
    """SQL of functions.text.looks_like_title for texts that are no requests."""
    words = f"regexp_extract_all({c}, '[A-Za-z][A-Za-z0-9\\-]*')"
    return f"(len({words}) BETWEEN 3 AND 24 AND (len({words}) >= 5 OR contains({c}, ':') OR len(list_filter({words}, lambda w: regexp_matches(w, '^[A-Z]'))) >= 3 OR len(list_filter({words}, lambda w: len(w) >= 2 AND w = upper(w))) > 0))"


_CAPS = lambda c: f"array_to_string(list_transform(string_split(lower({c}), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"
QUERIES = {
    "model_plans": model_plans, "title_queries": title_queries, "term_queries": term_queries, "paired_gold": paired_gold, "guessed_k": guessed_k, "provider_costs": provider_costs, "recent_events": recent_events,
}
ORACLE_SQL = {
    "model_plans": """WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, o_custkey % 2 = 0 AS b, o_custkey % 5 = 0 AS zh FROM orders), m AS (SELECT *, k IN (0, 4, 7) AS from_model FROM o)
      SELECT o_orderkey, from_model, CASE WHEN k = 0 OR k IN (4, 7) AND zh THEN 'zh' ELSE 'en' END AS language, CASE WHEN k = 0 THEN 'survey' WHEN k IN (4, 7) AND b THEN 'latest_work' ELSE 'broad_topic' END AS query_type, CASE WHEN k = 0 THEN 't' END AS task,
        CASE k WHEN 0 THEN CASE WHEN b THEN 'b,a,prev1,prev2' ELSE 'b,a' END WHEN 4 THEN CASE WHEN b THEN 'prev1,prev2' ELSE '' END WHEN 7 THEN CASE WHEN b THEN 'prev2,m,prev1' ELSE 'prev2,m' END ELSE 'fm' END AS methods,
        CASE WHEN k = 4 THEN 'd' ELSE '' END AS datasets, CASE WHEN k = 0 THEN 'x' ELSE '' END AS entities, CASE WHEN k = 4 THEN CASE WHEN b THEN 'True,v' ELSE 'True' END WHEN k IN (0, 7) AND b THEN 'v' ELSE '' END AS venues,
        CASE WHEN k = 4 THEN '7' ELSE '' END AS uncertainty, CASE WHEN k = 0 THEN 2020 WHEN from_model THEN NULL ELSE 1999 END AS start_year, CASE WHEN k = 0 THEN 2021 END AS end_year FROM m""",
    "title_queries": f"""WITH p AS (SELECT p_partkey, p_size::INTEGER AS start_year, p_partkey % 6 AS k, {_CAPS("p_name")} AS m, CASE WHEN p_partkey % 3 > 0 THEN {_CAPS("p_type")} END AS topic, {_CAPS("p_brand || ' ' || p_name || ' ' || p_type")} AS e FROM part WHERE p_partkey % 7 > 0),
      t AS (SELECT p_partkey, start_year, CASE k WHEN 0 THEN ['Deep Graph Networks for Molecules', 'A Survey of Large Language Models'] WHEN 1 THEN ['Attention Is All You Need']
        ELSE list_filter(list_filter([CASE WHEN topic IS NULL THEN m || ' ' || e ELSE m || ': ' || topic END, e, topic], lambda x: x IS NOT NULL), lambda x: {_looks_like_title("x")} AND len(string_split(x, ' ')) >= 3) END AS l FROM p)
      SELECT p_partkey, rank, left(l[rank], 180) AS search, 'title_like' AS route, 8 AS priority, start_year FROM (SELECT *, unnest(range(1, len(l) + 1)) AS rank FROM t)""",
    "term_queries": """SELECT p_partkey, rank, l[rank] AS search, 'broad_synonym' AS route, 6 AS priority FROM (SELECT p_partkey, l, unnest(range(1, len(l) + 1)) AS rank
      FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['graph learning', 'spectral filter'] WHEN 1 THEN ['safe policy search'] ELSE [] END AS l FROM part))""",
    "paired_gold": """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
      SELECT l_orderkey, place, 't' || l_partkey AS title, CASE WHEN l_linenumber % 3 > 0 AND (l_orderkey % 2 = 0 OR place < n - 1) THEN 'id' || l_suppkey END AS arxiv_id FROM l""",
    "guessed_k": f"""WITH {CUSTOMER_SCORES_SQL}, t AS (SELECT *, CASE WHEN o_custkey % 4 = 0 THEN 'specific_paper' ELSE ['survey', 'method_comparison', 'dataset_constraint', 'latest_work', 'survey', 'unknown', 'unknown'][o_custkey % 7 + 1] END AS query_type FROM scores),
      a AS (SELECT o_custkey, query_type, count(*) AS n, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 2) AS gap, count(*) FILTER (score >= 0.4) AS good FROM t GROUP BY 1, 2)
      SELECT o_custkey, query_type, least(12, CASE query_type WHEN 'specific_paper' THEN CASE WHEN gap >= 0.15 THEN 1 ELSE least(2, n) END WHEN 'method_comparison' THEN least(6, n) WHEN 'dataset_constraint' THEN least(6, n)
        WHEN 'unknown' THEN CASE WHEN good > 0 THEN least(good, 20) ELSE least(5, n) END ELSE least(10, n) END)::BIGINT AS k FROM a""",
    "provider_costs": """SELECT CASE WHEN event_type IN ('view', 'click') THEN 'retrieval' ELSE 'component' END AS kind, CASE event_type WHEN 'view' THEN 'p' || (user_id % 5) WHEN 'click' THEN '' WHEN 'error' THEN 'retrieval' ELSE event_type END AS name,
      count(*) AS calls, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2""",
    "recent_events": "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 11 > 0 THEN ts END DESC NULLS LAST, event_id) AS rank FROM events) WHERE rank <= 3",
}
