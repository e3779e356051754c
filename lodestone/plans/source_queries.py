"""Queries over stores, streams' batch twins and the operators that need Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import repair
from lodestone.functions import text as T
from lodestone.operators import resolve, selection
from lodestone.operators.search import with_previous
from lodestone.plans.tables import table
from lodestone.sources import sessions
from lodestone.streaming import health


def _messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(
        F.concat(F.lit("a"), (F.col("conv_id") % 4).cast("string")).alias("agent"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("int").alias("ordinal"),
        "role", F.lit("").alias("ts"), F.col("text").alias("plain_text"), F.lit("w").alias("workspace"),
    )


def session_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of even number are written again with their first turn only."""
    store = _messages(spark, d)
    new = store.filter("session_id % 2 = 0 AND ordinal = 0").withColumn("workspace", F.lit("new"))
    out = sessions.upserted(store, new)
    return sessions.sessions(out).groupBy("agent", "workspace").agg(F.count("*").alias("sessions"), F.sum("message_count").alias("messages"))


def session_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Sessions exported as bundles and read back."""
    back = sessions.from_bundles(sessions.bundles(_messages(spark, d)))
    return back.select("agent", "session_id", F.col("ordinal").cast("long").alias("ordinal"), "role", F.md5("plain_text").alias("text_md5"))


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = health.windowed(e, "ts", "event_type", "1 day")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def user_visits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return health.visits(e, "ts", "user_id", "2 hours").groupBy("user_id").agg(F.count("*").alias("visits"), F.sum("n").alias("events"))


def noise_drop(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 1000).cast("long").alias("citations"))
    kept = selection.noise_dropped(rows, ["o_custkey"], F.col("o_orderkey") % 3 == 0, "citations", "o_orderkey")
    return kept.select("o_custkey", "o_orderkey")


def selection_budgets(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("exact_title", "survey", "dataset_constraint", "unknown")))
    per = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("pool"))
    kind = F.element_at(kinds, (F.col("o_custkey") % 4 + 1).cast("int"))
    return per.select("o_custkey", selection.selection_budget(kind, F.col("pool") * 5).cast("long").alias("budget"))


def admitted_queries(spark: SparkSession, d: str) -> DataFrame:
    routes = spark.createDataFrame([("R", "arxiv", 2), ("A", "arxiv", 2), ("N", "pubmed", 3)], "route string, provider string, cap int")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("route"))
    return selection.admitted(rows, routes, ["l_orderkey"], ["l_linenumber"]).groupBy("provider").agg(F.count("*").alias("admitted"))


def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """All order lines as records: equal part, supplier and quantity, or equal order and return flag, are one entity."""
    rows = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.concat_ws("|", "l_partkey", "l_suppkey", "l_quantity").alias("doi"),
        F.concat_ws("|", "l_orderkey", "l_returnflag").alias("arxiv_id"),
    )
    return resolve.resolve_entities(rows, ["doi", "arxiv_id"], "pos").groupBy("entity").agg(F.count("*").alias("records"))


def health_replay(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "timeout").when(F.col("event_type") == "signup", "server_error").otherwise("success")
    rows = e.select(F.concat(F.lit("p"), F.col("user_id") % 20).alias("provider"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"), kind.alias("kind"), F.col("value").alias("elapsed"), F.col("user_id").cast("int").alias("items"))
    out = health.replay(rows.select("provider", (F.col("us") / 1e6).alias("ts"), "kind", "elapsed", "items"))
    return out.groupBy("provider", "state").agg(F.count("*").alias("events"))


def rows_only_jsonrepair(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("Answer:\n```json\n{'id': "), F.col("doc_id").cast("string"), F.lit(", 'lang': '"), F.coalesce("lang", F.lit("")), F.lit("', 'x': [1, 2,],}\n```"))
    return table(spark, d, "documents").select("doc_id", repair.repair_json(raw).alias("json"))


def rows_only_seqmatch(spark: SparkSession, d: str) -> DataFrame:
    """How alike each document's first line is to that of the document before it in its language."""
    docs = table(spark, d, "documents").filter("lang IS NOT NULL").select("doc_id", "lang", T.first_line(F.col("text")).alias("title"))
    pairs = with_previous(docs.withColumn("title", F.struct("title")), "lang", "doc_id", "title", "before").filter("before IS NOT NULL")
    return pairs.select("doc_id", F.round(repair.title_similarity(F.col("title.title"), F.col("before.title")), 6).alias("similarity"))


def rows_only_pasa_greedy(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    keys = F.array(F.concat(F.lit("t"), F.col("l_partkey") % 40), F.concat(F.lit("a"), F.col("l_suppkey") % 30))
    rows = rows.select(F.col("o_custkey").alias("case_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), keys.alias("keys"), "l_returnflag")
    return resolve.greedy_score(rows.filter("l_returnflag <> 'R'").drop("l_returnflag"), rows.filter("l_returnflag = 'R'").drop("l_returnflag"), "case_id", "pos")


QUERIES = {
    "session_upsert": session_upsert, "session_bundle": session_bundle, "windowed_events": windowed_events, "user_visits": user_visits, "noise_drop": noise_drop, "selection_budgets": selection_budgets,
    "admitted_queries": admitted_queries, "entity_resolution": entity_resolution, "provider_health_replay": health_replay, "rows_only_jsonrepair": rows_only_jsonrepair, "rows_only_seqmatch": rows_only_seqmatch, "rows_only_pasa_greedy": rows_only_pasa_greedy,
}

ORACLE_SQL = {
    "session_upsert": "WITH m AS (SELECT 'a' || (conv_id % 4) AS agent, conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'new' ELSE 'w' END AS workspace FROM conversations WHERE conv_id % 2 = 1 OR turn = 0 OR conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 0)) SELECT agent, workspace, count(DISTINCT conv_id) AS sessions, count(*) AS messages FROM m GROUP BY 1, 2",
    "session_bundle": "SELECT 'a' || (conv_id % 4) AS agent, conv_id::VARCHAR AS session_id, turn AS ordinal, role, md5(text) AS text_md5 FROM conversations",
    "windowed_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "user_visits": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM events) SELECT user_id, sum(s)::BIGINT AS visits, count(*) AS events FROM g GROUP BY 1",
    "entity_resolution": """WITH RECURSIVE l AS (SELECT l_orderkey * 10 + l_linenumber AS id, concat_ws('|', l_partkey, l_suppkey, l_quantity) AS a, concat_ws('|', l_orderkey, l_returnflag) AS b FROM lineitem),
      e AS (SELECT x.id, y.id AS other FROM l x JOIN l y ON x.a = y.a UNION SELECT x.id, y.id FROM l x JOIN l y ON x.b = y.b),
      r AS (SELECT id, id AS other FROM l UNION SELECT r.id, e.other FROM r JOIN e ON e.id = r.other),
      n AS (SELECT id, min(other) AS entity FROM r GROUP BY 1) SELECT entity, count(*) AS records FROM l JOIN n USING (id) GROUP BY 1""",
    "noise_drop": "WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 = 0 AS noise, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 3 = 0 ORDER BY round(o_totalprice / 1000)::BIGINT, o_orderkey DESC) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE NOT (noise AND nth <= greatest(1, n // 5))",
    "selection_budgets": "SELECT o_custkey, least([40, 65, 50, 45][o_custkey % 4 + 1], count(*) * 5)::BIGINT AS budget FROM orders GROUP BY 1",
    "admitted_queries": "WITH r(route, provider, cap) AS (VALUES ('R', 'arxiv', 2), ('A', 'arxiv', 2), ('N', 'pubmed', 3)), x AS (SELECT provider, cap, row_number() OVER (PARTITION BY l_orderkey, provider ORDER BY l_linenumber) AS nth FROM lineitem JOIN r ON route = l_returnflag) SELECT provider, count(*) AS admitted FROM x WHERE nth <= cap GROUP BY 1",
}
