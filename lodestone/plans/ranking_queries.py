"""Queries over the star schema and events: fusion, vectors, scores, cut-offs, graphs, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.operators import cutoffs, graphs, pools, resolve, search, usage, vectors
from lodestone.operators.search import ranked
from lodestone.plans.tables import CUSTOMER_SCORES_SQL, PART_STATS_SQL, customer_scores, dealt, part_stats, table
from lodestone.sources import vector_blocks
from lodestone.sources.shared import new_folder


def _lists(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    rows = lines.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    out = ranked(rows, ["p_brand", "l_returnflag"], [F.desc("q"), "l_partkey"])
    return out.select("p_brand", "l_returnflag", F.col("l_partkey").alias("partkey"), (F.col("rank") - 1).alias("rank"))


def _fused(lists: DataFrame) -> DataFrame:
    fused = search.reciprocal_rank_fusion(lists, ["p_brand"], "partkey").withColumn("score", F.round("score", 9))
    return ranked(fused, ["p_brand"], [F.desc("score"), "partkey"], 10)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(_lists(spark, d).withColumn("weight", F.lit(1.0)))


def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _fused(_lists(spark, d).filter("l_returnflag <> 'R'").withColumn("weight", F.when(F.col("l_returnflag") == "A", 1.0).otherwise(1.5)))


RRF_SQL = """l AS (SELECT p_brand, l_returnflag, l_partkey AS partkey, row_number() OVER (PARTITION BY p_brand, l_returnflag ORDER BY sum(l_quantity) DESC, l_partkey) - 1 AS rank
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"""


def _hits(spark: SparkSession, d: str, k: int) -> DataFrame:
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return vectors.similar(v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, k)


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d, 5)


def blocked_topk(spark: SparkSession, d: str) -> DataFrame:
    """vector_topk out of stored blocks, of which those are skipped that cannot reach a query's fifth score."""
    vecs, path = table(spark, d, "embeddings").select("vec_id", "embedding"), new_folder(spark, "vectors")
    vector_blocks.write_blocks(vecs, path)
    asked = vecs.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_blocks.search_blocks(spark, asked, path, 5)[0]


def vector_multi(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d, 20).withColumn("query_group", F.col("query_id") % 3)
    return vectors.summed(hits, ["query_group"], "vec_id", 10)


def vector_recall(spark: SparkSession, d: str) -> DataFrame:
    label = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    hits = _hits(spark, d, 10).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked")), "query_id")
    good = F.count(F.when(F.col("label") == F.col("asked"), 1))
    return hits.groupBy("query_id").agg(F.round(good / F.count("*"), 4).alias("precision_at_10"))


VEC_SQL = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 6) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


def citation_score(spark: SparkSession, d: str) -> DataFrame:
    rows = part_stats(spark, d)
    return rows.select("p_partkey", F.round(S.citation_score(F.col("citations")), 6).alias("citation"), F.round(S.recency_score(F.col("year"), 2002), 6).alias("recency"))


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, Column]]:
    rows = part_stats(spark, d)
    size = F.col("p_size")
    return rows, {
        "title": size / 50, "constraint": F.when(size % 3 != 0, (size % 7) / 7), "source": F.when(size % 5 != 0, F.lit(1.0) / 3),
        "citation": S.citation_score(F.col("citations")), "recency": S.recency_score(F.col("year"), 2002), "dense": F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice") / 3000),
    }


FEATURES_SQL = """f AS (SELECT *, p_size / 50 AS title, CASE WHEN p_size % 3 <> 0 THEN (p_size % 7) / 7 END AS constr, CASE WHEN p_size % 5 <> 0 THEN 1.0::DOUBLE / 3 END AS source,
  least(ln(1 + citations) / ln(501), 1) AS citation, CASE WHEN year IS NULL THEN 0.4 ELSE greatest(0, 1 - 0.08::DOUBLE * greatest(0, 2002 - year)) END AS recency,
  CASE WHEN p_partkey % 2 = 0 THEN p_retailprice / 3000 END AS dense FROM part_stats),
pr AS (SELECT *, (0.18 * title + coalesce(0.28 * constr, 0) + coalesce(0.12 * source, 0) + 0.08 * citation + 0.04 * recency + coalesce(0.12 * dense, 0))::DOUBLE
  / (0.18 + 0.08 + 0.04 + CASE WHEN constr IS NULL THEN 0 ELSE 0.28 END + CASE WHEN source IS NULL THEN 0 ELSE 0.12 END + CASE WHEN dense IS NULL THEN 0 ELSE 0.12 END)::DOUBLE AS prerank FROM f)"""


def prerank(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _features(spark, d)
    return rows.select("p_partkey", F.round(S.prerank_score(features), 6).alias("score"))


def final(spark: SparkSession, d: str) -> DataFrame:
    """Final scores from all subscores, both weight sets, bonuses and caps, ranked within brands."""
    rows, f = _features(spark, d)
    k, size = F.col("p_partkey"), F.col("p_size")
    path = F.slice(F.array(F.lit("provider:a"), F.lit("route:title_like"), F.lit("route:biomedical")), F.lit(1), (k % 4).cast("int"))
    rows = rows.withColumns({"prerank": S.prerank_score(f), "path": F.when(k % 10 == 0, F.array(F.lit("title_exact"))).otherwise(path), "dense": f["dense"], "vector": (size - 25).cast("double")})
    rows = rows.withColumns({"level": S.level_of_score(F.round(F.col("prerank") * (k % 3) / 2, 12)), "dense": S.dense_of_pool(F.col("dense"), F.col("vector"), "p_brand")})
    text = F.concat(F.col("p_name"), F.when(k % 5 == 0, " RNA therapy").when(k % 5 == 1, " mRNA").otherwise(""))
    parts = S.final_subscores({
        "level": F.col("level"), "dense": F.col("dense"), "vector": F.col("vector"), "matched": size % 4, "missing": size % 3, "evidence": F.when(size % 5 > 0, (size % 10) / 8), "quotes": k % 2,
        "path": F.col("path"), "year": F.col("year") + 20, "citations": F.col("citations"), "linked": k % 3 == 0, "listwise": F.when(k % 7 < 3, (k % 7) / 7), "prerank": F.col("prerank"),
    })
    score = S.paper_score(parts, S.title_bonus(F.col("path")), S.biomedical_bonus(F.col("path"), F.col("level"), text), F.when(k % 11 == 0, F.lit(0.4)))
    out = rows.select("p_brand", "p_partkey", "level", F.round(score, 6).alias("score"))
    return ranked(out, ["p_brand"], [F.desc("score"), "p_partkey"], 10)


def calibrate(spark: SparkSession, d: str) -> DataFrame:
    """Every level, with and without a prior, local signals and a confidence."""
    rows = table(spark, d, "customer").withColumn("s", (F.col("c_acctbal") + 1000) / 12000)
    k = F.col("c_custkey")
    level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "irrelevant", "unknown"))), (k % 5 + 1).cast("int"))
    prior, local, sure = F.when(k % 7 > 0, F.col("s")), F.when(k % 3 > 0, (k % 10) / 10), F.when(k % 4 == 0, (k % 11) / 10)
    return rows.select("c_custkey", F.round(S.logistic(F.col("s")), 6).alias("logistic"), S.calibrated(prior, level, local, k % 3, sure).alias("calibrated"))


def validate(spark: SparkSession, d: str) -> DataFrame:
    """The level ladder over every combination that order lines give."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "irrelevant"))), (k % 4 + 1).cast("int"))
    year = (F.col("l_orderkey") % 11 == 0) & (F.col("l_linenumber") % 3 > 0)
    out = S.validated_level(level, F.col("l_linenumber") % 3, (F.col("l_partkey") % 5 == 0).cast("int"), year, F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_orderkey") % 2 == 0, F.col("l_orderkey") % 5 == 0)
    return table(spark, d, "lineitem").select(level.alias("before"), out.alias("after")).groupBy("before", "after").agg(F.count("*").alias("n"))


VALIDATE_SQL = """WITH x AS (SELECT ['high', 'medium', 'low', 'irrelevant'][(l_orderkey + l_linenumber) % 4 + 1] AS level, l_linenumber % 3 AS failed, (l_partkey % 5 = 0)::INT AS before, l_orderkey % 11 = 0 AS y,
  l_discount * 10 AS e, l_tax * 10 AS c, l_orderkey % 2 = 0 AS hc, l_orderkey % 5 = 0 AS fb FROM lineitem),
a AS (SELECT *, CASE WHEN failed = 0 THEN level WHEN failed + before >= 2 OR y THEN 'low' WHEN level = 'high' THEN 'medium' WHEN level = 'medium' THEN 'low' ELSE 'irrelevant' END AS l1 FROM x),
b AS (SELECT *, CASE WHEN l1 = 'high' AND ((NOT fb AND e < 0.5) OR (hc AND c < 0.5)) THEN 'medium' ELSE l1 END AS l2 FROM a)
SELECT level AS before, CASE WHEN l2 = 'medium' AND NOT fb AND (e < 0.2 OR (c < 0.25 AND e < 0.5)) THEN 'low' ELSE l2 END AS after, count(*) AS n FROM b GROUP BY 1, 2"""


def fbeta(spark: SparkSession, d: str) -> DataFrame:
    out = cutoffs.f_beta_cutoff(customer_scores(spark, d), "o_custkey", "score")
    return out.select("o_custkey", "k", F.round("best", 6).alias("best"), F.round("tau", 6).alias("tau"))


def tier_partition(spark: SparkSession, d: str) -> DataFrame:
    return cutoffs.tiers(customer_scores(spark, d), "o_custkey", "score").groupBy("tier").agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"))


def score_gap(spark: SparkSession, d: str) -> DataFrame:
    return cutoffs.score_gap(customer_scores(spark, d), "o_custkey", "score", 0.08, 0.10, 20, 2)


def percentile_drop(spark: SparkSession, d: str) -> DataFrame:
    return cutoffs.percentile_drop(customer_scores(spark, d), "o_custkey", "score")


def _typed(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(p[0]) for p in cutoffs.PROFILES])
    return customer_scores(spark, d).withColumn("query_type", F.element_at(kinds, (F.col("o_custkey") % len(cutoffs.PROFILES) + 1).cast("int")))


def expected_f1(spark: SparkSession, d: str) -> DataFrame:
    return cutoffs.expected_f1(_typed(spark, d), "o_custkey", "score")


def dynamic_k(spark: SparkSession, d: str) -> DataFrame:
    return cutoffs.dynamic_k(_typed(spark, d), "o_custkey", "score", "query_type")


def composed(spark: SparkSession, d: str) -> DataFrame:
    rows = dealt(_typed(spark, d).checkpoint(), "o_custkey")  # what is stored forgets how it was dealt
    with_model = cutoffs.composed_k(rows, "o_custkey", "score", "score").withColumnRenamed("k", "model_k")
    return cutoffs.composed_k(rows, "o_custkey", "score").withColumnRenamed("k", "fallback_k").join(with_model, "o_custkey")


def tier_summary(spark: SparkSession, d: str) -> DataFrame:
    return cutoffs.tier_summary(cutoffs.tiers(customer_scores(spark, d), "o_custkey", "score"), "o_custkey", "score")


TYPED_SQL = "typed AS (SELECT *, [" + ", ".join(f"'{p[0]}'" for p in cutoffs.PROFILES) + "][o_custkey % 9 + 1] AS query_type FROM scores)"
PROFILE_SQL = "prof(query_type, prior, least) AS (VALUES " + ", ".join(f"('{n}', {p}::DOUBLE, {q}::DOUBLE)" for n, p, q, _ in cutoffs.PROFILES) + ")"
CURVE_SQL = """c AS (SELECT *, sum(score) OVER (PARTITION BY o_custkey ORDER BY rank) AS hits, sum(score) OVER (PARTITION BY o_custkey) AS total FROM scores)"""
FBETA_SQL = "fb{0} AS (SELECT o_custkey, min(rank) FILTER (f >= m - 1e-12) AS k, max(m) AS best FROM (SELECT *, max(f) OVER (PARTITION BY o_custkey) AS m FROM (SELECT *, {1} * hits / (rank + {2} * total) AS f FROM c)) GROUP BY 1)"


def refchain(spark: SparkSession, d: str) -> DataFrame:
    return graphs.expand(_seeds(spark, d), _edges(spark, d), 10)


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    top = part_stats(spark, d).orderBy(F.desc("citations"), "p_partkey").limit(20)
    return top.select(F.col("p_partkey").alias("seed"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive order lines cite each other's parts: forward as references, backward as citations."""
    a = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source"))
    b = a.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("source").alias("target"))
    one = a.join(b, ["l_orderkey", "l_linenumber"]).filter("source <> target").select("source", "target", F.col("l_orderkey").alias("position")).groupBy("source", "target").agg(F.min("position").alias("position"))
    back = one.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("citation").alias("route"), "position")
    return one.select("source", "target", F.lit("reference").alias("route"), "position").unionByName(back)


EDGES_SQL = f"""{PART_STATS_SQL}, seeds AS (SELECT p_partkey AS seed FROM part_stats ORDER BY citations DESC, p_partkey LIMIT 20),
one AS (SELECT a.l_partkey AS source, b.l_partkey AS target, min(a.l_orderkey) AS position FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2),
edges AS (SELECT source, target, 'reference' AS route, position FROM one UNION ALL SELECT target, source, 'citation', position FROM one)"""


def induced(spark: SparkSession, d: str) -> DataFrame:
    top = part_stats(spark, d).orderBy(F.desc("citations"), "p_partkey").limit(200).select(F.col("p_partkey").alias("node"))
    return graphs.induced(_edges(spark, d).filter("route = 'reference'"), top)


def link_prior(spark: SparkSession, d: str) -> DataFrame:
    top = part_stats(spark, d).orderBy(F.desc("citations"), "p_partkey").limit(200).select(F.col("p_partkey").alias("node"))
    return graphs.link_prior(top, _edges(spark, d))


def components(spark: SparkSession, d: str) -> DataFrame:
    """Components of parts and orders linked by order lines."""
    edges = table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("a"), (F.col("l_orderkey") * 2 + 1).alias("b"))
    return resolve.components(edges)


def key_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers that share a key: the residue of their numbers or the nation number and part size."""
    part = table(spark, d, "part").select("p_partkey", F.array(F.concat(F.lit("k"), F.col("p_partkey") % 50), F.concat(F.lit("s"), F.col("p_size"))).alias("keys"))
    supplier = table(spark, d, "supplier").select("s_suppkey", F.array(F.concat(F.lit("k"), F.col("s_suppkey")), F.concat(F.lit("s"), F.col("s_nationkey"))).alias("keys"))
    return resolve.key_pairs(part, supplier, "p_partkey", "s_suppkey")


def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Parts by every word that any part's type has; a word finds its parts by an equi-join, as all stand alone between blanks."""
    parts = table(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("t"))
    topics = table(spark, d, "part").select(F.explode(F.split(F.lower("p_type"), r"\s+")).alias("topic")).filter("topic <> ''").distinct()
    words = parts.select("p_partkey", F.explode_outer(F.array_distinct(F.split("t", r"\s+"))).alias("topic"))
    hits = words.join(topics.withColumn("known", F.lit(True)), "topic", "left")
    per = hits.groupBy("p_partkey").agg(F.max(F.coalesce("known", F.lit(False))).alias("any"))
    rest = per.filter("NOT any").select("p_partkey", F.lit("General").alias("topic"))
    return hits.filter("known").select("p_partkey", "topic").unionByName(rest).groupBy("topic").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first"))


def cutoff_filter(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return pools.before_cutoff(o, "day", o.agg(F.date_sub(F.max("day"), 7).alias("cutoff"))).select("o_orderkey", F.col("day").cast("string").alias("day"))


def publication_dates(spark: SparkSession, d: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyyMMdd")).when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "yyyy-MM")).when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "yyyy")).when(F.col("o_orderkey") % 5 == 3, F.date_format(day, "yyyy-MM-dd")).otherwise("soon")
    return table(spark, d, "orders").select("o_orderkey", T.publication_date(raw).cast("string").alias("published"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.min(F.to_date("ts")).cast("string").alias("first_day"))


def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d).withColumn("job", F.col("user_id") % 10)
    return usage.cost(e, ["event_type", "job"], "value", F.col("event_type") == "error")


def model_usage(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d).withColumn("model", F.concat(F.lit("m"), F.col("user_id") % 3))
    return e.groupBy("model").agg(F.count("*").alias("calls"), F.sum(F.greatest(F.lit(1), F.floor(F.col("value"))).cast("long")).alias("tokens"), F.round(F.sum("value"), 4).alias("elapsed"))


def run_latest(spark: SparkSession, d: str) -> DataFrame:
    out = usage.latest(_log(spark, d), "user_id", ["ts", "event_id"], "event_type")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", shown("started_at"), shown("updated_at"), "status", "updates")


STAGE_NAMES = ("planning", "listwise_rerank", "batch_llm", "llm_pool_reviewer", "selector", "retrieval", "evidence_synthesis")


def stage_budget(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.when(F.col("event_type") == "view", "retrieval.local").when(F.col("event_type") == "click", "retrieval.evidence").when(F.col("event_type") == "purchase", "Synthesis").otherwise(F.element_at(F.array(*map(F.lit, STAGE_NAMES)), (F.col("event_id") % len(STAGE_NAMES) + 1).cast("int"))))
    return usage.stages(_log(spark, d).withColumn("component", name), "component").groupBy("stage").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("elapsed"))


def provider_health(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d).withColumn("provider", F.col("user_id") % 20)
    out = usage.block_counters(e, "provider", ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "error", 30, 40)
    return out.groupBy("provider").agg(F.max("limits").alias("limits"), F.max("errors").alias("errors"), F.min(F.when(F.col("blocked"), F.col("event_id"))).alias("any_blocked"), F.count(F.when(F.col("blocked"), 1)).alias("blocked_events"))


def budget_reserve(spark: SparkSession, d: str) -> DataFrame:
    e = _log(spark, d).withColumn("provider", F.col("user_id") % 20).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return usage.reserved(e, "provider", ["ts", "event_id"], "cents", 500_000).groupBy("provider").agg(F.count(F.when(F.col("allowed"), 1)).alias("allowed"), F.max("used").alias("used"))


QUERIES = {
    "rrf_fusion": rrf_fusion, "rrf_weighted": rrf_weighted, "vector_topk": vector_topk, "blocked_topk": blocked_topk, "vector_multi": vector_multi, "vector_recall_at_k": vector_recall, "citation_score": citation_score,
    "prerank_score": prerank, "final_score": final, "calibrate": calibrate, "evidence_validation": validate, "fbeta_cutoff": fbeta, "tier_partition": tier_partition, "score_gap_k": score_gap,
    "percentile_drop_k": percentile_drop, "expected_f1_k": expected_f1, "dynamic_k_rules": dynamic_k, "composed_k": composed, "tier_summary": tier_summary, "refchain_expand": refchain, "induced_graph": induced, "link_prior": link_prior,
    "components": components, "key_overlap_join": key_overlap, "topic_clusters": topic_clusters, "cutoff_filter": cutoff_filter, "publication_dates": publication_dates, "parse_event_props": event_props,
    "cost_rollup": cost_rollup, "llm_usage": model_usage, "run_latest": run_latest, "stage_budget": stage_budget, "provider_health": provider_health, "budget_reserve": budget_reserve,
}

_RRF = "SELECT * FROM (SELECT p_brand, partkey, score, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, partkey) AS rank FROM (SELECT p_brand, partkey, round(sum({0} / (60 + rank)), 9) AS score FROM l {1} GROUP BY 1, 2)) WHERE rank <= 10"
_FINAL = f"""WITH {PART_STATS_SQL}, {FEATURES_SQL}, x AS (SELECT *, p_partkey AS k, CASE WHEN p_partkey % 10 = 0 THEN ['title_exact'] ELSE list_slice(['provider:a', 'route:title_like', 'route:biomedical'], 1, p_partkey % 4) END AS path,
  lower(p_name || CASE p_partkey % 5 WHEN 0 THEN ' RNA therapy' WHEN 1 THEN ' mRNA' ELSE '' END) AS words, round(prerank * (p_partkey % 3) / 2, 12) AS r, max(CASE WHEN dense IS NULL AND p_size > 25 THEN p_size - 25 END) OVER (PARTITION BY p_brand) AS best FROM pr),
lv AS (SELECT *, CASE WHEN r >= 0.5 THEN 'high' WHEN r >= 0.2 THEN 'medium' WHEN r >= 0.08 THEN 'low' ELSE 'irrelevant' END AS level, CASE WHEN k % 7 < 3 THEN (k % 7) / 7 ELSE 0 END AS listwise FROM x),
sub AS (SELECT *, CASE level WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.55 WHEN 'low' THEN 0.15 ELSE 0.0 END::DOUBLE AS relevance, coalesce(dense, CASE WHEN best IS NOT NULL THEN least((p_size - 25) / best, 1) END, p_size - 25)::DOUBLE AS bge,
  CASE WHEN p_size % 4 + p_size % 3 > 0 THEN (p_size % 4) / (p_size % 4 + p_size % 3) WHEN level IN ('high', 'medium') THEN 1 ELSE 0.5 END::DOUBLE AS coverage,
  CASE WHEN p_size % 5 > 0 AND p_size % 10 > 0 THEN least((p_size % 10) / 8, 1) WHEN level IN ('high', 'medium') AND k % 2 > 0 THEN 1 ELSE 0 END::DOUBLE AS evidence,
  CASE WHEN len(path) = 0 THEN 0.5 ELSE least(len(path) / 2, 1) END::DOUBLE AS agreement, CASE WHEN year IS NULL THEN 0.5 ELSE greatest(0, 1 - (2026 - (year + 20)) * 0.1::DOUBLE) END::DOUBLE AS fresh,
  least(citations / 100, 1)::DOUBLE AS authority, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS graph, CASE WHEN list_contains(path, 'title_exact') THEN 0.10 WHEN list_contains(path, 'route:title_like') THEN 0.03 ELSE 0 END::DOUBLE AS titles,
  CASE WHEN NOT list_contains(path, 'route:biomedical') OR NOT contains(words, 'rna') THEN 0 WHEN level = 'high' THEN CASE WHEN contains(words, 'rna therap') THEN 0.18 ELSE 0.08 END
    WHEN level = 'medium' THEN CASE WHEN contains(words, 'rna therap') THEN 0.09 ELSE 0.04 END ELSE 0 END::DOUBLE AS biomedical FROM lv),
w AS (SELECT *, CASE WHEN listwise > 0 THEN 0.50::DOUBLE * listwise + 0.15 * relevance + 0.12 * coverage + 0.08 * evidence + 0.05 * agreement + 0.04 * bge + 0.02 * fresh + 0.02 * authority + 0.02::DOUBLE * graph + titles
  ELSE 0.22 * relevance + 0.18 * prerank + 0.14 * bge + 0.15 * coverage + 0.10 * agreement + 0.09 * evidence + 0.04 * fresh + 0.03 * authority + 0.05::DOUBLE * graph + titles + biomedical END AS total FROM sub),
s AS (SELECT p_brand, p_partkey, level, round(least(greatest(least(total, 1), 0), CASE WHEN k % 11 = 0 THEN 0.4 ELSE 1 END::DOUBLE), 6) AS score FROM w)
SELECT p_brand, p_partkey, level, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS rank FROM s) WHERE rank <= 10"""
_CALIBRATE = """WITH x AS (SELECT c_custkey AS k, (c_acctbal + 1000) / 12000 AS s, ['high', 'medium', 'low', 'irrelevant', 'unknown'][c_custkey % 5 + 1] AS level FROM customer),
r(level, lo, hi) AS (VALUES ('high', 0.80::DOUBLE, 0.95::DOUBLE), ('medium', 0.40, 0.70), ('low', 0.08, 0.25), ('irrelevant', 0.0, 0.08), ('unknown', 0.0, 0.1)),
y AS (SELECT x.*, lo, hi, CASE WHEN k % 7 > 0 THEN s END AS model, CASE WHEN k % 3 > 0 THEN (k % 10) / 10 ELSE (lo + hi) / 2 END AS local,
  CASE WHEN k % 4 = 0 THEN least(greatest(0.3::DOUBLE + 0.4::DOUBLE * ((k % 11) / 10), 0.3::DOUBLE), 0.8::DOUBLE) ELSE 0.55::DOUBLE END AS a0 FROM x JOIN r USING (level)),
z AS (SELECT *, CASE WHEN k % 3 < 2 THEN greatest(a0, 0.65::DOUBLE) ELSE a0 END AS a FROM y),
f AS (SELECT *, least(least(1, hi + 0.05::DOUBLE), greatest(greatest(0, lo - 0.05::DOUBLE), a * coalesce(model, (lo + hi) / 2) + (1 - a) * local)) AS fused FROM z),
c AS (SELECT *, CASE WHEN coalesce(model, fused) < 0.35 AND level IN ('low', 'medium', 'unknown') THEN least(greatest(least(fused, 0.30, coalesce(model * 1.15::DOUBLE, 1)), 0), hi + 0.05::DOUBLE) ELSE fused END AS cooled FROM f)
SELECT k AS c_custkey, round(1 / (1 + exp(-(s - 0.5) / 0.12)), 6) AS logistic, round(CASE level WHEN 'low' THEN least(cooled, 0.15) WHEN 'irrelevant' THEN least(cooled, 0.05) ELSE cooled END, 4)::DOUBLE AS calibrated FROM c"""
_GAP = f"""WITH {CUSTOMER_SCORES_SQL}, g AS (SELECT *, score - lead(score) OVER (PARTITION BY o_custkey ORDER BY rank) AS gap FROM scores),
b AS (SELECT o_custkey, rank AS spot, row_number() OVER (PARTITION BY o_custkey ORDER BY gap DESC, rank) AS nth FROM g WHERE gap > 0.08 AND gap / greatest(score, 1e-6) > 0.10 AND rank <= 25)
SELECT s.o_custkey, CASE WHEN spot IS NOT NULL THEN least(20, greatest(2, spot)) END AS k FROM (SELECT DISTINCT o_custkey FROM scores) s LEFT JOIN b ON b.o_custkey = s.o_custkey AND nth = 1"""
_DROP = f"""WITH {CUSTOMER_SCORES_SQL}, r AS (SELECT *, lead(score) OVER (PARTITION BY o_custkey ORDER BY rank) AS nxt, least(20, count(*) OVER (PARTITION BY o_custkey)) AS rng, max(score) OVER (PARTITION BY o_custkey) AS top FROM scores),
q AS (SELECT *, CASE WHEN rank < rng AND score > nxt THEN score - nxt END AS gap FROM r WHERE rank <= rng),
a AS (SELECT o_custkey, max(rng) AS rng, max(top) AS top, list_sort(list(gap) FILTER (gap IS NOT NULL)) AS gaps, max(gap) AS largest, min(rank) FILTER (score < top * 0.85) AS below FROM q GROUP BY 1),
p AS (SELECT o_custkey, min(rank) AS spot FROM q JOIN a USING (o_custkey) WHERE gap = largest GROUP BY 1)
SELECT o_custkey, CASE WHEN gaps[len(gaps) // 2 + 1] > 0 AND largest / gaps[len(gaps) // 2 + 1] > 2.5 THEN greatest(greatest(1, rng // 4), least(spot, 20)) ELSE greatest(greatest(1, rng // 4), least(20, greatest(1, coalesce(below - 1, rng)))) END::BIGINT AS k FROM a LEFT JOIN p USING (o_custkey)"""
_EXPECTED = f"""WITH {CUSTOMER_SCORES_SQL}, {TYPED_SQL}, {PROFILE_SQL},
a AS (SELECT o_custkey, query_type, count(*) AS n, greatest(1, 0.35::DOUBLE * sum(CASE WHEN score >= 0.5 THEN 2 WHEN score >= 0.25 THEN 1 ELSE 0 END)) AS pool, sum(CASE WHEN score > 0.05 THEN score ELSE 0 END) AS vis, avg(score) FILTER (rank <= 10) AS mean, stddev_pop(score) FILTER (rank <= 10) AS spread FROM typed GROUP BY 1, 2),
g AS (SELECT o_custkey, least(n, 20, CASE WHEN n >= 3 AND mean < 0.35 AND spread < 0.05 THEN CASE WHEN query_type IN ('latest_work', 'broad_topic', 'survey') THEN 10 ELSE 5 END END) AS n, least, least(60, greatest(1, 0.5 * prior, CASE WHEN vis < 3 AND prior > 10 THEN 0.45::DOUBLE * prior + 0.35::DOUBLE * pool + 0.2::DOUBLE * vis WHEN vis > 8 THEN 0.25 * prior + 0.25 * pool + 0.5 * vis ELSE 0.35::DOUBLE * prior + 0.35::DOUBLE * pool + 0.3::DOUBLE * vis END)) AS g_hat FROM a JOIN prof USING (query_type)),
f AS (SELECT t.*, g_hat, n, least, round(2 * sum(score) OVER (PARTITION BY o_custkey ORDER BY rank) / (rank + g_hat), 4) AS f1 FROM typed t JOIN g USING (o_custkey)),
c AS (SELECT *, least(n, coalesce(min(CASE WHEN rank >= 2 AND score < least THEN rank - 1 END) OVER (PARTITION BY o_custkey), n)) AS cap FROM f),
m AS (SELECT *, max(f1) OVER (PARTITION BY o_custkey) AS best FROM c WHERE rank <= cap)
SELECT o_custkey, round(max(g_hat), 4) AS g_hat, max(rank) AS k, max(best) AS best FROM m WHERE round(best - f1, 6) <= 0.02 GROUP BY 1"""
_DYNAMIC = f"""WITH {CUSTOMER_SCORES_SQL}, {TYPED_SQL}, a AS (SELECT o_custkey, query_type, count(*) AS n, max(score) FILTER (rank = 1) AS s1, max(score) FILTER (rank = 2) AS s2, count(*) FILTER (score >= 0.4) AS good FROM typed GROUP BY 1, 2)
SELECT o_custkey, least(12, CASE WHEN query_type IN ('exact_title', 'single_gold', 'specific_paper') AND s1 - s2 >= 0.15 THEN 1 WHEN query_type IN ('exact_title', 'single_gold') THEN least(1, n) WHEN query_type = 'specific_paper' THEN least(2, n)
  WHEN query_type IN ('dataset_constraint', 'method_comparison') THEN least(6, n) WHEN query_type IN ('survey', 'broad_topic', 'latest_work') THEN least(10, n) WHEN good > 0 THEN least(good, 20) ELSE least(5, n) END)::BIGINT AS k FROM a"""
_GAP12 = _GAP.replace("least(20, greatest(2, spot))", "least(12, greatest(2, spot))").replace("rank <= 25", "rank <= 17")
_DROP12 = _DROP.replace("least(20, count(*)", "least(12, count(*)").replace("least(spot, 20)", "least(spot, 12)").replace("least(20, greatest(1, coalesce", "least(12, greatest(1, coalesce")
_COMPOSED = f"""WITH gp AS ({_GAP12}), dp AS ({_DROP12}), b AS (SELECT o_custkey, least(12, coalesce(gp.k, dp.k)) AS bound FROM gp JOIN dp USING (o_custkey)), cnt AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1),
e AS ({_EXPECTED.replace("least(n, 20, CASE", "least(n, (SELECT bound FROM b WHERE b.o_custkey = a.o_custkey), CASE")})
SELECT o_custkey, least(12, n, greatest(bound, 5))::BIGINT AS fallback_k, greatest(1, least(bound, k))::BIGINT AS model_k FROM b JOIN cnt USING (o_custkey) JOIN e USING (o_custkey)"""
_TOP = f"WITH {EDGES_SQL}, top AS (SELECT p_partkey AS node FROM part_stats ORDER BY citations DESC, p_partkey LIMIT 200)"
ORACLE_SQL = {
    "rrf_fusion": f"WITH {RRF_SQL} " + _RRF.format("1.0::DOUBLE", ""),
    "rrf_weighted": f"WITH {RRF_SQL} " + _RRF.format("CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 1.5 END::DOUBLE", "WHERE l_returnflag <> 'R'"),
    "blocked_topk": f"WITH {VEC_SQL} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5",
    "vector_topk": f"WITH {VEC_SQL} SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5",
    "vector_multi": f"WITH {VEC_SQL}, t AS (SELECT query_id % 3 AS query_group, vec_id, round(sum(score), 6) AS score, count(*) AS hits FROM r WHERE rank <= 20 GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_group ORDER BY score DESC, vec_id) AS rank FROM t) WHERE rank <= 10",
    "vector_recall_at_k": f"WITH {VEC_SQL} SELECT query_id, round(count(*) FILTER (a.label = b.label) / count(*), 4) AS precision_at_10 FROM r JOIN v a ON a.vec_id = r.vec_id JOIN v b ON b.vec_id = r.query_id WHERE rank <= 10 GROUP BY 1",
    "citation_score": f"WITH {PART_STATS_SQL} SELECT p_partkey, round(least(ln(1 + citations) / ln(501), 1), 6) AS citation, round(CASE WHEN year IS NULL THEN 0.4 ELSE greatest(0, 1 - 0.08::DOUBLE * greatest(0, 2002 - year)) END, 6)::DOUBLE AS recency FROM part_stats",
    "prerank_score": f"WITH {PART_STATS_SQL}, {FEATURES_SQL} SELECT p_partkey, round(prerank, 6) AS score FROM pr",
    "final_score": _FINAL, "calibrate": _CALIBRATE, "evidence_validation": VALIDATE_SQL,
    "fbeta_cutoff": f"WITH {CUSTOMER_SCORES_SQL}, {CURVE_SQL}, {FBETA_SQL.format(1, 2, 1)} SELECT o_custkey, k, round(best, 6) AS best, round(best / 2, 6) AS tau FROM fb1",
    "tier_partition": f"WITH {CUSTOMER_SCORES_SQL}, {CURVE_SQL}, {FBETA_SQL.format(1, 2, 1)}, {FBETA_SQL.format(2, 3.25, 2.25)} SELECT CASE WHEN rank <= a.k THEN 'high' WHEN rank <= greatest(a.k, b.k) THEN 'partial' ELSE 'excluded' END AS tier, count(*) AS n, sum(rank)::BIGINT AS ranks FROM scores JOIN fb1 a USING (o_custkey) JOIN fb2 b USING (o_custkey) GROUP BY 1",
    "score_gap_k": _GAP, "percentile_drop_k": _DROP, "expected_f1_k": _EXPECTED, "dynamic_k_rules": _DYNAMIC, "composed_k": _COMPOSED,
    "tier_summary": f"WITH {CUSTOMER_SCORES_SQL}, {CURVE_SQL}, {FBETA_SQL.format(1, 2, 1)}, {FBETA_SQL.format(2, 3.25, 2.25)}, t AS (SELECT o_custkey, score, CASE WHEN rank <= a.k THEN 'high' WHEN rank <= greatest(a.k, b.k) THEN 'partial' ELSE 'excluded' END AS tier FROM scores JOIN fb1 a USING (o_custkey) JOIN fb2 b USING (o_custkey)) SELECT o_custkey, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'partial') AS partial, count(*) FILTER (tier = 'excluded') AS excluded, round(sum(score) FILTER (tier = 'high'), 6) AS high_mass FROM t GROUP BY 1",
    "refchain_expand": f"WITH {EDGES_SQL} SELECT source AS seed, target, route, p AS position FROM (SELECT *, row_number() OVER (PARTITION BY source, route ORDER BY position, target) AS p FROM edges JOIN seeds ON seed = source) WHERE p <= 10",
    "induced_graph": f"{_TOP} SELECT DISTINCT source, target FROM one WHERE source IN (SELECT node FROM top) AND target IN (SELECT node FROM top)",
    "link_prior": f"{_TOP} SELECT node, CASE WHEN EXISTS (SELECT 1 FROM edges WHERE source = node AND target IN (SELECT node FROM top)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prior FROM top",
    "key_overlap_join": "WITH p AS (SELECT p_partkey, unnest(['k' || (p_partkey % 50), 's' || p_size]) AS k FROM part), s AS (SELECT s_suppkey, unnest(['k' || s_suppkey, 's' || s_nationkey]) AS k FROM supplier) SELECT p_partkey, s_suppkey, count(*) AS shared FROM p JOIN s USING (k) GROUP BY 1, 2",
    "topic_clusters": """WITH t AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(p_type), '\\s+')) AS topic FROM part), w AS (SELECT DISTINCT p_partkey, unnest(regexp_split_to_array(lower(p_name || ' ' || p_type), '\\s+')) AS topic FROM part),
      h AS (SELECT p_partkey, topic FROM w WHERE topic <> '' AND topic IN (SELECT topic FROM t)), u AS (SELECT * FROM h UNION ALL SELECT p_partkey, 'General' FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM h))
      SELECT topic, count(*) AS parts, min(p_partkey) AS first FROM u GROUP BY 1""",
    "cutoff_filter": "SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders WHERE o_orderdate IS NULL OR CAST(o_orderdate AS DATE) <= (SELECT max(CAST(o_orderdate AS DATE)) - 7 FROM orders)",
    "publication_dates": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN make_date(year(o_orderdate), month(o_orderdate), 28) WHEN 2 THEN make_date(year(o_orderdate), 12, 31) WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END::VARCHAR AS published FROM orders",
    "parse_event_props": "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, min(CAST(ts AS DATE))::VARCHAR AS first_day FROM events GROUP BY 1",
    "cost_rollup": "SELECT event_type, user_id % 10 AS job, count(*) AS calls, round(sum(value), 4) AS elapsed, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY ROLLUP (event_type, user_id % 10)",
    "llm_usage": "SELECT 'm' || (user_id % 3) AS model, count(*) AS calls, sum(greatest(1, floor(value))::BIGINT)::BIGINT AS tokens, round(sum(value), 4) AS elapsed FROM events GROUP BY 1",
    "run_latest": "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated_at, arg_max(event_type, row(ts, event_id)) AS status, count(*) AS updates FROM events GROUP BY 1",
    "stage_budget": "SELECT stage, count(*) AS calls, round(sum(value), 4) AS elapsed FROM (SELECT value, unnest(CASE event_type WHEN 'view' THEN ['retrieval'] WHEN 'click' THEN ['retrieval', 'evidence'] WHEN 'purchase' THEN ['synthesis'] ELSE CASE event_id % 7 WHEN 1 THEN ['evidence'] WHEN 2 THEN ['evidence'] WHEN 3 THEN ['synthesis'] WHEN 6 THEN ['evidence', 'synthesis'] ELSE ['other'] END END) AS stage FROM events) GROUP BY 1",
    "provider_health": "WITH r AS (SELECT user_id % 20 AS provider, event_id, count(*) FILTER (event_type = 'signup') OVER w AS limits, count(*) FILTER (event_type = 'error') OVER w AS errors FROM events WINDOW w AS (PARTITION BY user_id % 20 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT provider, max(limits) AS limits, max(errors) AS errors, min(event_id) FILTER (limits >= 30 OR errors >= 40) AS any_blocked, count(*) FILTER (limits >= 30 OR errors >= 40) AS blocked_events FROM r GROUP BY 1",
    "budget_reserve": "WITH r AS (SELECT user_id % 20 AS provider, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM events) SELECT provider, count(*) FILTER (used <= 500000) AS allowed, max(used) AS used FROM r GROUP BY 1",
}
