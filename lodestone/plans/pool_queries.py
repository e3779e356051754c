"""Queries over candidate pools: append and merge, verdicts, look-ups, checks of evidence, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scoring as S
from lodestone.functions import text as T
from lodestone.operators import cutoffs, evaluation, pools, resolve, selection
from lodestone.operators.search import ranked, with_previous
from lodestone.planning import feedback
from lodestone.plans.tables import CUSTOMER_SCORES_SQL, customer_scores, table


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Per brand and return flag, parts by quantity; a part's record has an abstract or an arxiv id in some lists only."""
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    rows = lines.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    rows = ranked(rows, ["p_brand", "l_returnflag"], [F.desc("q"), "l_partkey"])
    return rows.select("p_brand", F.col("l_partkey").alias("key"), F.ascii("l_returnflag").alias("list_no"), (F.col("rank") - 1).alias("rank"), "l_returnflag")


LISTS_SQL = """l AS (SELECT * FROM (SELECT p_brand, l_partkey AS key, ascii(l_returnflag) AS list_no, l_returnflag AS flag, row_number() OVER (PARTITION BY p_brand, l_returnflag ORDER BY sum(l_quantity) DESC, l_partkey) - 1 AS rank
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, l_partkey, l_returnflag))"""


def pool_append(spark: SparkSession, d: str) -> DataFrame:
    """The list of A lines, then that of N lines, without repeats, 80 a brand."""
    lists = _lists(spark, d).select("p_brand", "key", "rank", "l_returnflag")
    parts = [lists.filter(F.col("l_returnflag") == f).drop("l_returnflag") for f in "AN"]
    return pools.appended(parts, ["p_brand"], "key", 80).select("p_brand", "key", "rank")


def rrf_records(spark: SparkSession, d: str) -> DataFrame:
    """Fused lists with the record that each part keeps and its merged metadata."""
    k, n = F.col("key"), F.col("list_no")
    record = F.struct(F.concat("l_returnflag", F.lit(""), k.cast("string")).alias("id"), F.when((k + n) % 3 == 0, "text").alias("abstract"), F.when((k + n) % 5 == 0, "2401").alias("arxiv_id"))
    rows = _lists(spark, d).withColumns({"record": record, "metadata": F.create_map(F.lit("last"), F.col("l_returnflag"), F.col("l_returnflag"), F.col("rank").cast("string")), "weight": F.when(n == 65, 1.5).otherwise(1.0)})
    out = pools.fused_records(rows, ["p_brand"], "key").filter("rank <= 20")
    return out.select("p_brand", "key", F.round("score", 9).alias("score"), F.col("record.id").alias("id"), F.col("metadata")["last"].alias("last"), F.size("metadata").cast("long").alias("names"))


def pool_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as a pool; a review discards a third of them."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.round(F.col("o_totalprice") / 1000).cast("long").alias("cited"))
    action = F.when(F.col("o_orderkey") % 3 == 0, "discard").when(F.col("o_orderkey") % 3 == 1, "noise")
    said = o.select("o_custkey", "o_orderkey", action.alias("action"), F.lit("r").alias("reason")).filter("action IS NOT NULL AND o_orderkey % 2 = 0")
    return pools.verdicts_applied(o, said, "o_custkey", "o_orderkey", "cited").select("o_custkey", "o_orderkey", "action")


def exact_title_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Parts whose name has the letters of another writing of it."""
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    asked = parts.filter("p_partkey % 5 = 0").select("p_partkey", F.concat(F.lit("* "), F.upper("p_name"), F.lit(" (2024)")).alias("text"))
    titles = parts.select(F.col("p_partkey").alias("found"), F.lpad(F.col("p_partkey").cast("string"), 12, "0").alias("title"), T.letters_key(F.col("p_name")).alias("title_key"))
    return pools.exact_titles(asked, titles, "p_partkey", "text", 3).select("p_partkey", "found", "rank")


def title_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """First lines of documents that look like titles, two a source, for three providers."""
    docs = table(spark, d, "documents").select("doc_id", "source", T.first_line(F.col("text")).alias("t"))
    providers = spark.createDataFrame([("openalex",), ("arxiv",), ("pubmed",)], "provider string")
    return pools.fanned_out(docs, providers, "source", "t", ["doc_id"], 2).select("source", "doc_id", "nth", "provider")


def title_like_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.first_line(F.col("text")).alias("t"))
    return docs.select("doc_id", T.looks_like_title(F.col("t")).alias("title_like"))


def calls_to_run(spark: SparkSession, d: str) -> DataFrame:
    """Part and supplier pairs that no returned line has."""
    lines = table(spark, d, "lineitem")
    calls = lines.select(F.col("l_suppkey").alias("provider"), F.col("l_partkey").alias("search")).distinct()
    log = lines.select(F.col("l_suppkey").alias("provider"), F.col("l_partkey").alias("search"), F.when(F.col("l_returnflag") != "R", "x").alias("error"))
    return pools.not_yet_run(calls, log).groupBy("provider").agg(F.count("*").alias("calls"))


def safety_search(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("survey", "unknown", "method_comparison", "exact_title")
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    used = F.when(F.col("l_suppkey") % 3 == 0, F.array(F.lit("arxiv"))).otherwise(F.array(F.lit("arxiv"), F.lit("semantic_scholar")))
    kind = F.element_at(F.array(*map(F.lit, kinds)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return per.select("l_suppkey", pools.needs_broad_search(F.col("n") % 400, F.lit(120), used, kind).alias("broad"))


def timeline(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 7 > 0, F.year("o_orderdate")).alias("year"))
    return pools.timeline(o, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "rank")


def method_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a brand by the words that its first parts' types hold; others are General Method."""
    parts = table(spark, d, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    words = parts.filter("p_partkey % 10 = 0").select("p_brand", F.explode(F.split("t", r"\s+")).alias("method")).filter("method <> ''").distinct()
    return pools.method_clusters(parts, words, "p_brand", "p_partkey", "t").select("p_brand", "topic", F.size("papers").cast("long").alias("papers"), F.element_at("papers", 1).alias("first"))


def level_counts(spark: SparkSession, d: str) -> DataFrame:
    level = F.element_at(F.array(*[F.lit(x) for x in ("high", "medium", "low", "irrelevant")], F.lit(None)), (F.col("l_orderkey") % 5 + 1).cast("int"))
    return pools.level_counts(table(spark, d, "lineitem").select("l_suppkey", level.alias("level")), ["l_suppkey"])


def provider_hits(spark: SparkSession, d: str) -> DataFrame:
    return pools.provider_counts(table(spark, d, "documents").select("lang", "source"), ["lang"])


def gold_distribution(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string"))).alias("gold"))
    return pools.gold_counts(cases, "gold").select(F.col("gold").cast("long").alias("gold"), "cases")


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "error", "failed").otherwise("succeeded")
    return pools.batch_summary(table(spark, d, "events").select(state.alias("state"), "value"), ["value"])


def evidence_checks(spark: SparkSession, d: str) -> DataFrame:
    """Quotes, constraints and coverage of documents: words of the next document as evidence, words of its own as constraints.

    doc_id is taken as the table's key: rows without one are left out, and rows that share one are paired with each other.
    """
    docs = table(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    heads = docs.select("doc_id", "lang", (-F.coalesce("doc_id", F.lit(-(2**61)))).alias("back"), F.slice(F.split("text", " "), 1, 4).alias("head"))
    following = with_previous(heads, "lang", "back", "head", "after").select("doc_id", "head", F.coalesce("after", F.array().cast("array<string>")).alias("after"))  # next by id: before by its negative
    w = docs.join(following, "doc_id")  # texts move once, and stay out of the windows
    quotes, wanted, got = F.concat(F.slice("head", 3, 2), F.slice("after", 1, 3)), F.slice("head", 1, 3), F.slice("after", 1, 2)
    level = F.when(F.col("doc_id") % 2 == 0, "high").otherwise("low")
    return w.select("doc_id", F.round(S.evidence_ratio(quotes, F.col("text")), 6).alias("evidence"), F.round(S.plan_coverage(wanted, got, level), 6).alias("coverage"))


def route_prior(spark: SparkSession, d: str) -> DataFrame:
    tags = ("title_exact", "route:title_like", "citation_expansion", "reference_expansion", "related_work_expansion", "citation")
    k = F.col("p_partkey")
    path = F.array_compact(F.array(*[F.when(k % (n + 2) == 0, F.lit(t)) for n, t in enumerate(tags)]))
    path = F.concat(path, F.array(F.concat(F.lit("provider:"), k % 3), F.concat(F.lit("provider:"), k % 5)))
    return table(spark, d, "part").select("p_partkey", F.round(S.route_prior(path), 6).alias("prior"), F.round(S.source_agreement(path), 6).alias("sources"))


def biomedical_topics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", T.is_biomedical(F.col("text")).alias("biomedical"))


def stemmed_words(spark: SparkSession, d: str) -> DataFrame:
    """How many benchmark passages hold each stemmed word."""
    return table(spark, d, "benchmark").select("item_id", F.explode(T.stemmed_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("passages"))


def simulated(spark: SparkSession, d: str) -> DataFrame:
    """Cut-offs of three kinds over customers' score lists, with every third order as gold."""
    scores = customer_scores(spark, d)
    cuts = {"fixed": scores.groupBy("o_custkey").agg(F.lit(3).alias("k")), "fbeta": cutoffs.f_beta_cutoff(scores, "o_custkey", "score"), "drop": cutoffs.percentile_drop(scores, "o_custkey", "score")}
    curves = scores.select("o_custkey", "rank", (F.col("o_orderkey") % 3 == 0).alias("gold"))
    means = [F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")]
    return pools.simulated_cutoffs(curves, cuts, "o_custkey").groupBy("approach").agg(F.sum("k").cast("long").alias("k"), *means)


def gold_trace(spark: SparkSession, d: str) -> DataFrame:
    """Every third order of a customer through three stages."""
    scores = customer_scores(spark, d)
    gold = scores.filter("o_orderkey % 3 = 0").select("o_custkey", "o_orderkey")
    stages = {"pool": scores.filter("rank <= 12"), "selection": scores.filter("score >= 0.5"), "final": scores.filter("rank <= 4 AND score >= 0.5")}
    return evaluation.gold_trace(gold, stages, "o_custkey", "o_orderkey").groupBy("last_stage").agg(F.count("*").alias("items"))


def session_recency(spark: SparkSession, d: str) -> DataFrame:
    """Users' sessions newest first: by their first event, else by when they were indexed."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("indexed"), F.min(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("started"))
    return ranked(e.withColumn("day", F.col("user_id") % 7), ["day"], [F.desc(F.coalesce("started", "indexed")), "user_id"], 5).select("day", "user_id", "rank")


def diversified_pool(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a brand as candidates with routes, providers and four kinds of scores."""
    k = F.col("p_partkey")
    path = F.slice(F.array(F.concat(F.lit("r"), k % 5), F.concat(F.lit("r"), k % 3)), F.lit(1), (k % 3).cast("int"))
    rows = table(spark, d, "part").select(
        "p_brand", "p_partkey", k.alias("pos"), path.alias("path"), F.when(k % 4 > 0, F.concat(F.lit("s"), k % 4)).alias("source"), F.when(k % 9 > 0, F.col("p_retailprice")).alias("local"),
        F.when(k % 7 > 0, (k * 37) % 101 / 101).alias("fused"), F.when(k % 2 == 0, F.col("p_size") % 5).alias("matched"),
    )
    return selection.diversified(rows, "p_brand", "p_partkey", 40, 12, 4, 6, 6).select("p_brand", "p_partkey", F.col("place").cast("long").alias("place"))


def absorbed_pool(spark: SparkSession, d: str) -> DataFrame:
    """Order lines of a customer as one pool: records absorbed by the first seen with their id or key."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s")).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    pos = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = lines.select("o_custkey", pos.alias("pos"), (F.col("p") % 300).cast("string").alias("paper_id"), F.when(F.col("s") % 3 == 0, F.concat(F.lit("d"), F.col("s") % 9)).alias("doi"), F.lit("").alias("arxiv_id"), F.concat(F.lit("t"), F.col("p") % 50).alias("title"))
    return resolve.absorbed(rows, "o_custkey", "pos").groupBy("o_custkey").agg(F.countDistinct("entity").alias("records"), F.count("*").alias("rows"))


def feedback_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of each source's first documents, by id."""
    docs = ranked(table(spark, d, "documents").filter("source IS NOT NULL").select("source", "doc_id", "text"), ["source"], ["doc_id"])
    return feedback.candidate_terms(docs, "source", "text", 5, 15).select("source", "term", "weight", "rank")


QUERIES = {
    "feedback_terms": feedback_terms, "diversified_pool": diversified_pool, "absorbed_pool": absorbed_pool, "pool_append": pool_append, "rrf_records": rrf_records, "pool_verdicts": pool_verdicts, "exact_title_lookup": exact_title_lookup, "title_fan_out": title_fan_out, "title_like_documents": title_like_documents,
    "calls_to_run": calls_to_run, "safety_search": safety_search, "timeline": timeline, "method_clusters": method_clusters, "level_counts": level_counts, "provider_hits": provider_hits,
    "gold_distribution": gold_distribution, "batch_summary": batch_summary, "evidence_checks": evidence_checks, "route_prior": route_prior, "biomedical_topics": biomedical_topics, "stemmed_words": stemmed_words,
    "simulated_cutoffs": simulated, "gold_trace": gold_trace, "session_recency": session_recency,
}

_STEM = "CASE WHEN len(w) > 4 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN len(w) > 4 AND regexp_matches(w, '(ch|sh|x|z)es$') THEN w[:-3] WHEN len(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END"
_OPENINGS = " OR ".join(f"starts_with(low, '{p}')" for p in T.REQUEST_OPENINGS) + " OR " + " OR ".join(f"contains(low, '{p}')" for p in T.REQUEST_PHRASES)
_TITLED = f"""tw AS (SELECT doc_id, source, t, w, lower(array_to_string(w, ' ')) AS low FROM (SELECT doc_id, source, split_part(text, chr(10), 1) AS t, regexp_extract_all(split_part(text, chr(10), 1), '[A-Za-z][A-Za-z0-9\\-]*') AS w FROM documents)),
tl AS (SELECT *, coalesce(len(w) BETWEEN 3 AND 24 AND NOT ({_OPENINGS}) AND (len(w) >= 5 OR contains(t, ':') OR len(list_filter(w, lambda x: regexp_matches(x, '^[A-Z]'))) >= 3 OR len(list_filter(w, lambda x: x = upper(x) AND len(x) >= 2)) > 0), false) AS title_like FROM tw)"""

_STOP = "(" + ", ".join(f"'{w}'" for w in feedback.STOPWORDS) + ")"
ORACLE_SQL = {
    "feedback_terms": f"""WITH r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, list_filter(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9\\-]{{2,}}'), lambda w: w NOT IN {_STOP}) AS w FROM documents WHERE source IS NOT NULL),
      g AS (SELECT source, rank, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM r CROSS JOIN (SELECT unnest([1, 2, 3]) AS n) WHERE rank <= 5 AND len(w) >= n), t AS (SELECT source, rank, n, i, array_to_string(w[i:i + n - 1], ' ') AS term FROM g),
      c AS (SELECT source, term, n, count(*) * CASE WHEN n > 1 THEN 2 ELSE 1 END AS weight, count(*) AS c, min(row(rank, n, i)) AS seen FROM t GROUP BY source, term, n)
      SELECT * FROM (SELECT source, term, weight, row_number() OVER (PARTITION BY source ORDER BY weight DESC, seen) AS rank FROM c WHERE c >= 2) WHERE rank <= 15""",
    "diversified_pool": """WITH c AS (SELECT p_brand, p_partkey AS k, coalesce(CASE WHEN p_partkey % 9 > 0 THEN p_retailprice END, 0) AS loc, coalesce(CASE WHEN p_partkey % 7 > 0 THEN (p_partkey * 37) % 101 / 101 END, 0) AS fused,
        CASE WHEN p_partkey % 2 = 0 THEN p_size % 5 END AS met, coalesce(CASE WHEN p_partkey % 4 > 0 THEN 's' || (p_partkey % 4) END, 'unknown') AS src, list_slice(['r' || (p_partkey % 5), 'r' || (p_partkey % 3)], 1, p_partkey % 3) AS path FROM part),
      r AS (SELECT *, unnest(path) AS route, generate_subscripts(path, 1) AS i FROM c),
      a AS (SELECT p_brand, k, 1 AS part, 0 AS seen, 0 AS seen_i, row_number() OVER (PARTITION BY p_brand ORDER BY loc DESC, k) AS n FROM c),
      b AS (SELECT p_brand, k, 2, first_value(k) OVER (PARTITION BY p_brand, route ORDER BY k, i), first_value(i) OVER (PARTITION BY p_brand, route ORDER BY k, i), row_number() OVER (PARTITION BY p_brand, route ORDER BY loc DESC, k) AS n FROM r),
      s AS (SELECT p_brand, k, 3, min(k) OVER (PARTITION BY p_brand, src), 0, row_number() OVER (PARTITION BY p_brand, src ORDER BY loc DESC, k) AS n FROM c),
      f AS (SELECT p_brand, k, 4, 0, 0, row_number() OVER (PARTITION BY p_brand ORDER BY fused DESC, k) AS n FROM c), g AS (SELECT p_brand, k, 5, 0, 0, row_number() OVER (PARTITION BY p_brand ORDER BY met DESC, k) AS n FROM c WHERE met IS NOT NULL),
      u AS (SELECT * FROM a WHERE n <= 12 UNION ALL SELECT * FROM b WHERE n <= 4 UNION ALL SELECT * FROM s WHERE n <= 4 UNION ALL SELECT * FROM f WHERE n <= 6 UNION ALL SELECT * FROM g WHERE n <= 6),
      o AS (SELECT p_brand, k, min(row(part, seen, seen_i, n)) AS place FROM u GROUP BY 1, 2)
      SELECT * FROM (SELECT p_brand, k AS p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY place) AS place FROM o) WHERE place <= 40""",
    "pool_append": f"WITH {LISTS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY p_brand, key ORDER BY list_no) AS n FROM l WHERE flag IN ('A', 'N')) SELECT * FROM (SELECT p_brand, key, row_number() OVER (PARTITION BY p_brand ORDER BY list_no, rank) AS rank FROM x WHERE n = 1) WHERE rank <= 80",
    "rrf_records": f"""WITH {LISTS_SQL}, x AS (SELECT *, (key + list_no) % 3 = 0 AS abs, (key + list_no) % 5 = 0 AS arx, row_number() OVER (PARTITION BY p_brand, key ORDER BY list_no, rank) AS n FROM l),
      a AS (SELECT p_brand, key, sum(CASE WHEN list_no = 65 THEN 1.5 ELSE 1.0 END::DOUBLE / (60 + rank)) AS score, arg_max(flag, list_no) AS last, count(*) + 1 AS names, min(list_no) AS first_list, arg_min(rank, list_no) AS first_rank,
        list(flag ORDER BY n) AS f, list(abs ORDER BY n) AS ab, list(arx ORDER BY n) AS ar FROM x GROUP BY 1, 2),
      p AS (SELECT *, CASE WHEN len(f) > 1 AND ((ab[2] AND NOT ab[1]) OR (ar[2] AND NOT ar[1])) THEN 2 ELSE 1 END AS kept FROM a),
      q AS (SELECT *, CASE WHEN len(f) > 2 AND ((ab[3] AND NOT ab[kept]) OR (ar[3] AND NOT ar[kept])) THEN 3 ELSE kept END AS last_kept FROM p)
      SELECT p_brand, key, round(score, 9) AS score, f[last_kept] || key AS id, last, names FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, first_list, first_rank) AS r FROM q) WHERE r <= 20""",
    "pool_verdicts": """WITH x AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'discard' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 1 THEN 'noise' ELSE 'keep' END AS action, round(o_totalprice / 1000)::BIGINT AS cited FROM orders),
      y AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, action ORDER BY cited, o_orderkey DESC) AS n, greatest(1, count(*) OVER (PARTITION BY o_custkey) // 10) AS room FROM x)
      SELECT o_custkey, o_orderkey, CASE WHEN action = 'discard' THEN 'noise' ELSE action END AS action FROM y WHERE NOT (action = 'discard' AND n <= room)""",
    "exact_title_lookup": "WITH k AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^\\p{L}]', '', 'g')) AS k FROM part) SELECT * FROM (SELECT a.p_partkey, b.p_partkey AS found, row_number() OVER (PARTITION BY a.p_partkey ORDER BY b.p_partkey) AS rank FROM k a JOIN k b USING (k) WHERE a.p_partkey % 5 = 0 AND k <> '') WHERE rank <= 3",
    "title_fan_out": f"WITH {_TITLED}, n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM tl WHERE title_like) SELECT source, doc_id, nth, provider FROM n CROSS JOIN (VALUES ('openalex'), ('arxiv'), ('pubmed')) p(provider) WHERE nth <= 2",
    "title_like_documents": f"WITH {_TITLED} SELECT doc_id, title_like FROM tl",
    "calls_to_run": "SELECT provider, count(*) AS calls FROM (SELECT DISTINCT l_suppkey AS provider, l_partkey AS search FROM lineitem EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
    "safety_search": "WITH n AS (SELECT l_suppkey, count(*) % 400 AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, n < 120 OR l_suppkey % 3 = 0 OR (l_suppkey % 4 IN (0, 2) AND n < 250) AS broad FROM n",
    "timeline": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 7 > 0 THEN year(o_orderdate) ELSE 0 END DESC, o_orderkey) AS rank FROM orders",
    "method_clusters": """WITH p AS (SELECT p_brand, p_partkey, lower(p_name || ' ' || p_type) AS t FROM part), w AS (SELECT DISTINCT p_brand, unnest(regexp_split_to_array(p_name || ' ' || p_type, '\\s+')) AS method FROM part WHERE p_partkey % 10 = 0),
      n AS (SELECT p.p_brand, p_partkey, method FROM p JOIN w ON w.p_brand = p.p_brand AND method <> '' AND contains(t, lower(method))), u AS (SELECT * FROM n UNION ALL SELECT p_brand, p_partkey, 'General Method' FROM p WHERE (p_brand, p_partkey) NOT IN (SELECT p_brand, p_partkey FROM n))
      SELECT p_brand, method AS topic, count(DISTINCT p_partkey) AS papers, min(p_partkey) AS first FROM u GROUP BY 1, 2""",
    "level_counts": "SELECT l_suppkey, count(*) FILTER (l_orderkey % 5 = 0) AS high, count(*) FILTER (l_orderkey % 5 = 1) AS medium, count(*) FILTER (l_orderkey % 5 >= 2) AS rejected FROM lineitem GROUP BY 1",
    "provider_hits": "SELECT lang, coalesce(source, 'unknown') AS source, count(*) AS hits FROM documents GROUP BY 1, 2",
    "gold_distribution": "SELECT gold, count(*) AS cases FROM (SELECT count(*) FILTER (o_orderstatus = 'F') AS gold FROM orders GROUP BY o_custkey) GROUP BY 1",
    "batch_summary": "SELECT count(*) AS cases, count(*) FILTER (event_type <> 'error') AS succeeded, round(avg(value) FILTER (event_type <> 'error'), 4) AS value FROM events",
    "evidence_checks": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), ' ') AS w, lead(string_split(coalesce(text, ''), ' ')) OVER (PARTITION BY lang ORDER BY doc_id) AS a FROM documents),
      q AS (SELECT doc_id, lower(text) AS low, list_concat(w[3:4], coalesce(a[1:3], [])) AS quotes, list_filter(w[1:3], lambda x, i: x <> '' AND list_position(w[1:3], x) = i) AS wanted, list_transform(coalesce(a[1:2], []), lambda x: lower(x)) AS got FROM d)
      SELECT doc_id, CASE WHEN len(quotes) = 0 THEN 0 ELSE round(len(list_filter(quotes, lambda x: trim(lower(x)) <> '' AND contains(low, trim(lower(x))))) / len(quotes), 6) END::DOUBLE AS evidence,
        CASE WHEN len(wanted) = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.3 END ELSE round(len(list_filter(wanted, lambda x: len(list_filter(got, lambda m: contains(m, lower(x)) OR contains(lower(x), m))) > 0)) / len(wanted), 6) END::DOUBLE AS coverage FROM q""",
    "route_prior": """SELECT p_partkey, round(least(0.25, CASE WHEN p_partkey % 2 = 0 THEN 0.20 WHEN p_partkey % 3 = 0 THEN 0.06 ELSE 0 END + CASE WHEN p_partkey % 4 = 0 THEN 0.04 ELSE 0 END + CASE WHEN p_partkey % 5 = 0 THEN 0.03 ELSE 0 END + CASE WHEN p_partkey % 6 = 0 THEN 0.03 ELSE 0 END), 6)::DOUBLE AS prior,
      round(CASE WHEN p_partkey % 3 = p_partkey % 5 THEN 1 ELSE 2 END / 3, 6) AS sources FROM part""",
    "biomedical_topics": "SELECT item_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in T.BIOMEDICAL_WORDS) + " AS biomedical FROM benchmark",
    "stemmed_words": f"WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}')) AS w FROM benchmark), s AS (SELECT DISTINCT item_id, {_STEM} AS word FROM w) SELECT word, count(*) AS passages FROM s GROUP BY 1",
    "gold_trace": f"""WITH {CUSTOMER_SCORES_SQL} SELECT CASE WHEN rank <= 4 AND score >= 0.5 THEN 'final' WHEN score >= 0.5 THEN 'selection' WHEN rank <= 12 THEN 'pool' ELSE 'absent' END AS last_stage, count(*) AS items FROM scores WHERE o_orderkey % 3 = 0 GROUP BY 1""",
    "session_recency": "WITH e AS (SELECT user_id, max(event_id) AS i, min(event_id) FILTER (event_type = 'signup') AS s FROM events GROUP BY 1) SELECT * FROM (SELECT user_id % 7 AS day, user_id, row_number() OVER (PARTITION BY user_id % 7 ORDER BY coalesce(s, i) DESC, user_id) AS rank FROM e) WHERE rank <= 5",
}
