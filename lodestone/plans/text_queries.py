"""Queries over documents, pages, passages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import evaluation, search, selection
from lodestone.operators.search import ranked
from lodestone.plans.tables import PASSAGES_SQL, passages, table
from lodestone.sources import postings
from lodestone.sources.shared import new_folder

LIST = lambda c: f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: len(w) > 1)"
STOP = "(" + ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS) + ")"
TOPIC_STOP = "(" + ", ".join(f"'{w}'" for w in T.TOPIC_STOPWORDS) + ")"


def normalize_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.title_key(F.col("text")).alias("title"))


def letters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.letters_key(F.col("text"))).alias("key"))


def normalize_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.url_key(F.col("url")).alias("url"))


def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


def identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of every shape made from order keys, brought to one form."""
    n = F.col("o_orderkey").cast("string")
    shape = F.col("o_orderkey") % 4
    raw = F.when(shape == 0, F.concat(F.lit(" https://doi.org/10.1/"), n)).when(shape == 1, F.concat(F.lit("DOI:10.1/"), n)).when(shape == 2, F.concat(F.lit("https://arxiv.org/pdf/"), n, F.lit("v3.pdf"))).otherwise(F.concat(F.lit("arXiv:"), n, F.lit("v12")))
    return table(spark, d, "orders").select("o_orderkey", T.identifier(raw).alias("identifier"), T.arxiv_id(raw).alias("arxiv_id"))


def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    token = table(spark, d, "documents").select("doc_id", F.explode(T.query_tokens(F.col("text"))).alias("token"))
    per = token.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("token").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))


def stem_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.explode(T.topic_tokens(F.col("text"))).alias("token"))


def html_to_text_tokens(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " ")
    return table(spark, d, "pages").select("page_id", F.size(T.words(bare)).cast("long").alias("words"), T.token_estimate(bare).cast("long").alias("estimate"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).select("item_id", "doc_id", "score", "rank")


def _bm25(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    terms = search.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    scored = search.bm25(table(spark, d, "documents"), terms, "doc_id", "text", "item_id").withColumn("score", F.round("score", 6))
    return ranked(scored, ["item_id"], [F.desc("score"), "doc_id"], k)


BM25_SQL = """toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
lens AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS len FROM documents),
qt AS (SELECT item_id, unnest(list_distinct_ordered) AS token FROM (SELECT item_id,
  list_filter(w, lambda x, i: len(x) > 2 AND list_position(w, x) = i) AS w2, list_slice(w2, 1, 12) AS list_distinct_ordered
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark))),
tf AS (SELECT doc_id, token, count(*) AS tf FROM toks WHERE token IN (SELECT token FROM qt) GROUP BY 1, 2),
idf AS (SELECT token, greatest(1e-6, ln(((SELECT count(*) FROM lens) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM tf GROUP BY 1),
bm AS (SELECT item_id, tf.doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lens)))), 6) AS score
  FROM qt JOIN tf USING (token) JOIN idf USING (token) JOIN lens ON lens.doc_id = tf.doc_id GROUP BY 1, 2),
bmr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""


def _titles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.first_line(F.col("text")).alias("title"))
    return search.title_scores(docs, table(spark, d, "benchmark"), "doc_id", "title", "item_id", "text")


def title_tf_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranked(_titles(spark, d).withColumn("score", F.round("score", 6)), ["item_id"], [F.desc("score"), "doc_id"], 5)


TITLE_SQL = f"""tt AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({LIST("split_part(text, chr(10), 1)")}) AS token FROM documents) GROUP BY 1, 2),
tq AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest({LIST("text")}) AS token FROM benchmark) WHERE len(token) > 2 AND token NOT IN {STOP} GROUP BY 1, 2),
tk AS (SELECT tq.*, n, n <= 80000 AS rare, max(n <= 80000) OVER (PARTITION BY item_id) AS any_rare FROM tq JOIN (SELECT token, count(*) AS n FROM tt GROUP BY 1) USING (token)),
ts AS (SELECT item_id, doc_id, sum(times * (1 + ln(tf))) AS s FROM tk JOIN tt USING (token) WHERE rare OR NOT any_rare GROUP BY 1, 2),
tl AS (SELECT item_id, lower(regexp_replace(array_to_string(list_filter({LIST("text")}, lambda w: len(w) > 2 AND w NOT IN {STOP}), ''), '[^\\p{{L}}]', '', 'g')) AS letters FROM benchmark),
tsc AS (SELECT ts.item_id, ts.doc_id, round(s + CASE WHEN contains(lower(regexp_replace(split_part(text, chr(10), 1), '[^\\p{{L}}]', '', 'g')), letters) THEN 5 ELSE 0 END, 6) AS score
  FROM ts JOIN tl USING (item_id) JOIN documents d ON d.doc_id = ts.doc_id),
tr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM tsc)"""


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and title ranks of the documents for every passage, fused by reciprocal rank (BM25 weighs 1.5)."""
    lists = _bm25(spark, d, 50).select("item_id", "doc_id", F.col("rank") - 1, F.lit(1.5)).toDF("item_id", "doc_id", "rank", "weight")
    titles = ranked(_titles(spark, d).withColumn("score", F.round("score", 6)), ["item_id"], [F.desc("score"), "doc_id"], 50)
    lists = lists.unionByName(titles.select("item_id", "doc_id", (F.col("rank") - 1).alias("rank"), F.lit(1.0).alias("weight")))
    fused = search.reciprocal_rank_fusion(lists, ["item_id"], "doc_id").withColumn("score", F.round("score", 9))
    return ranked(fused, ["item_id"], [F.desc("score"), "doc_id"], 10)


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The scores of a search over an index that is written first, and its terms."""
    path = new_folder(spark, "index")
    postings.add_to_index(table(spark, d, "documents"), "doc_id", "text", path, buckets=16)
    terms = search.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    return postings.stored_bm25(spark, path, terms, "doc_id", "item_id"), terms


def indexed_bm25(spark: SparkSession, d: str) -> DataFrame:
    scored = _stored(spark, d)[0].withColumn("score", F.round("score", 6))
    return ranked(scored, ["item_id"], [F.desc("score"), "doc_id"], 5).select("item_id", "doc_id", "score", "rank")


def indexed_two_phase(spark: SparkSession, d: str) -> DataFrame:
    scored, terms = _stored(spark, d)
    return search.two_phase(scored, terms, "item_id", "doc_id", 20).select("item_id", "doc_id", "phase", F.round("score", 6).alias("score"), "rank")


def two_phase_search(spark: SparkSession, d: str) -> DataFrame:
    terms = search.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    docs = table(spark, d, "documents")
    scored = search.bm25(docs, terms, "doc_id", "text", "item_id")
    return search.two_phase(scored, terms, "item_id", "doc_id", 20).select("item_id", "doc_id", "phase", F.round("score", 6).alias("score"), "rank")


def bm25_fields(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over a title that weighs 1.0 and a body that weighs 0.35: the weighted term counts and lengths are summed first."""
    docs = table(spark, d, "documents").select("doc_id", T.first_line(F.col("text")).alias("title"), "text")
    terms = search.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    scored = search.field_bm25(docs, terms, "doc_id", {"title": 1.0, "text": 0.35}, "item_id")
    return ranked(scored, ["item_id"], [F.desc("score"), "doc_id"], 5)


def dedupe_exact(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce(T.title_key(F.col("text")), F.lit(""))).alias("key"))
    return docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def dedupe_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", F.md5(F.coalesce(T.title_key(F.col("text")), F.lit(""))).alias("key"))
    return docs.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min_by("lang", F.when(F.col("lang").isNotNull(), F.col("doc_id"))).alias("lang"), F.count("*").alias("merged"))


def containment_match(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d)


def _swept(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.at_k(_bm25(spark, d, 10), passages(spark, d), "item_id", "doc_id", (1, 2, 3, 5, 10))


SWEPT_SQL = f"""WITH {BM25_SQL}, {PASSAGES_SQL}, g AS (SELECT item_id, count(*) AS gold FROM gold GROUP BY 1),
ks AS (SELECT unnest([1, 2, 3, 5, 10])::BIGINT AS k),
c AS (SELECT g.item_id, k, (SELECT count(*) FROM bmr r WHERE r.item_id = g.item_id AND r.rank <= k)::BIGINT AS predicted,
  (SELECT count(*) FROM bmr r JOIN gold x ON x.item_id = r.item_id AND x.doc_id = r.doc_id WHERE r.item_id = g.item_id AND r.rank <= k)::BIGINT AS hits, gold FROM g, ks),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p, hits / gold AS r FROM c),
swept AS (SELECT item_id, k, predicted, hits, gold, round(p, 4) AS precision, round(r, 4) AS recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, (hits > 0)::BIGINT AS hit FROM pr)"""


def oracle_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best_k(_swept(spark, d), "item_id")


def micro_macro(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.averages(_swept(spark, d))


def gold_coverage(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.coverage(passages(spark, d), _bm25(spark, d, 10), "item_id", "doc_id")


def candidate_loss(spark: SparkSession, d: str) -> DataFrame:
    """Gold among the first ten that isn't among the first two."""
    found = passages(spark, d)
    pool = _bm25(spark, d, 10)
    kept = found.join(pool, ["item_id", "doc_id"], "left_semi")
    return kept.join(pool.filter("rank <= 2"), ["item_id", "doc_id"], "left_anti")


def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents of quality 1 taken as gold: pool rank by length, level by the toxic label, final by rank."""
    gold = table(spark, d, "labels").filter("quality = 1").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    pool = ranked(gold.withColumn("one", F.lit(1)).filter("lang <> 'fr'"), ["lang"], [F.desc("n_chars"), "doc_id"]).select("doc_id", F.col("rank").alias("candidate_rank"))
    rows = gold.join(pool, "doc_id", "left")
    level = F.when(F.col("candidate_rank").isNull(), F.lit(None)).when(F.col("toxic") == 1, "low").otherwise("high")
    rows = rows.withColumns({"level": level, "notes": F.when(F.col("doc_id") % 2 == 0, "constraint violated"), "final_rank": F.when(F.col("candidate_rank") <= 10, F.col("candidate_rank"))})
    return evaluation.drop_reason(rows, 40).groupBy("reason").agg(F.count("*").alias("items"))


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per customer: a pool (order lines that were not returned, titled by their part), its levels, and gold (returned lines)."""
    one = [F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")]  # lines may repeat their number
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*one).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    lines = lines.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    paper_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    keys = F.array(F.concat(F.lit("t"), F.col("l_partkey") % 400), F.concat(F.lit("a"), F.col("l_suppkey") % 30, F.lit("-"), F.col("l_orderkey") % 10))
    rows = lines.select("o_custkey", paper_id.alias("paper_id"), keys.alias("keys"), T.title_key(F.concat("p_name", F.lit(" "), F.col("l_suppkey") % 4)).alias("title"), "l_returnflag", "l_suppkey", "l_linenumber")
    level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "irrelevant"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    pool = rows.filter("l_returnflag <> 'R'")
    gold = rows.filter("l_returnflag = 'R'").withColumnRenamed("paper_id", "gold_id")
    return pool.select("o_custkey", "paper_id", "keys", "title"), pool.filter("l_linenumber <> 5").select("o_custkey", "paper_id", level.alias("level")), gold.select("o_custkey", "gold_id", "keys", "title")


def selector_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.selector_errors(*_judged(spark, d), "o_custkey")


def gold_scores(spark: SparkSession, d: str) -> DataFrame:
    """Pools against merged gold items, by keys."""
    pool, _, gold = _judged(spark, d)
    results = pool.withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("paper_id")))
    return evaluation.scored_against_gold(results.select("o_custkey", "rank", "keys").checkpoint(), gold.select("o_custkey", "gold_id", "keys").checkpoint(), "o_custkey")


def relaxed_hits(spark: SparkSession, d: str) -> DataFrame:
    pool, _, gold = _judged(spark, d)
    results = pool.withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy("paper_id")))
    return evaluation.hits_at(results, gold, "o_custkey", (1, 3, 10))


def micro(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.micro_scores(gold_scores(spark, d), "true_positive", "predicted_count", "gold_count")


JUDGED_SQL = """lines AS (SELECT o_custkey, l_orderkey * 10 + l_linenumber AS id, ['t' || (l_partkey % 400), 'a' || (l_suppkey % 30) || '-' || (l_orderkey % 10)] AS keys, trim(regexp_replace(lower(p_name || ' ' || (l_suppkey % 4)), '[^a-z0-9]+', ' ', 'g')) AS title,
  l_returnflag, l_suppkey, l_linenumber AS line FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2) JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
pool AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY id) AS rank FROM lines WHERE l_returnflag <> 'R'), golds AS (SELECT * FROM lines WHERE l_returnflag = 'R'),
pairs AS (SELECT DISTINCT p.o_custkey, p.id, p.rank, p.line FROM pool p JOIN golds g ON g.o_custkey = p.o_custkey AND (list_has_any(p.keys, g.keys) OR contains(p.title, g.title) OR contains(g.title, p.title)))"""
SCORED_SQL = f"""RECURSIVE {JUDGED_SQL}, gk AS (SELECT DISTINCT o_custkey AS c, unnest(keys) AS k FROM golds),
near AS (SELECT DISTINCT a.c, a.k AS a, b.k AS b FROM (SELECT o_custkey AS c, 'g' || id AS r, unnest(keys) AS k FROM golds UNION ALL SELECT o_custkey, 'p' || id, unnest(keys) FROM pool) a
  JOIN (SELECT o_custkey AS c, 'g' || id AS r, unnest(keys) AS k FROM golds UNION ALL SELECT o_custkey, 'p' || id, unnest(keys) FROM pool) b ON a.c = b.c AND a.r = b.r
  SEMI JOIN gk x ON x.c = a.c AND x.k = a.k SEMI JOIN gk y ON y.c = b.c AND y.k = b.k),
reach AS (SELECT c, a AS k, a AS to_k FROM near UNION SELECT r.c, r.k, n.b FROM reach r JOIN near n ON n.c = r.c AND n.a = r.to_k),
item AS (SELECT c, k, min(to_k) AS item FROM reach GROUP BY 1, 2), total AS (SELECT c, count(DISTINCT item) AS gold FROM item GROUP BY 1),
met AS (SELECT c, count(DISTINCT item) AS tp FROM item JOIN (SELECT DISTINCT o_custkey AS c, unnest(keys) AS k FROM pool) USING (c, k) GROUP BY 1), n AS (SELECT o_custkey AS c, count(*) AS n FROM pool GROUP BY 1),
sc AS (SELECT c, coalesce(tp, 0) AS tp, coalesce(n, 0) AS n, gold FROM total LEFT JOIN met USING (c) LEFT JOIN n USING (c)),
pr AS (SELECT *, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS p, tp / gold AS r FROM sc)"""


def ngram_terms(spark: SparkSession, d: str) -> DataFrame:
    """Expansion terms: runs of one to three words that occur twice or more; longer runs count double; the first 30."""
    w = F.filter(T.words(F.col("text")), lambda t: F.length(t) > 2)
    base = table(spark, d, "benchmark").select("item_id", w.alias("w"))

    def runs(n: int) -> DataFrame:
        made = F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))
        return base.filter(F.size("w") >= n).select(F.explode(made).alias("term"), F.lit(n).alias("n"))

    counted = runs(1).union(runs(2)).union(runs(3)).groupBy("term", "n").agg(F.count("*").alias("c")).filter("c >= 2")
    scored = counted.select("term", F.when(F.col("n") > 1, F.col("c") * 2).otherwise(F.col("c")).alias("weight"))
    return scored.orderBy(F.desc("weight"), "term").limit(30)


def domain_route(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark")
    rates = {f"{k}_rate": F.round(selection.domain_rate(F.col("text"), k), 6) for k in selection.DOMAINS}
    return items.select("item_id", *[c.alias(n) for n, c in rates.items()], F.array_join(selection.providers(F.col("text"), F.lit("core")), ",").alias("providers"))


def round_robin(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("source IS NOT NULL").select("doc_id", "source", "n_chars")
    return selection.round_robin(docs, "source", [F.desc("n_chars"), "doc_id"], 40).select("doc_id", "source", "turn", "place")


def stratified(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    return selection.top_of_strata(docs, "doc_id", ["source", "lang"], [F.desc("n_chars"), "doc_id"], 10)


def _agents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").withColumn("agent", F.concat(F.lit("a"), (F.col("conv_id") % 4).cast("string")))


def session_list(spark: SparkSession, d: str) -> DataFrame:
    rows = _agents(spark, d)
    title = F.substring(F.split(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))), "\n")[0], 1, 120)
    return rows.groupBy("agent", "conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), title.alias("title"))


def session_stats(spark: SparkSession, d: str) -> DataFrame:
    return _agents(spark, d).groupBy("agent").agg(F.countDistinct("conv_id").alias("sessions"), F.count("*").alias("messages"))


def _session_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark passage's words searched in all messages."""
    rows = _agents(spark, d).withColumn("msg", F.col("conv_id") * 100_000 + F.col("turn"))
    terms = search.query_terms(table(spark, d, "benchmark"), "item_id", "text")
    return search.bm25(rows, terms, "msg", "text", "item_id").join(rows.select("msg", "agent", "conv_id", "turn"), "msg")


def session_search(spark: SparkSession, d: str) -> DataFrame:
    rows = _session_hits(spark, d).withColumn("score", F.round("score", 6))
    return ranked(rows, ["item_id"], [F.desc("score"), "msg"], 20).select("item_id", "agent", "conv_id", "turn", "score")


def search_grouped(spark: SparkSession, d: str) -> DataFrame:
    return _session_hits(spark, d).groupBy("item_id", "agent", "conv_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 6).alias("best"))


SESSION_SQL = f"""{BM25_SQL}, m AS (SELECT 'a' || (conv_id % 4) AS agent, conv_id, turn, conv_id * 100000 + turn AS msg, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations),
st AS (SELECT msg, token, count(*) AS tf FROM (SELECT msg, unnest(w) AS token FROM m) WHERE token IN (SELECT token FROM qt) GROUP BY 1, 2),
si AS (SELECT token, greatest(1e-6, ln(((SELECT count(*) FROM m) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM st GROUP BY 1),
sh AS (SELECT item_id, agent, conv_id, turn, m.msg, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / (SELECT avg(len(w)) FROM m)))), 6) AS score
  FROM qt JOIN st USING (token) JOIN si USING (token) JOIN m USING (msg) GROUP BY ALL)"""

FIELDS_SQL = f"""WITH {BM25_SQL},
ft AS (SELECT doc_id, token, sum(w) AS tf FROM (SELECT doc_id, token, 0.35 AS w FROM toks UNION ALL
  SELECT doc_id, unnest(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]+')), 1.0 FROM documents) WHERE token IN (SELECT token FROM qt) GROUP BY 1, 2),
fl AS (SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) + len(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]+')) AS len FROM documents),
fi AS (SELECT token, greatest(1e-6, ln(((SELECT count(*) FROM fl) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM ft GROUP BY 1),
fs AS (SELECT item_id, ft.doc_id, round(sum(idf * tf::DOUBLE * 2.2 / (tf::DOUBLE + 1.2 * (0.25 + 0.75 * len / (SELECT avg(len) FROM fl)))), 6) AS score
  FROM qt JOIN ft USING (token) JOIN fi USING (token) JOIN fl ON fl.doc_id = ft.doc_id GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fs)
SELECT item_id, doc_id, score, rank FROM fr WHERE rank <= 5"""
STEM_SQL = """CASE WHEN len(t) > 4 AND t LIKE '%ies' THEN left(t, len(t) - 3) || 'y' WHEN len(t) > 4 AND regexp_matches(t, '(ch|sh|x|z)es$') THEN left(t, len(t) - 2)
WHEN len(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, len(t) - 1) ELSE t END"""


def _domain_sql(name: str) -> str:
    words = selection.DOMAINS[name]
    return "round((" + " + ".join(f"contains(t, '{w}')::INT" for w in words) + f") / {len(words)}, 6)"


QUERIES = {
    "normalize_title": normalize_title, "keep_letters_key": letters, "normalize_url": normalize_url, "html_title_extract": html_title, "normalize_identifiers": identifiers,
    "tokenize_counts": tokenize_counts, "stem_tokens": stem_tokens, "html_to_text_tokens": html_to_text_tokens, "bm25_topk": bm25_topk, "title_tf_topk": title_tf_topk, "hybrid_search": hybrid_search,
    "two_phase_search": two_phase_search, "indexed_bm25": indexed_bm25, "indexed_two_phase": indexed_two_phase, "bm25_fields": bm25_fields, "dedupe_exact": dedupe_exact, "dedupe_merge": dedupe_merge, "containment_match": containment_match, "prf_at_k": _swept,
    "oracle_k": oracle_k, "micro_macro_recall": micro_macro, "gold_coverage": gold_coverage, "candidate_loss": candidate_loss, "drop_reason": drop_reasons, "selector_fp_fn": selector_counts, "gold_scores": gold_scores, "micro_scores": micro, "relaxed_hits": relaxed_hits,
    "ngram_terms": ngram_terms, "domain_route": domain_route, "round_robin": round_robin, "stratified_topn": stratified, "session_list": session_list, "session_stats": session_stats,
    "session_search_bm25": session_search, "search_grouped": search_grouped,
}

ORACLE_SQL = {
    "normalize_title": "SELECT doc_id, nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), '') AS title FROM documents",
    "keep_letters_key": "SELECT doc_id, md5(lower(regexp_replace(text, '[^\\p{L}]', '', 'g'))) AS key FROM documents",
    "normalize_url": "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '#.*$', ''), '^https?://', ''), '^www\\.', ''), 'utm_[a-z]+=[^&]*&?', '', 'g'), '[?&]$', ''), '/$', '') AS url FROM pages",
    "html_title_extract": "SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages",
    "normalize_identifiers": "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '10.1/' || o_orderkey WHEN 1 THEN '10.1/' || o_orderkey WHEN 2 THEN o_orderkey::VARCHAR ELSE 'arxiv:' || o_orderkey END AS identifier, CASE o_orderkey % 4 WHEN 0 THEN 'https://doi.org/10.1/' || o_orderkey WHEN 1 THEN 'doi:10.1/' || o_orderkey ELSE o_orderkey::VARCHAR END AS arxiv_id FROM orders",
    "tokenize_counts": f"SELECT token, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({LIST('text')}) AS token FROM documents) WHERE len(token) > 2 AND token NOT IN {STOP} GROUP BY 1",
    "stem_tokens": f"SELECT DISTINCT item_id, {STEM_SQL} AS token FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\-]+')) AS t FROM benchmark) WHERE len(t) >= 3 AND t NOT IN {TOPIC_STOP}",
    "html_to_text_tokens": "SELECT page_id, len(regexp_extract_all(lower(b), '[a-z0-9]+'))::BIGINT AS words, greatest(1, len(b) // 4)::BIGINT AS estimate FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS b FROM pages)",
    "bm25_topk": f"WITH {BM25_SQL} SELECT item_id, doc_id, score, rank FROM bmr WHERE rank <= 5",
    "title_tf_topk": f"WITH {TITLE_SQL} SELECT item_id, doc_id, score, rank FROM tr WHERE rank <= 5",
    "hybrid_search": f"WITH {BM25_SQL}, {TITLE_SQL}, f AS (SELECT item_id, doc_id, round(sum(w / (60 + rank - 1)), 9) AS score FROM (SELECT item_id, doc_id, rank, 1.5::DOUBLE AS w FROM bmr WHERE rank <= 50 UNION ALL SELECT item_id, doc_id, rank, 1.0 FROM tr WHERE rank <= 50) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10",
    "two_phase_search": f"WITH {BM25_SQL}, w AS (SELECT item_id, count(*) AS wanted FROM qt GROUP BY 1), h AS (SELECT item_id, doc_id, count(*) AS held FROM qt JOIN tf USING (token) GROUP BY 1, 2), r AS (SELECT item_id, doc_id, CASE WHEN held = wanted THEN 0 ELSE 1 END::BIGINT AS phase, score FROM bm JOIN h USING (item_id, doc_id) JOIN w USING (item_id)), x AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY phase, score DESC, doc_id) AS rank FROM r) SELECT item_id, doc_id, phase, score, rank FROM x WHERE rank <= 20",
    "bm25_fields": FIELDS_SQL,
    "dedupe_exact": "SELECT md5(coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ''), '')) AS key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "dedupe_merge": "SELECT md5(coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ''), '')) AS key, min(doc_id) AS doc_id, max(n_chars) AS n_chars, array_to_string(list_sort(list(DISTINCT source) FILTER (source IS NOT NULL)), ',') AS sources, arg_min(lang, doc_id) AS lang, count(*) AS merged FROM documents GROUP BY 1",
    "containment_match": f"WITH {PASSAGES_SQL} SELECT item_id, doc_id FROM gold",
    "prf_at_k": f"{SWEPT_SQL} SELECT * FROM swept",
    "oracle_k": f"{SWEPT_SQL} SELECT item_id, min(k) FILTER (f1 = best) AS k, max(best) AS f1 FROM (SELECT *, max(f1) OVER (PARTITION BY item_id) AS best FROM swept) GROUP BY 1",
    "micro_macro_recall": f"{SWEPT_SQL} SELECT k, count(*) AS queries, round(sum(hits) / sum(gold), 4) AS micro_recall, round(avg(recall), 4) AS macro_recall, round(avg(precision), 4) AS precision, round(avg(f1), 4) AS f1, round(avg(hit), 4) AS hit_rate FROM swept GROUP BY 1",
    "gold_coverage": f"WITH {BM25_SQL}, {PASSAGES_SQL} SELECT item_id, doc_id, rank, rank IS NOT NULL AS matched FROM gold LEFT JOIN (SELECT item_id, doc_id, rank FROM bmr WHERE rank <= 10) USING (item_id, doc_id)",
    "candidate_loss": f"WITH {BM25_SQL}, {PASSAGES_SQL} SELECT item_id, doc_id FROM gold JOIN bmr USING (item_id, doc_id) WHERE rank <= 10 AND rank > 2",
    "drop_reason": "WITH g AS (SELECT * FROM labels JOIN documents USING (doc_id) WHERE quality = 1), p AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS cr FROM g WHERE lang <> 'fr') SELECT CASE WHEN cr IS NULL THEN 'source_missing' WHEN cr > 40 THEN 'candidate_rank_too_low' WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'evidence_validator_downgrade' WHEN toxic = 1 THEN 'llm_selector_misjudge' WHEN cr > 10 THEN 'dynamic_k_cutoff' ELSE 'unknown' END AS reason, count(*) AS items FROM g LEFT JOIN p USING (doc_id) GROUP BY 1",
    "selector_fp_fn": f"""WITH {JUDGED_SQL}, s AS (SELECT p.o_custkey, p.line, x.id IS NOT NULL AS good FROM pool p LEFT JOIN pairs x ON x.o_custkey = p.o_custkey AND x.id = p.id)
      SELECT o_custkey, count(*) FILTER (NOT good AND line <> 5 AND line % 4 IN (0, 1)) AS false_positive, count(*) FILTER (good AND (line = 5 OR line % 4 IN (2, 3))) AS false_negative FROM s WHERE good OR line <> 5 GROUP BY 1""",
    "gold_scores": f"WITH {SCORED_SQL} SELECT c AS o_custkey, tp AS true_positive, n AS predicted_count, gold AS gold_count, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM pr",
    "micro_scores": f"WITH {SCORED_SQL}, t AS (SELECT sum(tp)::BIGINT AS tp, sum(n)::BIGINT AS n, sum(gold)::BIGINT AS gold FROM sc) SELECT tp AS true_positive, n AS predicted_count, gold AS gold_count, round(tp / n, 4) AS precision, round(tp / gold, 4) AS recall, round(2 * (tp / n) * (tp / gold) / (tp / n + tp / gold), 4) AS f1 FROM t",
    "relaxed_hits": f"WITH {JUDGED_SQL}, f AS (SELECT o_custkey, min(rank) AS first FROM pairs GROUP BY 1) SELECT o_custkey, k::BIGINT AS k, coalesce((first <= k)::BIGINT, 0) AS hit FROM (SELECT DISTINCT o_custkey FROM golds) g LEFT JOIN f USING (o_custkey) CROSS JOIN (SELECT unnest([1, 3, 10]) AS k)",
    "ngram_terms": "WITH b AS (SELECT list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: len(x) > 2) AS w FROM benchmark), r AS (SELECT n, array_to_string(w[i:i+n-1], ' ') AS term FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b, (SELECT unnest([1, 2, 3]) AS n))), c AS (SELECT term, n, count(*) AS c FROM r GROUP BY 1, 2 HAVING count(*) >= 2) SELECT term, CASE WHEN n > 1 THEN c * 2 ELSE c END AS weight FROM c ORDER BY weight DESC, term LIMIT 30",
    "domain_route": f"SELECT item_id, {_domain_sql('biomedical')} AS biomedical_rate, {_domain_sql('cs_ai')} AS cs_ai_rate, {_domain_sql('physics_math')} AS physics_math_rate, 'local,openalex,semantic_scholar' || CASE WHEN {_domain_sql('biomedical')} > 0 OR regexp_matches(t, 'protein|antibody|clinical|medical|biomedical|drug') THEN ',pubmed' ELSE '' END || CASE WHEN {_domain_sql('cs_ai')} > 0 OR {_domain_sql('physics_math')} > 0 OR regexp_matches(t, 'arxiv|preprint|latest|recent') THEN ',arxiv' ELSE '' END AS providers FROM (SELECT item_id, lower(text) AS t FROM benchmark)",
    "round_robin": "WITH t AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents WHERE source IS NOT NULL), p AS (SELECT *, row_number() OVER (ORDER BY turn, source) AS place FROM t) SELECT doc_id, source, turn, place FROM p WHERE place <= 40",
    "stratified_topn": "WITH a AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents), b AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT doc_id, count(*) AS strata FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE r <= 10 GROUP BY 1",
    "session_list": "SELECT 'a' || (conv_id % 4) AS agent, conv_id, count(*) AS messages, max(turn) AS last_turn, substring(split_part(arg_min(text, turn) FILTER (role = 'user'), chr(10), 1), 1, 120) AS title FROM conversations GROUP BY 1, 2",
    "session_stats": "SELECT 'a' || (conv_id % 4) AS agent, count(DISTINCT conv_id) AS sessions, count(*) AS messages FROM conversations GROUP BY 1",
    "session_search_bm25": f"WITH {SESSION_SQL} SELECT item_id, agent, conv_id, turn, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, msg) AS n FROM sh) WHERE n <= 20",
    "search_grouped": f"WITH {SESSION_SQL} SELECT item_id, agent, conv_id, count(*) AS hits, max(score) AS best FROM sh GROUP BY 1, 2, 3",
}
ORACLE_SQL |= {"indexed_bm25": ORACLE_SQL["bm25_topk"], "indexed_two_phase": ORACLE_SQL["two_phase_search"]}
