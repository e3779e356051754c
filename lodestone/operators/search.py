"""Full-text search over many queries at once: postings, BM25, title ranking, two-phase fill and rank fusion."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T


def ranked(scored: DataFrame, by: list[str], order: list, k: int | None = None, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 within `by`; at most k of them (a window group limit, so each task keeps k a group)."""
    out = scored.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    return out if k is None else out.filter(F.col(name) <= k)


def with_previous(rows: DataFrame, by: str, order: str, value: str, name: str, width: int = 8192) -> DataFrame:
    """rows with the value of the row before, in order of a whole number within `by` (null: first; equal ones by the value's hash).

    A group may hold most rows, so it is cut into blocks of `width` numbers; only the blocks' last values are ordered group by group.
    """
    spot = F.struct(F.coalesce(F.col(order).cast("long"), F.lit(-(2**62))).alias("o"), F.xxhash64(value).alias("h"))
    rows = rows.withColumn("_at", spot).withColumn("_block", F.floor(F.col("_at.o") / width))
    within = Window.partitionBy(by, "_block").orderBy("_at")
    rows = rows.withColumns({"_nth": F.row_number().over(within), "_here": F.lag(value).over(within)})
    blocks = rows.groupBy(by, "_block").agg(F.max_by(value, "_at").alias("_last"))
    earlier = blocks.select(by, "_block", F.lag("_last").over(Window.partitionBy(by).orderBy("_block")).alias("_earlier"), F.lit(1).alias("_nth"))
    joined = rows.alias("r").join(earlier.alias("e"), F.col(f"r.{by}").eqNullSafe(F.col(f"e.{by}")) & F.col("r._block").eqNullSafe(F.col("e._block")) & (F.col("r._nth") == F.col("e._nth")), "left")
    kept = [F.col(f"r.{c}") for c in rows.columns if not c.startswith("_")]
    return joined.select(*kept, F.when(F.col("r._nth") == 1, F.col("_earlier")).otherwise(F.col("_here")).alias(name))


def query_terms(queries: DataFrame, key: str, text: str, most: int = 12) -> DataFrame:
    """key, token: the first `most` distinct words of three letters and more."""
    found = F.slice(F.array_distinct(F.filter(T.words(F.col(text)), lambda t: F.length(t) > 2)), 1, most)
    return queries.select(key, F.explode(found).alias("token"))


def postings(docs: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """key, token, tf. With terms (token), only those: the filter comes before the aggregation's shuffle."""
    found = docs.select(key, F.explode(T.words(F.col(text))).alias("token"))
    if terms is not None:
        found = found.join(terms.select("token").distinct(), "token", "left_semi")
    return found.groupBy(key, "token").agg(F.count("*").alias("tf"))


WORDS_A_TASK, MOST_SENT_TERMS = 1_000_000, 200_000


def tasks_for(spark: SparkSession, words: float | None) -> int:
    """Over how many tasks so many words go, so that a task's share stays the same when a table grows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil((words or 0) / WORDS_A_TASK))


def sent(terms: DataFrame, few: bool) -> DataFrame:
    """A few terms go to all tasks, so that documents need not move to them; many are joined."""
    return F.broadcast(terms) if few else terms


def few_terms(terms: DataFrame) -> bool:
    return terms.limit(MOST_SENT_TERMS + 1).count() <= MOST_SENT_TERMS


def bm25(docs: DataFrame, terms: DataFrame, key: str, text: str, query_key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_key, key, score, held (how many of the query's terms) for each document that shares a term with a query; higher is better.

    idf is log((N - n + 0.5) / (n + 0.5)), at least 1e-6; lengths count all words. A first pass gives the two statistics; then
    documents are dealt by key, over more tasks the more words they have, and stay there: words are counted and scores added without
    another shuffle. One row a document and query never waits for those of other tasks.
    """
    spark, few = docs.sparkSession, few_terms(terms)
    stats = docs.select(F.regexp_count(F.lower(text), F.lit("[a-z0-9]+")).alias("len")).agg(F.count("*").alias("docs"), F.avg("len").alias("mean_len"), F.sum("len").alias("words")).first()
    dealt = docs.select(key, text).repartition(tasks_for(spark, stats.words), key)
    split = dealt.select(key, T.words(F.col(text)).alias("_w")).select(key, F.size("_w").alias("len"), F.explode("_w").alias("token"))
    found = split.join(sent(terms.select("token").distinct(), few), "token", "left_semi").groupBy(key, "token", "len").agg(F.count("*").alias("tf"))
    df = found.groupBy("token").agg(F.count("*").alias("n"))
    idf = df.select("token", F.greatest(F.lit(1e-6), F.log((stats.docs - F.col("n") + 0.5) / (F.col("n") + 0.5))).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(stats.mean_len)))
    hits = found.join(sent(terms.join(idf, "token"), few), "token").select(query_key, key, part.alias("part"))
    return hits.groupBy(query_key, key).agg(F.sum("part").alias("score"), F.count("*").alias("held"))


def field_bm25(docs: DataFrame, terms: DataFrame, key: str, weights: Mapping[str, float], query_key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_key, key, score: BM25 over several fields; counts are summed by the fields' weights, lengths as they are.

    A field may be null, or an array of texts (a list of references, say).
    """
    kinds = dict(docs.dtypes)
    plain = docs.select(key, *[(F.array_join(f, " ") if kinds[f].startswith("array") else F.col(f)).alias(f) for f in weights])
    parts = [postings(plain, key, f, terms).withColumn("tf", F.col("tf") * w) for f, w in weights.items()]
    tf = reduce(DataFrame.unionByName, parts).groupBy(key, "token").agg(F.sum("tf").alias("tf"))
    words = [F.size(F.coalesce(T.words(F.col(f)), F.array().cast("array<string>"))) for f in weights]
    sized = plain.select(key, reduce(lambda x, y: x + y, words).alias("len"))
    stats = sized.agg(F.count("*").alias("docs"), F.avg("len").alias("mean"))
    idf = tf.groupBy("token").agg(F.count("*").alias("n")).crossJoin(F.broadcast(stats))  # one row of statistics
    idf = idf.select("token", "mean", F.greatest(F.lit(1e-6), F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    hits = tf.join(idf, "token").join(sized, key).withColumn("part", part)
    return terms.join(hits, "token").groupBy(query_key, key).agg(F.round(F.sum("part"), 6).alias("score"))


def title_scores(docs: DataFrame, queries: DataFrame, key: str, title: str, query_key: str, text: str, most_postings: int = 80_000) -> DataFrame:
    """query_key, key, score: sum of 1 + ln(tf) over a query's tokens (repeats count), plus 5 if its letters are in the title's.

    Tokens with more than most_postings postings are left out unless a query has no other.
    """
    titled = docs.select(key, F.coalesce(F.col(title), F.lit("")).alias("title"))
    found = titled.select(key, F.explode(T.tokens(F.col("title"))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    asked = queries.select(query_key, F.explode(T.query_tokens(F.col(text))).alias("token")).groupBy(query_key, "token").agg(F.count("*").alias("times"))
    df = found.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    known = asked.join(df, "token").withColumn("rare", F.col("n") <= most_postings)
    any_rare = F.max("rare").over(Window.partitionBy(query_key))
    used = known.withColumn("any_rare", any_rare).filter(F.col("rare") | ~F.col("any_rare")).drop("n", "rare", "any_rare")
    scored = used.join(found, "token").groupBy(query_key, key).agg(F.sum(F.col("times") * (1 + F.log("tf"))).alias("sum"))
    letters = queries.select(query_key, T.letters_key(F.array_join(T.query_tokens(F.col(text)), "")).alias("letters"))
    whole = scored.join(letters, query_key).join(titled.select(key, T.letters_key(F.col("title")).alias("title_letters")), key)
    bonus = F.when(F.col("title_letters").contains(F.col("letters")), 5.0).otherwise(0.0)
    return whole.select(query_key, key, (F.col("sum") + bonus).alias("score"))


def two_phase(scored: DataFrame, terms: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """Documents with all of a query's terms first, then those with any, each by score; k in all. scored as bm25 gives it."""
    wanted = terms.groupBy(query_key).agg(F.count("*").alias("wanted"))
    rows = scored.join(wanted, query_key)
    rows = rows.withColumn("phase", F.when(F.col("held") == F.col("wanted"), 0).otherwise(1).cast("long"))
    return ranked(rows, [query_key], ["phase", F.desc(F.round("score", 6)), key], k)


def reciprocal_rank_fusion(lists: DataFrame, by: list[str], key: str, k: float = 60.0) -> DataFrame:
    """by, key, score from lists (by, key, rank from 0, weight): the sum of weight / (k + rank)."""
    return lists.groupBy(*by, key).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))


def snippet(text, term, width: int = 12):
    """About `width` words around the first hit of term, the hit in << >>."""
    parts = F.split(text, r"\s+")
    at = F.greatest(F.lit(1), F.array_position(F.transform(parts, lambda w: F.lower(w).contains(F.lower(term))), F.lit(True)).cast("int"))
    shown = F.slice(parts, F.greatest(F.lit(1), at - width // 2), width)
    return F.array_join(F.transform(shown, lambda w: F.when(F.lower(w).contains(F.lower(term)), F.concat(F.lit("<<"), w, F.lit(">>"))).otherwise(w)), " ")
