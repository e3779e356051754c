"""A stored inverted index: postings by token bucket, in segments, so that a search reads the buckets of the asked tokens only.

    path/postings/segment=S/bucket=B   token, key, tf, len, sorted by token
    path/tokens/segment=S/bucket=B     token, n (documents that hold it)
    path/stats/segment=S               docs, words, filled, buckets; written last, so a segment without it does not count
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.search import few_terms, sent, tasks_for
from lodestone.sources.shared import Folder

BUCKETS = 256


def bucket_of(token: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, path: str, tasks: int, *order: str) -> None:
    """Rows go by ranges of bucket and token, so a token of a third of all postings is cut over tasks and files."""
    keys = ["bucket", *order]
    rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).write.partitionBy("bucket").parquet(path)


def add_to_index(docs: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS) -> str:
    """Index docs as a new segment and return its name. Keys are ones that the index lacks; null keys and texts give no postings.

    A null text counts as an empty document, as a search over the texts themselves counts it. A build that stops leaves a
    segment without stats behind, which no reader sees. Repeated keys are repeated documents. All segments of an index have
    the number of buckets of the first.
    """
    spark, segment = docs.sparkSession, uuid.uuid4().hex
    if (stored := _stats(spark, path)) is not None:
        buckets = stored.first().buckets
    counted = docs.select(F.regexp_count(F.lower(text), F.lit("[a-z0-9]+")).alias("len")).agg(F.count("*").alias("docs"), F.sum("len").alias("words"), F.count("len").alias("filled")).first()
    tasks = tasks_for(spark, counted.words)
    split = docs.select(F.col(key).alias("key"), text).repartition(tasks, "key").select("key", T.words(F.col(text)).alias("_w"))
    sized = split.select("key", F.size("_w").alias("len"), F.explode("_w").alias("token"))
    found = sized.groupBy("key", "token", "len").agg(F.count("*").alias("tf")).withColumn("bucket", bucket_of("token", buckets))
    _written(found.select("bucket", "token", "key", "tf", "len"), f"{path}/postings/segment={segment}", tasks, "token", "key")
    any_posting = any(n.startswith("bucket=") for n in Folder(spark, f"{path}/postings/segment={segment}").names())
    again = spark.read.parquet(f"{path}/postings/segment={segment}") if any_posting else found.limit(0)
    _written(again.groupBy("bucket", "token").agg(F.count("*").alias("n")), f"{path}/tokens/segment={segment}", tasks, "token")
    stats = spark.createDataFrame([(counted.docs, counted.words, counted.filled, buckets)], "docs long, words long, filled long, buckets int").coalesce(1)
    stats.write.parquet(f"{path}/stats/segment={segment}")
    return segment


def segments(spark: SparkSession, path: str) -> list[str]:
    """Finished segments."""
    stats = Folder(spark, f"{path}/stats")
    return [n for n in stats.names() if n.startswith("segment=") and stats.has(f"{n}/_SUCCESS")]


def _stats(spark: SparkSession, path: str) -> DataFrame | None:
    found = segments(spark, path)
    return spark.read.option("basePath", f"{path}/stats").parquet(*[f"{path}/stats/{s}" for s in found]) if found else None


def read_buckets(spark: SparkSession, path: str, kind: str, buckets: list[int] | None = None) -> DataFrame | None:
    """`postings` or `tokens` of the finished segments, of some buckets; None where nothing is stored."""
    root = Folder(spark, f"{path}/{kind}")
    stored = [f"{path}/{kind}/{s}" for s in segments(spark, path) if any(n.startswith("bucket=") for n in root.names(s))]
    if not stored:
        return None
    rows = spark.read.option("basePath", f"{path}/{kind}").parquet(*stored)
    return rows if buckets is None else rows.filter(F.col("bucket").isin(*buckets))


def stored_bm25(spark: SparkSession, path: str, terms: DataFrame, key: str, query_key: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_key, key, score, held, as search.bm25() gives them over the indexed texts; terms has query_key and token.

    Only the buckets of asked tokens are read; their numbers pass the driver. Asked postings are dealt by key, over more tasks the more
    words are indexed, and a document's scores are added where it lies.
    """
    asked, stats, few = terms.select("token").distinct(), _stats(spark, path), few_terms(terms)
    parts = stats.first().buckets if stats is not None else BUCKETS
    buckets = [r.bucket for r in asked.select(bucket_of("token", parts).alias("bucket")).distinct().collect()]
    found, counts = (read_buckets(spark, path, kind, buckets) for kind in ("postings", "tokens"))
    if found is None or counts is None:
        kinds = dict(terms.dtypes)
        return spark.createDataFrame([], f"`{query_key}` {kinds[query_key]}, `{key}` long, score double, held long")
    whole = stats.agg(F.sum("docs").alias("docs"), (F.sum("words") / F.sum("filled")).alias("mean_len"), F.sum("words").alias("words")).first()
    known = counts.join(sent(asked, few), "token", "left_semi").groupBy("token").agg(F.sum("n").alias("n"))
    idf = known.select("token", F.greatest(F.lit(1e-6), F.log((whole.docs - F.col("n") + 0.5) / (F.col("n") + 0.5))).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(whole.mean_len)))
    dealt = found.join(sent(asked, few), "token", "left_semi").repartition(tasks_for(spark, whole.words), "key")
    hits = dealt.join(sent(terms.join(idf, "token"), few), "token").select(query_key, F.col("key").alias(key), part.alias("part"))
    return hits.groupBy(query_key, key).agg(F.sum("part").alias("score"), F.count("*").alias("held"))
