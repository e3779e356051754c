"""Stores over Parquet: run records with upserts, append-only logs, session partitions, indexes that resume, JSON reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import letters_key

RUNS = "job_id string, kind string, status string, stage string, progress double, query string, started_at string, finished_at string, error string, created_at string, updated_at string"
ONCE = ("started_at", "created_at")  # an upsert leaves these as they were


def upserted_runs(store: DataFrame, new: DataFrame) -> DataFrame:
    """store with the runs of new; new values win but for ONCE. Of several new rows of a job the latest updated_at counts."""
    last = new.groupBy("job_id").agg(F.max(F.struct("updated_at", *[c for c in new.columns if c != "updated_at"])).alias("r")).select("r.*")
    old = store.select([F.col(c).alias(f"old_{c}") for c in store.columns])
    joined = old.join(last, F.col("old_job_id") == F.col("job_id"), "full_outer")
    was = F.col("job_id").isNull()
    pick = lambda c: F.coalesce(f"old_{c}", c) if c in ONCE else F.when(was, F.col(f"old_{c}")).otherwise(F.col(c))
    return joined.select([pick(c).alias(c) for c in store.columns])


def recovered_runs(store: DataFrame) -> DataFrame:
    """Runs as a restart finds them: what was queued or running has failed."""
    lost = F.col("status").isin("running", "queued")
    return store.withColumns({"error": F.when(lost, F.coalesce("error", F.lit("interrupted"))).otherwise(F.col("error")), "status": F.when(lost, "failed").otherwise(F.col("status"))})


def append_logs(logs: DataFrame, path: str) -> None:
    logs.write.mode("append").parquet(path)


def write_sessions(messages: DataFrame, path: str) -> None:
    """Replace the partitions (agents) that messages hold and leave the others as they are."""
    messages.repartition("agent").sortWithinPartitions("session_id", "ordinal").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("agent").parquet(path)


def reference_text(papers: DataFrame, references: str, most: int = 12_000) -> DataFrame:
    """papers with refs: reference titles in one text, cut at `most` characters as the index stores it."""
    return papers.withColumn("refs", F.substring(F.concat_ws(" ", F.array_distinct(references)), 1, most))


def write_corpus(papers: DataFrame, path: str) -> None:
    """The full-text table: arxiv_id, title, abstract, refs, title_key. Spark commits its files at the end, so readers never see half of them."""
    rows = reference_text(papers, "references").withColumn("title_key", letters_key(F.col("title"))).filter("title_key <> ''")
    rows.select("arxiv_id", "title", F.coalesce("abstract", F.lit("")).alias("abstract"), "refs", "title_key").write.mode("overwrite").parquet(path)


def read_corpus(spark: SparkSession, path: str, enabled: bool = True) -> DataFrame | None:
    """The full-text table, or None if it is switched off or isn't there."""
    try:
        return spark.read.parquet(path) if enabled else None
    except AnalysisException:
        return None


def vector_index(vectors: DataFrame, titles: DataFrame) -> DataFrame:
    """vectors (arxiv_id, embedding) with their titles; those without a title can't be shown and go."""
    return vectors.join(titles.select("arxiv_id", "title").filter("trim(title) <> ''"), "arxiv_id")


def append_vectors(papers: DataFrame, path: str, key: str, embed: Callable[[DataFrame], DataFrame]) -> int:
    """Embed (key, text) -> (key, embedding) what the vectors at path lack and append it there; returns how many were lacking."""
    spark = papers.sparkSession
    try:
        done = spark.read.parquet(path)
    except AnalysisException:
        done = spark.createDataFrame([], f"`{key}` {dict(papers.dtypes)[key]}")
    todo = missing_vectors(papers, done, key).select(key, "text")
    n = todo.count()
    if n:
        embed(todo).write.mode("append").parquet(path)
    return n


def with_cached_vectors(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """texts (text) with the embedding that the cache (hash, embedding) holds for the model, or null."""
    return texts.withColumn("hash", cache_key(model)).join(cache.select("hash", "embedding"), "hash", "left")


def missing_vectors(papers: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Papers whose vector is still to be made: a build resumes with these after a stop. Needs a title."""
    titled = papers.filter("trim(coalesce(title, '')) <> ''").withColumn("text", F.concat_ws(" ", "title", "abstract"))
    return titled.join(done.select(key), key, "left_anti")


def cache_key(model: str, text: str = "text") -> Column:
    return F.md5(F.concat(F.lit(model), F.lit(":"), F.col(text)))


def report(cases: DataFrame, key: str) -> DataFrame:
    """key, json: every case as one JSON text."""
    return cases.select(key, F.to_json(F.struct(*cases.columns)).alias("json"))
