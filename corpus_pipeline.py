"""A corpus pipeline of five stages: drop toxic documents, exact copies and near copies, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs. Columns beyond doc_id, text and source pass through. Stages decide
row by row: rows that share a doc_id or have none are documents of their own. An empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from lodestone.llm.common import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose predicted toxicity stays under the threshold; the model learns from docs and the labels."""
    prefix = "p_"
    while {(prefix + c).lower() for c in toxicity.CATEGORIES} & {c.lower() for c in docs.columns}:
        prefix += "_"
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=docs.columns, prefix=prefix)
    return scored.filter(F.col(prefix + "toxic") < toxicity.THRESHOLD).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; of rows that repeat it, one. Names of chunks decide; texts move once, to be kept."""
    if ids_are_unique(docs):
        kept = materialize(exact_dedup.exact_dedup(docs).filter("kept").select("doc_id"), "kept")
        return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(docs.columns)  # ids have no size bound to broadcast by
    key, sha = free(docs, "key"), free(docs, "sha")
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(filled("doc_id").alias(key), F.col("text_sha256").alias(sha))
    named = docs.withColumns({key: filled("doc_id"), sha: F.sha2(F.coalesce("text", F.lit("")), 256)})
    return named.join(materialize(kept, "kept"), [key, sha], "left_semi").dropDuplicates([key, sha]).select(docs.columns)


def filled(name: str) -> Column:
    """An id that compares like any other where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def ids_are_unique(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty()


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the column that tells its rows apart: doc_id, or where ids repeat or lack, a number that is written with the rows."""
    if ids_are_unique(docs):
        return docs, "doc_id"
    number = free(docs, "number")
    return materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered"), number


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.85 or more), the document with the smallest doc_id; documents without words all stay.

    Where ids repeat or lack, each row is a document of its own and the first written one of a group stays.
    """
    rows, key = numbered(docs)
    found = near_dedup.near_dedup(rows.select(F.col(key).alias("doc_id"), "text"))
    dropped = materialize(found.filter("not kept").select(F.col("doc_id").alias(key)), "dropped")
    return rows.join(dropped.hint("merge"), key, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, taken / size, rounded (0, 1 or 2), in the order of their slots; those without words once, last."""
    rows, key = numbered(docs)
    times, slot = free(docs, "times"), free(docs, "slot")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("int")
    mixed = mixing.mix(rows.select(F.col(key).alias("doc_id"), "text", "source"))
    slots = F.when(F.size("slots") > 0, F.col("slots")).otherwise(F.array(F.lit(2**62)))
    taken = mixed.select(F.col("doc_id").alias(key), copies.alias(times), slots.alias(slot)).filter(F.col(times) > 0)
    taken = taken.select(key, F.explode(F.slice(F.concat(slot, F.array_repeat(F.element_at(slot, -1), F.col(times))), F.lit(1), F.col(times))).alias(slot))
    joined = rows.join(materialize(taken, "taken").hint("merge"), key)
    return joined.repartitionByRange(slot, key).sortWithinPartitions(slot, key).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, as digests."""
    return packing.digest(packing.pack(docs, packing.tokenizer_file()))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]
ORACLE_SQL: str | None = None  # a learned model decides in the first stage; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the stages before it are written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
