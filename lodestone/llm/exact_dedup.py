"""Operator 1, exact dedup by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so: at the first white space at least MIN_CHUNK characters on that a letter
of CUT follows, and MAX_CHUNK characters on at the latest. Chunks get names, and the names are verified: each distinct
chunk moves once and is compared with all that bear its name. Chunks whose name turns out to be shared get the next
stronger one of NAMINGS, the last of which is the chunk itself; all others keep theirs (if more than MOST_SHARED names are
shared, all change). Texts are equal when their ordered lists of names (and byte lengths) are equal, so whole documents
never move.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table

MIN_CHUNK, MAX_CHUNK, CUT = 256, 4096, "a-d"
MOST_SHARED = 1000
Naming = Callable[[Column], Column]
NAMINGS: tuple[Naming, ...] = (lambda c: F.xxhash64(c), lambda c: F.sha2(c, 256), lambda c: c)


def chunks(text: Column) -> Column:
    """The chunks of a text, in order; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?\s(?=[{CUT}])|.{{1,{MAX_CHUNK}}}"), F.lit(0))


def shared_names(texts: DataFrame, naming: Naming) -> DataFrame:
    """The names that two different chunks of the column text bear; a distributed comparison of all distinct chunks."""
    chunk = texts.select(F.explode(chunks(F.col("text"))).alias("chunk"))
    distinct = chunk.select(naming(F.col("chunk")).alias("name"), "chunk").distinct()
    return distinct.groupBy("name").count().filter("count > 1").select("name")


def names_are_shared(texts: DataFrame, naming: Naming) -> bool:
    return not shared_names(texts, naming).isEmpty()


def strengthened(naming: Naming, stronger: Naming, shared: Sequence, level: int) -> Naming:
    """naming, but stronger (marked by its level) for chunks whose name is among shared."""
    plain = lambda c: naming(c).cast("string")
    marked = lambda c: F.concat(F.lit(f"{level}:"), stronger(c).cast("string"))
    return lambda c: F.when(naming(c).isin(list(shared)), marked(c)).otherwise(F.concat(F.lit("0:"), plain(c)))


def verified(texts: DataFrame, namings: Sequence[Naming] = NAMINGS) -> Naming:
    """A naming under which no two chunks of the column text share a name."""
    naming = namings[0]
    for level, stronger in enumerate(namings[1:], 1):
        shared = [r.name for r in shared_names(texts, naming).limit(MOST_SHARED + 1).collect()]
        if not shared:
            break
        naming = strengthened(naming, stronger, shared, level) if len(shared) <= MOST_SHARED else stronger
    return naming


def exact_dedup(docs: DataFrame, namings: Sequence[Naming] = NAMINGS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, recipe_length.

    Null texts count as empty; empty texts equal each other. The largest doc_id of a group stays (a null doc_id is the
    smallest); of repeated rows with that doc_id one stays. Other columns of docs are ignored. An empty table gives
    an empty result.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    naming = verified(texts, namings)
    rows = texts.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.sha2("text", 256).alias("text_sha256"),
        F.octet_length("text").alias("n_bytes"),
        F.transform(chunks(F.col("text")), naming).alias("recipe"),
    )
    rows = materialize(rows, "recipes")  # so that row numbers are the same in both uses, and texts are read once
    groups = rows.groupBy("recipe", "n_bytes").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    # Written out, the groups are dealt anew for the join, which then can split the rows of a large group over tasks.
    return rows.join(materialize(groups, "groups"), ["recipe", "n_bytes"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("recipe_length"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("recipe_length")


QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLE_SQL = {
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
