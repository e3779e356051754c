"""Operator 2, mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Slot n of 2**m slots has the van der Corput point rev(n) / 2**m (rev reverses m bits). Cumulative targets cut the unit
interval into one piece per source; the piece that a slot's point falls in names the slot's source. Over all 2**m
slots a piece of length p gets p * 2**m slots, give or take one. Slots are ranked within their source; the slot of
rank r takes the r-th block of equally many words from the source's documents, which are shuffled by a hash of their
ids and laid end to end twice. The result names the slots at which a document's words come up, which is the order of
the mix. Sums run within (source, bucket) first and over buckets next, with about as many buckets as there are rows in
a bucket, so that no task holds a whole source; sums over sources run by ranges of sources likewise.
"""

from __future__ import annotations

from math import ceil, log2, sqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, materialize, table

WEIGHTS = (3, 1, 2)
SHARE, MOST_REPEATS = 1.5, 2
WORDS_A_SLOT, LEAST_SLOT_BITS = 128, 14
STRIDE_BITS = 10


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0), key (the shuffling order; rows without an id by their text), digest (of the text)."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("no id:"), digest))).alias("key"),
        digest.alias("digest"),
    )


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums (rows so far, each included) in the given order, without a task that holds them all.

    Rows are dealt by ranges of the order; sums run within a range, and over the ranges' totals, one row a range.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made = dealt.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(F.broadcast(totals), "_range")  # at most a row a shuffle partition
    return made.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums])


def source_targets(rows: DataFrame) -> DataFrame:
    """source, source_size, target for each source of rows (source, size); one row per source.

    Sources by code point, null last, weigh WEIGHTS in turn. With caps c = MOST_REPEATS * source_size, level x is the
    one at which the sum of min(weight * x, c) is SHARE of all words: a source is capped if that sum at its own
    level c / weight is still at most the total.
    """
    by_source = [F.col("source").asc_nulls_last()]
    per = running(rows.groupBy("source").agg(F.sum("size").alias("source_size")), by_source, {"nth": F.lit(1)})
    weigh = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.col("nth") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weigh).withColumn("cap", MOST_REPEATS * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    whole = per.agg((F.sum("source_size") * F.lit(SHARE)).alias("total"), F.sum("weight").alias("weights"))
    per = running(per, [F.col("level").asc(), *by_source], {"caps_below": F.col("cap"), "weight_below": F.col("weight")}).crossJoin(F.broadcast(whole))  # one row
    capped = F.col("caps_below") + F.col("level") * (F.col("weights") - F.col("weight_below")) <= F.col("total")
    per = materialize(per.withColumn("capped", capped), "levels")
    fixed = per.agg(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0)).alias("fixed"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("weight_left"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("total") - F.col("fixed")) / F.col("weight_left"))
    return per.crossJoin(F.broadcast(fixed)).select("source", "source_size", target.alias("target"))  # one row


def reversed_bits(n: Column, bits: int) -> Column:
    """The lowest bits of n (a long) in reverse order."""
    for shift, mask in ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        n = F.shiftrightunsigned(n, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(mask)), shift))
    n = F.shiftrightunsigned(n, 32).bitwiseOR(F.shiftleft(n, 32))
    return F.shiftrightunsigned(n, 64 - bits)


def schedule(targets: DataFrame, bits: int) -> DataFrame:
    """slot, source, rank: the source of each of 2**bits slots and the slot's rank (from 0) within its source."""
    total = targets.agg(F.sum("target").alias("total"))
    edge = lambda x: F.ceil(x / F.col("total") * F.lit(float(2**bits))).cast("long")
    placed = running(targets.filter("target > 0"), [F.col("source").asc_nulls_last()], {"upto": F.col("target")}).crossJoin(F.broadcast(total))  # one row
    pieces = placed.select("source", edge(F.col("upto") - F.col("target")).alias("low"), edge(F.col("upto")).alias("high")).filter("low < high")
    pieces = pieces.withColumn("cell", F.lit(0).cast("long"))
    for level, shift in enumerate(range(-(-bits // STRIDE_BITS) * STRIDE_BITS - STRIDE_BITS, 0, -STRIDE_BITS)):  # cells of falling size, at most 2**STRIDE_BITS a row
        above = shift + STRIDE_BITS
        first, last = F.greatest("low", F.shiftleft("cell", above)), F.least(F.col("high"), F.shiftleft(F.col("cell") + 1, above)) - 1
        pieces = pieces.withColumn("cell", F.explode(F.sequence(F.shiftright(first, shift), F.shiftright(last, shift))))
        pieces = pieces.repartition("source", "cell") if level else pieces
    slots = targets.sparkSession.range(2**bits).select(F.col("id").alias("slot"), reversed_bits(F.col("id"), bits).alias("point"))
    slots = slots.withColumn("cell", F.shiftright("point", STRIDE_BITS))
    mapped = slots.join(pieces.hint("shuffle_hash"), "cell").filter("point >= low and point < high")
    mapped = mapped.select("slot", "source", F.shiftright("slot", (bits + 1) // 2).alias("run"))
    runs = mapped.groupBy("source", "run").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("source", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("source", "run").orderBy("slot"))
    ranked = mapped.withColumn("nth", nth).alias("m").join(runs.alias("r"), F.col("m.source").eqNullSafe(F.col("r.source")) & (F.col("m.run") == F.col("r.run")))
    return ranked.select("slot", "m.source", (F.col("before") + F.col("nth") - 1).alias("rank"))


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken, slots.

    taken counts the document's words in the mix, repeats included; it is at most MOST_REPEATS times size. slots lists,
    for each time that the document comes up, the slot of its first word, so that rows in order of slots are the mix. A source's
    taken words fall short of its target by a block or two at most. Documents without words, and all documents when
    there are no words at all, have taken 0 and no slots. Repeated rows are rows like others: they lie end to end in the order of
    their ids' hash, then of their texts' digest, so a source's last words may go to one of them and not the other.
    Rows without an id are shuffled by their text. Other columns of docs are ignored.
    """
    rows = materialize(sizes(docs).withColumn("row", F.monotonically_increasing_id()), "sizes")
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = materialize(source_targets(rows), "targets")
    bits = max(LEAST_SLOT_BITS, ceil(log2(max(1, SHARE * words / WORDS_A_SLOT))))
    block = max(1, ceil(SHARE * words / 2**bits))
    buckets = max(1, round(sqrt(n)))

    with_bucket = rows.filter("size > 0").withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 7), 16, 10).cast("long") * buckets / 2**28))
    per_bucket = with_bucket.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "digest", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = with_bucket.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("d")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    placed = placed.join(per_bucket.alias("b"), same("d", "b") & (F.col("d.bucket") == F.col("b.bucket")))
    placed = placed.select("row", "d.source", "size", (F.col("before") + F.col("inside")).alias("start"))
    placed = placed.alias("p").join(targets.alias("t"), same("p", "t"))
    placed = placed.select("row", "p.source", "size", "start", "source_size", "target")

    start, size, end = F.col("start"), F.col("size"), F.least(F.col("at") + F.col("size"), F.round("target").cast("long"))
    laid = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MOST_REPEATS - 1))))
    laid = laid.withColumn("at", F.col("pass") * F.col("source_size") + start).withColumn("end", end).filter("size > 0 and at < end")
    numbers = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))
    pieces = laid.select("row", "pass", "source", "at", "end", F.explode(numbers).alias("rank"))
    words_in = F.least("end", (F.col("rank") + 1) * block) - F.greatest("at", F.col("rank") * block)
    pieces = pieces.select("row", "pass", "source", "rank", words_in.alias("words"))
    slots = schedule(targets, bits)
    used = pieces.alias("x").join(slots.alias("s"), same("x", "s") & (F.col("x.rank") == F.col("s.rank")))
    slots = F.array_compact(F.array(*[F.min(F.when(F.col("pass") == k, F.col("slot"))) for k in range(MOST_REPEATS)]))
    taken = used.groupBy("row").agg(F.sum("words").alias("taken"), slots.alias("slots"))
    out = rows.alias("d").join(targets.alias("t"), same("d", "t")).select("doc_id", "row", "d.source", "size", "source_size", "target").join(taken, "row", "left")
    none = F.array().cast("array<bigint>")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", none).alias("slots"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_mixing": op2_mixing}
ORACLE_SQL = {
    "op2_mixing": rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
n AS (SELECT count(*) AS n, sum(size)::BIGINT AS words FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM s0),
s2 AS (SELECT *, 2 * source_size AS cap, (2 * source_size) / weight::DOUBLE AS level FROM s1),
s3 AS (SELECT a.source, a.source_size, a.weight, a.cap,
         (SELECT sum(least(b.weight * a.level, b.cap)) FROM s2 b) <= (SELECT sum(source_size) * 1.5 FROM s2) + 1e-6 AS capped FROM s2 a),
s4 AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
         weight * ((SELECT sum(source_size) * 1.5 FROM s3) - (SELECT coalesce(sum(cap), 0) FROM s3 WHERE capped))::DOUBLE
         / (SELECT sum(weight) FROM s3 WHERE NOT capped) END AS target FROM s3),
p AS (SELECT greatest(14, ceil(log2(greatest(1, 1.5 * words / 128))))::BIGINT AS bits, words FROM n),
q AS (SELECT bits, 1 << bits AS slots, greatest(1, ceil(1.5 * words / (1 << bits)))::BIGINT AS block FROM p),
s5 AS (SELECT *, sum(target) OVER (ORDER BY source NULLS LAST) AS upto, sum(target) OVER () AS total FROM s4 WHERE target > 0),
s6 AS (SELECT source, ceil(upto / total * slots)::BIGINT - ceil((upto - target) / total * slots)::BIGINT AS got, block FROM s5, q),
s7 AS (SELECT s4.source, source_size, target, coalesce(least(got * block, round(target)::BIGINT), 0) AS line
       FROM s4 LEFT JOIN s6 ON s4.source IS NOT DISTINCT FROM s6.source),
e AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, line - start)) + greatest(0, least(size, line - source_size - start)))::BIGINT AS taken
FROM e JOIN s7 ON e.source IS NOT DISTINCT FROM s7.source"""
}
