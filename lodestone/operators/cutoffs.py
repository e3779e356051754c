"""How many results to return: cut-offs over ranked scores, for all queries at once by windows.

Inputs have a query column `by`, `rank` from 1 and a score or probability; results have one row per query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Expected number of answers and least probability by query type, and whether the type is broad.
PROFILES = (
    ("exact_title", 1.0, 0.50, False),
    ("single_gold", 1.0, 0.50, False),
    ("specific_paper", 2.0, 0.45, False),
    ("dataset_constraint", 4.5, 0.22, False),
    ("method_comparison", 4.5, 0.22, False),
    ("latest_work", 6.0, 0.18, True),
    ("broad_topic", 8.0, 0.18, True),
    ("survey", 10.0, 0.18, True),
    ("unknown", 4.0, 0.22, False),
)


def f_beta_cutoff(ranked: DataFrame, by: str, p: str, beta: float = 1.0) -> DataFrame:
    """by, k, best, tau: the k with the largest expected F-beta, the smaller of equals (within 1e-12)."""
    prefix = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    curve = ranked.select(by, "rank", F.sum(p).over(prefix).alias("hits"), F.sum(p).over(Window.partitionBy(by)).alias("total"))
    f = (1 + beta**2) * F.col("hits") / (F.col("rank") + beta**2 * F.col("total"))
    curve = curve.withColumn("f", F.when(F.col("total") > 0, f).otherwise(0.0))
    best = curve.withColumn("best", F.max("f").over(Window.partitionBy(by))).filter("f >= best - 1e-12")
    return best.groupBy(by).agg(F.min("rank").alias("k"), F.max("best").alias("best"), (F.max("best") / (1 + beta**2)).alias("tau"))


def tiers(ranked: DataFrame, by: str, p: str, wide: float = 1.5, least_high: int = 1, most: int | None = None) -> DataFrame:
    """ranked with tier: high up to the F1 cut-off, partial up to the F-beta one, else excluded."""
    high = f_beta_cutoff(ranked, by, p, 1.0).select(by, F.col("k").alias("k_high"))
    part = f_beta_cutoff(ranked, by, p, max(1.0, wide)).select(by, F.col("k").alias("k_partial"))
    joined = ranked.join(high, by).join(part, by)
    k1 = F.greatest(F.col("k_high"), F.lit(least_high))
    k2 = F.greatest(k1, F.col("k_partial"))
    k2 = k2 if most is None else F.least(k2, F.lit(most))
    tier = F.when(F.col("rank") <= F.least(k1, k2), "high").when(F.col("rank") <= k2, "partial").otherwise("excluded")
    return joined.withColumn("tier", tier).drop("k_high", "k_partial")


def score_gap(ranked: DataFrame, by: str, score: str, gap: float = 0.05, relative: float = 0.08, most: int = 20, least: int = 1) -> DataFrame:
    """by, k: the rank before the largest drop that passes both thresholds, among the first most + 5; null without one."""
    w = Window.partitionBy(by).orderBy("rank")
    drops = ranked.select(by, "rank", score, (F.col(score) - F.lead(score).over(w)).alias("gap"))
    good = (F.col("gap") > gap) & (F.col("gap") / F.greatest(F.col(score), F.lit(1e-6)) > relative) & (F.col("rank") <= most + 5)
    best = drops.groupBy(by).agg(F.count("*").alias("n"), F.max_by("rank", F.when(good, F.struct("gap", -F.col("rank")))).alias("at"))
    k = F.when(F.col("n") < 2, F.least(F.lit(least), F.col("n"))).otherwise(F.least(F.lit(most), F.greatest(F.lit(least), F.col("at"))))
    return best.select(by, F.when((F.col("n") < 2) | F.col("at").isNotNull(), k).cast("long").alias("k"))


def percentile_drop(ranked: DataFrame, by: str, score: str, drop: float = 0.15, most: int = 20, least: int = 1, ratio: float = 2.5) -> DataFrame:
    """by, k: the place of an outstanding drop among the first `most`, else the prefix within `drop` of the top; at least a quarter of the range."""
    w = Window.partitionBy(by).orderBy("rank")
    size = F.least(F.lit(most), F.count("*").over(Window.partitionBy(by)))
    rows = ranked.select(by, "rank", score, F.lead(score).over(w).alias("next"), size.alias("range")).filter(F.col("rank") <= F.col("range"))
    gap = F.when((F.col("rank") < F.col("range")) & (F.col(score) > F.col("next")), F.col(score) - F.col("next"))
    top = F.max(F.when(F.col("rank") == 1, F.col(score))).over(Window.partitionBy(by))
    rows = rows.withColumn("gap", gap).withColumn("top", top)
    gaps = F.array_sort(F.collect_list("gap"))
    got = rows.groupBy(by).agg(
        F.max("range").alias("range"),
        F.max("top").alias("top"),
        gaps.alias("gaps"),
        F.max_by("rank", F.struct("gap", -F.col("rank"))).alias("at"),
        F.max("gap").alias("largest"),
        F.min(F.when(F.col(score) < F.col("top") * (1 - drop), F.col("rank"))).alias("below"),
    )
    median = F.when(F.size("gaps") > 0, F.element_at("gaps", (F.size("gaps") / 2).cast("int") + 1))
    floor = F.greatest(F.lit(least), F.floor(F.col("range") / 4))
    cliff = (median > 0) & (F.col("largest") / median > ratio)
    prefix = F.when(F.col("top") <= 0, floor).otherwise(F.greatest(floor, F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(F.col("below") - 1, F.col("range"))))))
    return got.select(by, F.when(cliff, F.greatest(floor, F.least("at", F.lit(most)))).otherwise(prefix).cast("long").alias("k"))


def expected_f1(ranked: DataFrame, by: str, p: str, kind: str = "query_type", slack: float = 0.02, most: int | str = 20, must_have: str | None = None) -> DataFrame:
    """by, g_hat, k, best: the controller's k for ranked (by, rank, p, kind).

    The number of answers is fused from the type's prior, the density of good results and the probabilities. The curve
    2 * hits / (k + answers), to 4 places, ends before the first rank (from 2) under the type's least probability;
    of the k within slack of its maximum the largest is taken. If the first ten probabilities are all alike and low (mean
    under 0.35, deviation under 0.05), at most 5 results are taken, 10 for broad types. most is a number or a column of ranked. With must_have (a column: how many constraints a
    query has to meet) the prior is cut by 0.7 above three and raised by 1.3 at none; null leaves it.
    """
    spark = ranked.sparkSession
    profile = F.broadcast(spark.createDataFrame(PROFILES, "query_type string, prior double, least double, broad boolean"))
    agg = ranked.groupBy(by, kind).agg(
        F.count("*").alias("n"),
        (0.35 * F.sum(F.when(F.col(p) >= 0.50, 2).when(F.col(p) >= 0.25, 1).otherwise(0))).alias("pool"),
        F.sum(F.when(F.col(p) > 0.05, F.col(p)).otherwise(0.0)).alias("visible"),
        F.avg(F.when(F.col("rank") <= 10, F.col(p))).alias("mean"),
        F.stddev_pop(F.when(F.col("rank") <= 10, F.col(p))).alias("spread"),
        F.max(most if isinstance(most, str) else F.lit(most)).alias("most"),
        F.max(must_have if must_have else F.lit(None).cast("int")).alias("must"),
    )
    fewer = F.when(F.col("must") > 3, 0.7).when(F.col("must") == 0, 1.3).otherwise(1.0)
    agg = agg.join(profile, agg[kind] == profile["query_type"], "left").select(agg["*"], F.greatest(F.lit(1.0), F.coalesce("prior", F.lit(4.0)) * fewer).alias("scope"), F.coalesce("least", F.lit(0.22)).alias("least"), F.coalesce("broad", F.lit(False)).alias("broad"))
    pool = F.greatest(F.lit(1.0), F.col("pool"))
    mixed = lambda a, b, c: a * F.col("scope") + b * pool + c * F.col("visible")
    fused = F.when((F.col("visible") < 3) & (F.col("scope") > 10), mixed(0.45, 0.35, 0.20)).when(F.col("visible") > 8, mixed(0.25, 0.25, 0.50)).otherwise(mixed(0.35, 0.35, 0.30))
    g = F.least(F.lit(60.0), F.greatest(F.lit(1.0), fused, 0.5 * F.col("scope")))
    alike = (F.col("n") >= 3) & (F.col("mean") < 0.35) & (F.col("spread") < 0.05)
    top = F.least(F.col("n"), F.col("most"), F.when(alike, F.when(F.col("broad"), 10).otherwise(5)))
    rows = ranked.select(by, "rank", p).join(agg.select(by, g.alias("g_hat"), "least", top.alias("top")), by)
    prefix = Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    rows = rows.withColumn("f1", F.round(2 * F.sum(p).over(prefix) / (F.col("rank") + F.col("g_hat")), 4))
    stop = F.min(F.when((F.col("rank") >= 2) & (F.col(p) < F.col("least")), F.col("rank") - 1)).over(whole)
    rows = rows.withColumn("cap", F.least(F.col("top"), F.coalesce(stop, F.col("top")))).filter(F.col("rank") <= F.col("cap"))
    rows = rows.withColumn("best", F.max("f1").over(whole)).filter(F.round(F.col("best") - F.col("f1"), 6) <= slack)
    return rows.groupBy(by).agg(F.round(F.max("g_hat"), 4).alias("g_hat"), F.max("rank").alias("k"), F.max("best").alias("best"))


# Words by which a request of unknown type tells its type; the first that fits counts.
TYPE_WORDS = (
    ("survey", ("survey", "review", "综述")), ("method_comparison", ("comparison", "compare", "对比", "比较")),
    ("dataset_constraint", ("dataset", "bench", "eval", "数据集")), ("latest_work", ("latest", "recent", "newest", "最新")),
)


def guessed_type(kind: Column, query: Column) -> Column:
    """A query type, read from the request's words where it is unknown or null."""
    low, found = F.lower(F.coalesce(query, F.lit(""))), F.lit("unknown")
    for name, words in reversed(TYPE_WORDS):
        for word in words:
            found = F.when(low.contains(word), name).otherwise(found)
    return F.when(F.coalesce(kind, F.lit("unknown")) == "unknown", found).otherwise(kind)


def dynamic_k(ranked: DataFrame, by: str, score: str, kind: str, cliff: float = 0.15, least_score: float = 0.40, fallback: int = 5, most: int = 20, hard: int = 12) -> DataFrame:
    """by, k by query type: 1, 2, 6 or 10, a cliff after the first for exact types, else the scores above least_score."""
    top = ranked.groupBy(by, kind).agg(
        F.count("*").alias("n"),
        F.max(F.when(F.col("rank") == 1, F.col(score))).alias("s1"),
        F.max(F.when(F.col("rank") == 2, F.col(score))).alias("s2"),
        F.count(F.when(F.col(score) >= least_score, 1)).alias("good"),
    )
    t, n = F.col(kind), F.col("n")
    exact = t.isin("exact_title", "single_gold", "specific_paper")
    k = (
        F.when(exact & (F.col("s1") - F.col("s2") >= cliff), 1)
        .when(t.isin("exact_title", "single_gold"), F.least(F.lit(1), n))
        .when(t == "specific_paper", F.least(F.lit(2), n))
        .when(t.isin("dataset_constraint", "method_comparison"), F.least(F.lit(6), n))
        .when(t.isin("survey", "broad_topic", "latest_work"), F.least(F.lit(10), n))
        .when(F.col("good") > 0, F.least(F.col("good"), F.lit(most)))
        .otherwise(F.least(F.lit(fallback), n))
    )
    return top.select(by, F.least(k, F.lit(hard)).cast("long").alias("k"))


def k_diagnosis(rows: DataFrame) -> DataFrame:
    """rows (oracle_k, dynamic_k, gap, g_hat, gold_count, uniform) with the kind of miss."""
    off = F.col("dynamic_k") - F.col("oracle_k")
    kind = (
        F.when((F.col("oracle_k") == 0) | (F.col("gold_count") == 0), "ranking_failure")
        .when((F.abs("gap") < 0.02) & (F.abs(off) <= 2), "good_match")
        .when(F.col("uniform") & (F.col("dynamic_k") > 5), "probability_calibration_failure")
        .when((F.col("g_hat") < F.col("gold_count") * 0.5) & (off < -2), "g_hat_underestimate_failure")
        .when(off < -2, "under_output")
        .when(off > 2, "over_output")
        .otherwise("good_match")
    )
    return rows.withColumn("diagnosis", kind)


def composed_k(ranked: DataFrame, by: str, score: str, p: str | None = None, kind: str = "query_type", most: int = 12, least: int = 1, floor: int = 5, recall_floor: int = 20, terms: str | None = None) -> DataFrame:
    """by, k as a synthesis step takes it: the score gap, else the percentile drop, bounds the results.

    With probabilities p of a model the controller may take fewer. Without, at least `floor` are taken, and for recall-first types
    with 50 results or more and two query terms (column terms) or more, recall_floor; at most `most` and what there is. The bound is
    written once (checkpoint), so that no task holds all steps at once.
    """
    gap = score_gap(ranked, by, score, 0.08, 0.10, most, 2).withColumnRenamed("k", "gap")
    drop = percentile_drop(ranked, by, score, most=most, least=least).withColumnRenamed("k", "drop")
    bound = gap.join(drop, by).select(by, F.least(F.coalesce("gap", "drop"), F.lit(most)).alias("bound")).checkpoint()
    if p is not None:
        chosen = expected_f1(ranked.join(bound, by), by, p, kind, most="bound").select(by, F.col("k").alias("chosen"))
        return bound.join(chosen, by, "left").select(by, F.greatest(F.lit(least), F.least(F.col("bound"), F.coalesce("chosen", "bound"))).cast("long").alias("k"))
    wide = ("unknown", "broad_topic", "survey", "latest_work", "dataset_constraint", "method_comparison")
    n = ranked.groupBy(by).agg(F.count("*").alias("n"), F.max(kind).alias("kind"), F.max(terms if terms else F.lit(0)).alias("terms"))
    recall = F.col("kind").isin(*wide) & (F.col("n") >= 50) & (F.col("terms") >= 2)
    low = F.when(recall, max(floor, min(most, recall_floor))).otherwise(floor)
    return bound.join(n, by).select(by, F.least(F.lit(most), F.col("n"), F.greatest("bound", low)).cast("long").alias("k"))


def tier_summary(tiered: DataFrame, by: str, p: str) -> DataFrame:
    """by, and per tier its size, and the mass of the high one, as a report shows them."""
    count = lambda t: F.count(F.when(F.col("tier") == t, 1)).alias(t)
    return tiered.groupBy(by).agg(count("high"), count("partial"), count("excluded"), F.round(F.sum(F.when(F.col("tier") == "high", F.col(p))), 6).alias("high_mass"))
