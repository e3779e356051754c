"""Roll-ups of run, cost and health logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Component of a model call, and words of its prompts by which it is known; the first that fits counts.
PROMPT_COMPONENTS = (
    ("synthesis", ("highly_relevant_papers", "structuredsynthesis")),
    ("evidence_selector", ("relevance_level", "evidence")),
    ("result_review", ("coverage_analysis", "resultreview")),
    ("search_planning", ("subqueries", "search_goal", "round")),
    ("query_understanding", ("queryplan",)),
)
RETRIEVAL = "retrieval."  # fixed value: how names of retrieval components begin
STAGE_WORDS = (("retrieval", ()), ("evidence", ("evidence", "rerank", "batch")), ("synthesis", ("synthesis", "llm_pool")))  # fixed values
REVIEW_WORD = "审阅"  # fixed value: in a user prompt it marks a review too


def cost(events: DataFrame, by: Sequence[str], value: str, failed: Column) -> DataFrame:
    """Calls, value and failures per group, with sub-totals and the total (null keys); partial sums come before the shuffle."""
    return events.rollup(*by).agg(F.count("*").alias("calls"), F.round(F.sum(value), 4).alias("elapsed"), F.count(F.when(failed, 1)).alias("failures"))


def by_provider(components: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    """kind (retrieval or component), name, values summed: retrieval.<provider>.<route> goes to its provider, other components stand alone.

    A name that ends after the dot has an empty provider; "retrieval" without a dot is a component.
    """
    part = F.col(name).startswith(RETRIEVAL)
    named = components.select(F.when(part, "retrieval").otherwise("component").alias("kind"), F.when(part, F.split_part(F.col(name), F.lit("."), F.lit(2))).otherwise(F.col(name)).alias("name"), *values)
    return named.groupBy("kind", "name").agg(*[F.sum(v).alias(v) for v in values])


def latest(events: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Per key: the first time, the last time and the last value, as an upsert log is read back."""
    last = F.max(F.struct(*order, value)).alias("last")
    return events.groupBy(key).agg(F.min(order[0]).alias("started_at"), last, F.count("*").alias("updates")).select(key, "started_at", F.col("last")[order[0]].alias("updated_at"), F.col("last")[value].alias("status"), "updates")


def stages(components: DataFrame, name: str) -> DataFrame:
    """components with stage; a name may be of several stages and then gives a row for each, else `other`."""
    low = F.lower(F.col(name))
    has = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    met = [(stage, low.startswith(RETRIEVAL) if stage == "retrieval" else has(words)) for stage, words in STAGE_WORDS]
    found = F.array_compact(F.array(*[F.when(m, stage) for stage, m in met]))
    return components.withColumn("stage", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))))


def prompt_component(system: Column, user: Column) -> Column:
    """The component that a model call is charged to, by the words of its prompts."""
    low = F.lower(F.concat_ws("\n", F.coalesce(system, F.lit("")), F.coalesce(user, F.lit(""))))
    named = F.lit("other_llm_task")
    for component, words in reversed(PROMPT_COMPONENTS):
        met = reduce(lambda a, b: a | b, [low.contains(w) for w in words])
        if component == "result_review":
            met = met | F.coalesce(user.contains(REVIEW_WORD), F.lit(False))
        named = F.when(met, component).otherwise(named)
    return named


def model_calls(calls: DataFrame, model: str, elapsed: str, tokens: str, system: str, user: str) -> DataFrame:
    """model, component, calls, tokens, elapsed of model calls, with sub-totals per model and the total (null keys)."""
    marked = calls.withColumn("component", prompt_component(F.col(system), F.col(user)))
    return marked.rollup(model, "component").agg(F.count("*").alias("calls"), F.sum(F.coalesce(tokens, F.lit(0))).alias("tokens"), F.round(F.sum(elapsed), 4).alias("elapsed"))


def block_counters(events: DataFrame, by: str, order: Sequence[str], limited: Column, failed: Column, most_limited: int = 3, most_failed: int = 5) -> DataFrame:
    """events with running counts of rate limits and errors, and whether the provider is blocked by then."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumns({"limits": F.count(F.when(limited, 1)).over(w), "errors": F.count(F.when(failed, 1)).over(w)})
    return counted.withColumn("blocked", (F.col("limits") >= most_limited) | (F.col("errors") >= most_failed))


def reserved(events: DataFrame, by: str, order: Sequence[str], amount: str, budget: float) -> DataFrame:
    """events with the running use of a budget and whether it still allows the event."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = events.withColumn("used", F.sum(amount).over(w))
    return used.withColumn("allowed", F.col("used") <= budget)


def progress(stage_start: Column, stage_end: Column, elapsed: Column, expected: Column, before: Column) -> Column:
    """Percent done: linear within a stage, never back, at most 98."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), elapsed / expected))
    return F.least(F.lit(98), F.greatest(before, F.round(stage_start + (stage_end - stage_start) * share).cast("int")))
