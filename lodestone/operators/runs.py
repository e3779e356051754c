"""Batches of benchmark cases: seeded choice, terminal states, averages over runs, comparison with a baseline."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable, Hashable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DONE = ("succeeded", "failed", "timed_out", "cancelled")


def chosen_cases(cases: DataFrame, index: str, n: int, seed: int) -> DataFrame:
    """Exactly n cases (all, if fewer), chosen with a seed from the case numbers; benchmarks have thousands of cases at most."""
    numbers = sorted(r[0] for r in cases.select(index).distinct().collect())
    picked = sorted(random.Random(seed).sample(numbers, min(n, len(numbers))))
    return cases.filter(F.col(index).isin(picked))


@dataclass(frozen=True)
class Outcome:
    case: Hashable
    state: str  # one of DONE
    elapsed: float
    error: str | None = None
    value: Any = None


def run_cases(spark: SparkSession, cases: Sequence[Hashable], run: Callable[[Hashable], Any], seconds: float, workers: int = 4, should_stop: Callable[[], bool] | None = None, on_result: Callable[[Outcome], None] | None = None) -> list[Outcome]:
    """The outcomes of run(case), in the order of cases (thousands at most); run starts Spark jobs and returns what is small.

    A case's jobs have a tag of their own, by which they are ended when its time is over or when should_stop says so; then cases that have
    not begun are cancelled too. Work of run that is no Spark job is not broken off, but counts as timed out. on_result gets each
    outcome as it comes, one at a time.
    """
    if seconds <= 0 or workers <= 0:
        raise ValueError("seconds and workers must be above 0")
    context, stopped, over, one = spark.sparkContext, threading.Event(), threading.Event(), threading.Lock()
    running: set[str] = set()

    def end(tag: str) -> None:
        context.cancelJobsWithTag(tag)

    def told(out: Outcome) -> Outcome:
        if on_result:
            with one:
                on_result(out)
        return out

    def one_case(case: Hashable) -> Outcome:
        if stopped.is_set():
            return told(Outcome(case, "cancelled", 0.0, "stopped"))
        tag, began = f"case-{uuid.uuid4().hex}", time.monotonic()
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        running.add(tag)
        timer = threading.Timer(seconds, end, (tag,))
        timer.start()
        value = error = None
        try:
            value = run(case)
        except Exception as e:  # noqa: BLE001 - a case may fail in any way; its outcome says how
            error = f"{type(e).__name__}: {e}"
        finally:
            timer.cancel()
            running.discard(tag)
            context.removeJobTag(tag)
        elapsed = time.monotonic() - began
        if elapsed > seconds:
            return told(Outcome(case, "timed_out", elapsed, f"took longer than {seconds} s"))
        if error:
            return told(Outcome(case, "cancelled", elapsed, "stopped") if stopped.is_set() else Outcome(case, "failed", elapsed, error))
        return told(Outcome(case, "succeeded", elapsed, None, value))

    def watch() -> None:
        while should_stop and not over.wait(0.05):
            if should_stop():
                stopped.set()
                for tag in list(running):
                    end(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        with ThreadPoolExecutor(workers) as pool:
            return list(pool.map(one_case, cases))
    finally:
        over.set()
        watcher.join()


def outcomes(cases: DataFrame, results: DataFrame, index: str, budget: float) -> DataFrame:
    """One row a case in the order of cases: results (index, elapsed, error) as a terminal state; cases without a result were cancelled."""
    joined = cases.select(index).join(results, index, "left")
    state = F.when(F.col("elapsed").isNull(), "cancelled").when(F.col("elapsed") > budget, "timed_out").when(F.col("error").isNotNull(), "failed").otherwise("succeeded")
    return joined.withColumn("state", state)


def run_means(metrics: DataFrame, run: str, values: Sequence[str], count_failed: bool = True, failed: Column | None = None) -> DataFrame:
    """The mean over runs of each run's mean, to 4 places. Failed cases count as zeros, or not at all."""
    bad = F.lit(False) if failed is None else failed
    value = lambda v: F.when(bad, F.lit(0.0) if count_failed else F.lit(None)).otherwise(F.coalesce(v, F.lit(0.0)))
    per = metrics.groupBy(run).agg(*[F.avg(value(F.col(v))).alias(v) for v in values])
    return per.agg(F.count("*").alias("runs"), *[F.round(F.avg(v), 4).alias(v) for v in values])


def against(results: DataFrame, baseline: dict[str, float]) -> DataFrame:
    """metric, value, base, delta, better for a row of results; times are better when lower."""
    rows = [F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(float(v)).alias("base")) for k, v in baseline.items()]
    out = results.select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("delta", F.round(F.col("value") - F.col("base"), 4))
    lower = F.col("metric").contains("time") | F.col("metric").contains("error")
    return out.withColumn("better", F.when(lower, F.col("delta") < 0).otherwise(F.col("delta") > 0))


def split_gain(cases: DataFrame, gold: str, hit: str) -> DataFrame:
    """Hit rates of cases with one gold item and with several."""
    return cases.groupBy(F.when(F.col(gold) == 1, "single").otherwise("multiple").alias("kind")).agg(F.count("*").alias("cases"), F.round(F.avg(hit), 4).alias("hit_rate"))
