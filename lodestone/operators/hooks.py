"""Steps that a model may take, with deterministic fallbacks: scorers are plugged in as functions DataFrame -> DataFrame.

A scorer gets candidates and returns (query_id, paper_id, score, probability, level, confidence) for those it judged; the rest keep
their fallback. Without a scorer everything is the fallback, so results are the same on every run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scoring import level_of_score
from lodestone.functions.text import unit_score

Scorer = Callable[[DataFrame], DataFrame]
JUDGED = "array<struct<paper_id:string,relevance_score:string,relevance_probability:string,relevance_level:string,confidence:string>>"
DEFAULTS = {"high": (0.90, 0.75, 0.70), "medium": (0.55, 0.45, 0.45), "low": (0.20, 0.20, 0.15)}  # relevance, constraints, evidence


def default_score(level: Column, place: int = 0) -> Column:
    """The number that stands for a level where a model gave none."""
    return F.coalesce(*[F.when(level == k, F.lit(v[place])) for k, v in DEFAULTS.items()], F.lit(0.0))


def judged(answers: DataFrame, by: str, answer: str) -> DataFrame:
    """by, paper_id, score, probability, level, confidence from model answers (JSON text with a list under results); clamped to 0..1."""
    listed = F.coalesce(F.from_json(F.get_json_object(answer, "$.results"), JUDGED), F.from_json(answer, JUDGED))
    r = answers.select(by, F.explode(listed).alias("r")).filter("r.paper_id IS NOT NULL")
    level = F.when(F.col("r.relevance_level").isin("high", "medium", "low", "irrelevant"), F.col("r.relevance_level")).otherwise("low")
    return r.select(by, F.col("r.paper_id").alias("paper_id"), unit_score(F.col("r.relevance_score")).alias("score"), unit_score(F.col("r.relevance_probability")).alias("probability"), level.alias("level"), unit_score(F.col("r.confidence"), 0.5).alias("confidence"))


def reviewed(candidates: DataFrame, by: str, local: str, scorer: Scorer | None = None) -> DataFrame:
    """candidates with score, probability, level and confidence: the scorer's where it judged, else from the local score."""
    fallback = {"level": level_of_score(F.col(local)), "score": F.col(local), "probability": F.col(local), "confidence": F.lit(0.5)}
    if scorer is None:
        return candidates.withColumns(fallback)
    names = list(fallback)
    found = scorer(candidates).select(by, "paper_id", *[F.col(n).alias(f"_{n}") for n in names])
    joined = candidates.join(found, [by, "paper_id"], "left")
    return joined.withColumns({n: F.coalesce(F.col(f"_{n}"), fallback[n]) for n in names}).drop(*[f"_{n}" for n in names])


def merged_passes(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A second pass over the first: its values win where it has any."""
    again = second.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    joined = first.join(again, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"_{v}", v).alias(v) for v in values])
