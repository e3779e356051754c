"""A search round looked at by rules: whether there are enough candidates, what is missing, and what the next round searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST_ROUND, ENOUGH, MANY, MOST_ASPECTS, MOST_SEEDS = 3, 20, 15, 5, 3
# What a review and the next round's searches say of themselves.
NOTHING_FOUND = "All aspects (0 papers found)"
NOTHING_REASON = "No papers found in the initial search. Must expand keywords."
ENOUGH_REASON = "已找到足够候选论文，或已达最大迭代轮数。"
FEW_REASON = "候选论文较少，建议继续检索。"
GOAL = "补充缺失主题与硬约束项"
ASPECT_REASON, KEYWORDS_REASON, TOPIC_REASON = "补充缺失方面: ", "基于审阅建议补充缺失的关键词", "基于研究主题补充检索"
REVIEW = "covered_aspects", "missing_aspects", "noise_patterns", "enough_candidates", "hard_constraint_coverage", "precision_risk", "recall_risk", "next_action", "suggested_new_keywords", "suggested_excluded_terms", "need_citation_expansion", "reason"


def _none() -> Column:
    return F.array().cast("array<string>")


def reviewed_round(rounds: DataFrame, papers: str = "papers", number: str = "round", topic: str = "topic") -> DataFrame:
    """rounds (a row per request: how many papers, the round's number, the topic) with the columns of REVIEW.

    A round without papers is never the last; the third one is.
    """
    n, last, empty = F.coalesce(papers, F.lit(0)), F.col(number) >= LAST_ROUND, F.coalesce(papers, F.lit(0)) == 0
    named = F.coalesce(topic, F.lit("")) != ""
    values = (
        F.when(named, F.array(topic)).otherwise(_none()),
        F.when(empty, F.array(F.lit(NOTHING_FOUND))).otherwise(_none()),
        _none(),
        n >= ENOUGH,
        F.when(n >= MANY, "high").otherwise("medium"),
        F.lit("low"),
        F.when(n >= ENOUGH, "low").otherwise("medium"),
        F.when(last & ~empty, "stop_search").otherwise("continue_search"),
        _none(),
        _none(),
        (n > 0) & (n < MANY),
        F.when(empty, NOTHING_REASON).when(n >= ENOUGH, ENOUGH_REASON).otherwise(FEW_REASON),
    )
    return rounds.withColumns(dict(zip(REVIEW, values, strict=True)))


def next_round(reviews: DataFrame, number: str = "round", topic: str = "topic", candidates: str = "candidates") -> DataFrame:
    """reviews with next_round, goal, searches (query, reason), seeds, negative_filters and stop: a search per missing aspect, else one
    of the suggested keywords, else the topic. candidates: paper ids, best first."""
    missing, keywords = F.coalesce("missing_aspects", _none()), F.coalesce("suggested_new_keywords", _none())
    search = lambda text, reason: F.struct(text.alias("query"), reason.alias("reason"))
    per_aspect = F.transform(F.slice(missing, 1, MOST_ASPECTS), lambda a: search(a, F.concat(F.lit(ASPECT_REASON), a)))
    searches = F.when(F.size(missing) > 0, per_aspect).when(F.size(keywords) > 0, F.array(search(F.array_join(keywords, " "), F.lit(KEYWORDS_REASON))))
    searches = searches.when(F.coalesce(topic, F.lit("")) != "", F.array(search(F.col(topic), F.lit(TOPIC_REASON)))).otherwise(F.array().cast("array<struct<query:string,reason:string>>"))
    return reviews.withColumns({
        "next_round": F.col(number) + 1, "goal": F.lit(GOAL), "searches": searches, "seeds": F.slice(F.coalesce(candidates, _none()), 1, MOST_SEEDS),
        "negative_filters": F.coalesce("suggested_excluded_terms", _none()), "stop": F.lit(False),
    })


def new_searches(planned: DataFrame, by: str) -> DataFrame:
    """by, place, search, reason: the next round's searches, one a row."""
    return planned.select(by, F.posexplode("searches").alias("place", "s")).select(by, "place", F.col("s.query").alias("search"), "s.reason")
