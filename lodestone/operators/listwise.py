"""Ranking of a request's candidates as one list by a model, in attempts that ask for less each time, and texts for vector search.

Candidates have by, paper_id, title, abstract and a score to list them by. The model is plugged in as in models.py. Answers are written
to the shared folder of spark.checkpoint.dir, so that no call is made again when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import unit_score
from lodestone.operators.models import SECONDS, TRIES, Client, completed
from lodestone.operators.search import ranked

ROWS_A_TASK = 250_000
ATTEMPTS = ((40, 300), (20, 300), (20, 0))  # how many papers, and how many letters of their abstracts
LEVELS = ("high", "medium", "low", "irrelevant")
RANKED = "array<struct<paper_id:string,listwise_score:string,relevance_probability:string,relevance_level:string,confidence:string,matched_aspects:array<string>,should_include:string>>"


def listed(answers: DataFrame, asked: DataFrame, by: str, answer: str = "answer") -> DataFrame:
    """by, paper_id, listwise, probability, level, confidence, aspects, include from answers (JSON text with ranked_papers).

    Only papers that were asked for (by, paper_id) count; of a paper's entries the last one does. Numbers are clamped to 0..1; a missing or
    unreadable score is 0, a missing probability 0, a missing confidence 0.5; unreadable ones are null.
    """
    rows = answers.select(by, F.posexplode(F.from_json(F.get_json_object(answer, "$.ranked_papers"), RANKED)).alias("place", "r")).select(by, "place", "r.*")
    last = rows.filter("paper_id IS NOT NULL").groupBy(by, "paper_id").agg(F.max_by(F.struct(*rows.columns[3:]), "place").alias("r"))
    known = last.join(asked.select(by, "paper_id").distinct(), [by, "paper_id"]).select(by, "paper_id", "r.*")
    readable = lambda c, missing: F.when(c.isNull(), F.lit(missing)).when(c.try_cast("double").isNotNull(), unit_score(c))
    return known.select(
        by, "paper_id", unit_score(F.col("listwise_score")).alias("listwise"), readable(F.col("relevance_probability"), 0.0).alias("probability"),
        F.when(F.col("relevance_level").isin(*LEVELS), F.col("relevance_level")).alias("level"), readable(F.col("confidence"), 0.5).alias("confidence"),
        F.coalesce("matched_aspects", F.array().cast("array<string>")).alias("aspects"), F.col("should_include").try_cast("boolean").alias("include"),
    )


def wanted_sizes(answers: DataFrame, by: str, answer: str = "answer") -> DataFrame:
    """by, k, least, most, reason: how many results an answer wants; 10, 1 and 20 where it does not say, all within 1..50."""
    number = lambda name, missing: F.coalesce(F.get_json_object(answer, f"$.{name}").try_cast("double").cast("int"), F.lit(missing))
    within = lambda c, low: F.greatest(low, F.least(F.lit(50), c))
    rows = answers.withColumn("least", within(number("recommended_k_min", 1), F.lit(1)))
    return rows.select(by, within(number("recommended_k", 10), F.lit(1)).alias("k"), "least", within(number("recommended_k_max", 20), F.col("least")).alias("most"), F.coalesce(F.get_json_object(answer, "$.overall_reason"), F.lit("")).alias("reason"))


def list_prompt(candidates: DataFrame, by: str, letters: int, features: Sequence[str] = ()) -> DataFrame:
    """by, prompt: a request's papers in the order of `nth` as JSON lines; without abstracts (letters 0) they show the given features."""
    shown = [F.substring("abstract", 1, letters).alias("abstract")] if letters else [F.col(f) for f in features]
    line = F.to_json(F.struct("paper_id", "title", *shown))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"])
    task = 'Rank these papers for the request. Answer in JSON: {"ranked_papers": [{"paper_id", "listwise_score", "relevance_probability", "relevance_level", "confidence", "matched_aspects", "should_include"}], "recommended_k", "recommended_k_min", "recommended_k_max", "overall_reason"}.'
    return candidates.groupBy(by).agg(F.concat_ws("\n", F.lit(task), F.concat(F.lit("Request: "), F.coalesce(F.max("query"), F.lit(""))), F.array_join(lines, "\n")).alias("prompt"))


def ranked_lists(candidates: DataFrame, by: str, score: str, make_client: Callable[[], Client], attempts: Sequence[tuple[int, int]] = ATTEMPTS, features: Sequence[str] = (), tries: int = TRIES, seconds: float = SECONDS) -> tuple[DataFrame, DataFrame]:
    """(papers as of listed() with `attempt`, sizes as of wanted_sizes()) of the requests that got a list.

    candidates: by, paper_id, query, title, abstract, score, features. An attempt holds when it scores half of its papers or more (one at
    least); requests without such an answer are asked again for fewer papers, then for titles only. Requests that never got one are
    left out, and fall back to their local scores. Each step is written once (checkpoint), as one plan over all attempts would hold the
    joins of each attempt several times, and every join takes memory of its task.
    """
    placed = ranked(candidates, [by], [F.desc_nulls_last(score), "paper_id"], max(n for n, _ in attempts), "nth")
    left, papers, sizes = placed.checkpoint(), None, None
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(left.count() / ROWS_A_TASK))
    for attempt, (n, letters) in enumerate(attempts, 1):
        asked = left.repartition(tasks, by).filter(F.col("nth") <= n)
        answers = completed(list_prompt(asked, by, letters, features), by, "prompt", make_client, tries, seconds).checkpoint()
        found = listed(answers, asked, by).checkpoint()
        share = asked.groupBy(by).agg(F.greatest(F.lit(1), F.floor(F.count("*") / 2)).alias("least_scored"))
        held = found.groupBy(by).agg(F.count("*").alias("scored")).join(share, by).filter("scored >= least_scored").select(by).checkpoint()
        part = found.join(held, by, "left_semi").withColumn("attempt", F.lit(attempt))
        size = wanted_sizes(answers.join(held, by, "left_semi"), by)
        papers, sizes = (part, size) if papers is None else (papers.unionByName(part), sizes.unionByName(size))
        left = left.join(held, by, "left_anti").checkpoint()
    return papers, sizes


def _first_five(c: Column) -> Column:
    return F.array_join(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 5), ", ")


def imagined_abstracts(plans: DataFrame, by: str, make_client: Callable[[], Client], tries: int = TRIES, seconds: float = SECONDS) -> DataFrame:
    """by, search: the abstract that a model imagines a fitting paper to have, as a text for vector search; requests without one are left out.

    plans: by, query, topic, methods, entities.
    """
    told = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    task = F.lit('Write the abstract, three or four sentences in the terms of its field, of a paper that answers this question. Answer in JSON: {"hypothetical_abstract": "..."}.')
    prompt = F.concat_ws("\n", task, told("Question", F.col("query")), told("Topic", F.col("topic")), told("Methods", _first_five(F.col("methods"))), told("Entities", _first_five(F.col("entities"))))
    answers = completed(plans.select(by, prompt.alias("prompt")), by, "prompt", make_client, tries, seconds)
    return answers.select(by, F.get_json_object("answer", "$.hypothetical_abstract").alias("search")).filter("search <> ''")
