"""Search terms from what a first search found: runs of one to three words, counted, and the new searches made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.search import ranked

# Words that are no terms.
STOPWORDS = (
    "the", "a", "an", "of", "and", "in", "to", "for", "with", "on", "at", "by", "from", "that", "this", "these", "those", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can", "shall", "or", "but", "not", "no", "nor", "so", "yet", "if", "then", "than", "too", "very",
    "just", "also", "only", "up", "out", "about", "into", "over", "after", "before", "between", "under", "through", "during", "above", "below", "off", "down", "more", "most", "some", "such",
    "each", "other", "its", "our", "your", "their", "we", "they", "it", "he", "she", "his", "her", "as", "which", "who", "whom", "whose", "when", "where", "why", "how", "all", "both", "few",
    "many", "any", "paper", "study", "based", "using", "via", "method", "approach", "model", "result", "show", "propose", "present", "introduce", "demonstrate", "achieve", "et", "al", "fig",
    "table", "section", "eq", "ref",
)


def term_words(text: Column) -> Column:
    """The words of three letters and more that may be terms, in order."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-zA-Z][a-zA-Z0-9\-]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))


def candidate_terms(candidates: DataFrame, by: str, text: str, first: int = 50, most: int = 15) -> DataFrame:
    """by, term, weight, rank: the terms of a query's first candidates (by, rank, text) that occur twice or more, at most `most`.

    Occurrences count, and count double for terms of two words or three. Ties go to the term that is seen first: by candidate, then shorter
    terms, then place.
    """
    w = candidates.filter(F.col("rank") <= first).select(by, "rank", term_words(F.col(text)).alias("w"))
    made = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), i.alias("i"), F.array_join(F.slice("w", i, n), " ").alias("term"))))
    runs = reduce(DataFrame.unionByName, [w.select(by, "rank", F.explode(made(n)).alias("t")) for n in (1, 2, 3)])
    counted = runs.groupBy(by, F.col("t.term").alias("term"), F.col("t.n").alias("n")).agg(F.count("*").alias("c"), F.min(F.struct("rank", "t.n", "t.i")).alias("_first")).filter("c >= 2")
    weighed = counted.withColumn("weight", F.when(F.col("n") > 1, F.col("c") * 2).otherwise(F.col("c")))
    return ranked(weighed, [by], [F.desc("weight"), "_first"], most).select(by, "term", "weight", "rank")


def feedback_queries(searches: DataFrame, terms: DataFrame, topics: DataFrame, by: str, most: int = 3) -> DataFrame:
    """by, search, route, intent, priority, optional: the first terms (by, term, rank) with a word that no search so far has, behind the topic.

    searches (by, search, required, optional), topics (by, topic; may be null or empty).
    """
    words = F.regexp_extract_all(F.lower("search"), F.lit("[a-zA-Z]{3,}"), F.lit(0))
    none = F.array().cast("array<string>")
    listed = F.transform(F.concat(F.coalesce("required", none), F.coalesce("optional", none)), lambda t: F.lower(t))
    known = searches.groupBy(by).agg(F.array_distinct(F.flatten(F.collect_list(F.concat(words, listed)))).alias("known"))
    new = terms.join(known, by).filter(F.size(F.array_except(F.split(F.lower("term"), " "), F.col("known"))) > 0)
    chosen = ranked(new.withColumnRenamed("rank", "_rank"), [by], ["_rank"], most, "nth").join(topics, by, "left")
    search = F.concat_ws(" ", F.nullif("topic", F.lit("")), "term")
    return chosen.select(by, search.alias("search"), F.lit("feedback_expansion").alias("route"), F.concat(F.lit("feedback-based expansion: "), "term").alias("intent"), F.lit(2).alias("priority"), F.array("term").alias("optional"), "nth")
