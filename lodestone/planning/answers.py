"""Plans, titles and terms out of a model's answers: JSON of any shape brought to columns, with the rule-based plan behind it."""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.search import ranked

# The fields of a plan that are lists, and the query types.
LIST_FIELDS = ("methods", "datasets", "entities", "venues", "must_have_constraints", "nice_to_have_constraints", "exclude_terms", "uncertainty")
QUERY_TYPES = ("exact_title", "single_gold", "specific_paper", "dataset_constraint", "method_comparison", "latest_work", "broad_topic", "survey", "unknown")
TITLE_QUERIES = {"field": "title_queries", "route": "title_like", "intent": "llm_title_candidate_recall", "priority": 8, "most": 10, "words": 3, "letters": 180}
TERM_QUERIES = {"field": "term_queries", "route": "broad_synonym", "intent": "llm_term_mapping", "priority": 6, "most": 15, "words": 2, "letters": 120}
CHINESE = "[\\u4e00-\\u9fff]"
TEXTS = "array<string>"
ANSWERS_A_TASK = 20_000


def _kind(value: Column) -> Column:
    """VOID (null or absent), STRING, BOOLEAN, a number's type, ARRAY<...> or OBJECT<...>."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _get(answer: Column, field: str) -> Column:
    return F.try_variant_get(answer, f"$.{field}", "variant")


def _text(value: Column) -> Column:
    """A string as it is, true and false as True and False, anything else as JSON."""
    kind = _kind(value)
    plain = F.try_variant_get(value, "$", "string")
    return F.when(kind == "BOOLEAN", F.initcap(plain)).when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(value)).otherwise(plain)


def coerced_list(value: Column) -> Column:
    """A field that should be a list of texts: none and "none" are empty, anything else that is no list is its only item."""
    kind, text = _kind(value), _text(value)
    empty = F.array().cast(TEXTS)
    blank = (kind == "STRING") & ((F.trim(text) == "") | (F.lower(text) == "none"))
    listed = F.try_variant_get(value, "$", TEXTS)
    return F.when((kind == "VOID") | blank, empty).when(kind.startswith("ARRAY"), F.coalesce(listed, empty)).otherwise(F.array(text))


def coerced_year(value: Column) -> Column:
    """A whole number, also out of a text of digits; numbers are cut, anything else is null."""
    kind, plain = _kind(value), F.try_variant_get(value, "$", "string")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL") | (kind == "STRING") & plain.rlike(r"^\s*[+-]?\d+\s*$")
    return F.when(number, F.try_to_number(F.regexp_replace(F.trim(plain), r"\..*$", ""), F.lit("S999999999")).cast("int"))


def plans_of_answers(answers: DataFrame, fallback: DataFrame, by: str, query: str, answer: str, previous: DataFrame | None = None) -> DataFrame:
    """by, language, query_type, research_topic, task, the LIST_FIELDS, start_year, end_year, from_model: a plan per query.

    answers (by, query, answer: JSON text); fallback and previous have the same plan columns. An answer that is no JSON object, names
    an unknown query type or has a list of other things than texts is not used: then the fallback's plan counts whole. Without
    a query type of its own an answer takes the previous plan's, or the fallback's. What the previous plan's lists have and the
    answer's lack is added behind, sorted; nothing is taken away. Fields that no plan has are empty lists or null.
    """
    parsed = answers.select(by, F.col(query).alias("_query"), F.try_parse_json(answer).alias("_a"))
    sets = {f: _get(F.col("_a"), f) for f in LIST_FIELDS}
    kind = _get(F.col("_a"), "query_type")
    type_text = F.nullif(F.nullif(F.try_variant_get(kind, "$", "string"), F.lit("")), F.lit("unknown"))
    all_texts = reduce(lambda a, b: a & b, [~_kind(v).startswith("ARRAY") | _kind(v).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(F.coalesce(coerced_list(v), F.array().cast(TEXTS)), lambda x: x.isNull()) for v in sets.values()])
    usable = _kind(F.col("_a")).startswith("OBJECT") & all_texts & (type_text.isNull() | type_text.isin(*QUERY_TYPES))
    said = F.lower(F.trim(F.try_variant_get(_get(F.col("_a"), "language"), "$", "string")))
    is_text = (_kind(_get(F.col("_a"), "language")) == "STRING") & (F.length(F.try_variant_get(_get(F.col("_a"), "language"), "$", "string")) > 0)
    by_query = F.when(F.col("_query").rlike(CHINESE), "zh").otherwise("en")
    language = F.when(is_text, F.when(said.contains("chinese") | said.contains("zh"), "zh").otherwise("en")).otherwise(by_query)
    plain = lambda f: F.try_variant_get(_get(F.col("_a"), f), "$", "string")
    mine = parsed.select(by, usable.alias("from_model"), language.alias("language"), type_text.alias("query_type"), plain("research_topic").alias("research_topic"), plain("task").alias("task"),
        coerced_year(_get(F.col("_a"), "time_range.start_year")).alias("start_year"), coerced_year(_get(F.col("_a"), "time_range.end_year")).alias("end_year"), *[coerced_list(v).alias(f) for f, v in sets.items()])

    def renamed(plans: DataFrame, mark: str) -> DataFrame:
        names = ("language", "query_type", "research_topic", "task", "start_year", "end_year", *LIST_FIELDS)
        none = lambda n: F.lit(None).cast(TEXTS if n in LIST_FIELDS else "int" if n.endswith("_year") else "string")
        return plans.select(F.col(by).alias(f"{mark}by"), *[(F.col(n) if n in plans.columns else none(n)).alias(mark + n) for n in names])

    rows = mine.join(renamed(fallback, "_f_"), F.col(by).eqNullSafe(F.col("_f_by")), "left")
    has_previous = previous is not None
    if has_previous:
        rows = rows.join(renamed(previous, "_p_"), F.col(by).eqNullSafe(F.col("_p_by")), "left")
    mine_or_fallback = lambda n: F.when(F.col("from_model"), F.col(n)).otherwise(F.col(f"_f_{n}"))

    def merged(n: str) -> Column:
        added = F.array_sort(F.array_except(F.coalesce(f"_p_{n}", F.array().cast(TEXTS)), n)) if has_previous else F.array().cast(TEXTS)
        own = F.when(F.col("_p_by").isNull(), F.col(n)).otherwise(F.array_distinct(F.concat(n, added))) if has_previous else F.col(n)
        return F.coalesce(F.when(F.col("from_model"), own).otherwise(F.col(f"_f_{n}")), F.array().cast(TEXTS)).alias(n)

    earlier = F.when(F.col("_p_by").isNull(), F.col("_f_query_type")).otherwise(F.col("_p_query_type")) if has_previous else F.col("_f_query_type")
    kind = F.when(F.col("from_model"), F.coalesce("query_type", earlier)).otherwise(F.col("_f_query_type"))
    return rows.select(by, "from_model", mine_or_fallback("language").alias("language"), F.coalesce(kind, F.lit("unknown")).alias("query_type"),
        *[mine_or_fallback(n).alias(n) for n in ("research_topic", "task", "start_year", "end_year")], *[merged(n) for n in LIST_FIELDS])


def fallback_titles(plan: DataFrame) -> Column:
    """Titles made of a plan where the model gives none: its first method with the topic (or first entity), two entities, topic and task, if they look like titles."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != "" if c in plan.columns else F.lit(False)
    texts = lambda c: F.coalesce(F.col(c), F.array().cast(TEXTS)) if c in plan.columns else F.array().cast(TEXTS)
    method, entity = F.get(texts("methods"), F.lit(0)), F.get(texts("entities"), F.lit(0))
    topic = F.col("research_topic") if "research_topic" in plan.columns else F.lit(None).cast("string")
    first = F.when(method.isNotNull(), F.when(has("research_topic"), F.concat(method, F.lit(": "), topic)).when(entity.isNotNull(), F.concat(method, F.lit(" "), entity)).otherwise(method))
    task = F.when(has("task"), F.col("task")) if "task" in plan.columns else F.lit(None).cast("string")
    every = F.concat(F.array(first), F.slice(texts("entities"), 1, 2), F.array(F.when(has("research_topic"), topic), task))
    return F.slice(F.filter(every, lambda t: t.isNotNull() & T.looks_like_title(t)), 1, 10)


def recalled_queries(plans: DataFrame, answers: DataFrame, by: str, answer: str, what: dict = TITLE_QUERIES) -> DataFrame:
    """by, rank, search, route, intent, priority, start_year, end_year of the titles (TITLE_QUERIES) or terms (TERM_QUERIES) of a model's answers.

    An answer is a list of texts or an object with one. The first `most` items count, those that are texts of enough words; titles
    must look like titles. Where an answer has no list, titles are made of the plan (fallback_titles) and terms are none. Plans without an answer get nothing.
    Answers are dealt over tasks in number with them, as a table of few bytes would otherwise be read by one task.
    """
    tasks = max(int(plans.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(answers.count() / ANSWERS_A_TASK))
    rows = plans.join(answers.select(F.col(by).alias("_by"), F.col(answer).alias("_answer")), F.col(by).eqNullSafe(F.col("_by"))).repartition(tasks, by).withColumn("_a", F.try_parse_json("_answer"))
    whole = _kind(F.col("_a"))
    listed = F.when(whole.startswith("OBJECT"), _get(F.col("_a"), what["field"])).otherwise(F.col("_a"))
    items = F.slice(F.try_variant_get(listed, "$", "array<variant>"), 1, what["most"])
    given = F.transform(F.filter(items, lambda v: _kind(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    is_title = what["field"] == TITLE_QUERIES["field"]
    behind = fallback_titles(plans) if is_title else F.array().cast(TEXTS)
    texts = F.when(_kind(listed).startswith("ARRAY"), F.coalesce(given, F.array().cast(TEXTS))).otherwise(behind)
    plain = F.transform(texts, lambda t: F.regexp_replace(F.trim(F.regexp_replace(t, r"\s+", " ")), r"\s+", " "))
    kept = F.filter(plain, lambda t: (F.size(F.filter(F.split(t, " "), lambda w: w != "")) >= what["words"]) & (T.looks_like_title(t) if is_title else F.lit(True)))
    years = [F.col(c) if c in plans.columns else F.lit(None).cast("int").alias(c) for c in ("start_year", "end_year")]
    out = rows.select(by, *years, F.posexplode(kept).alias("_place", "_t"))
    fixed = {"search": F.substring("_t", 1, what["letters"]), "route": F.lit(what["route"]), "intent": F.lit(what["intent"]), "priority": F.lit(what["priority"])}
    return ranked(out.withColumns(fixed), [by], ["_place"]).select(by, "rank", "search", "route", "intent", "priority", "start_year", "end_year")
