"""Benchmark cases from JSON lines, JSON with a wrapper, CSV and TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import gold_titles

# Names under which files give a question, its answers, and a wrapped list of cases.
QUESTION = ("query", "question", "prompt")
ANSWER = ("gold", "gold_titles", "references", "answer", "answers", "expected")
WRAPPERS = ("cases", "data", "examples", "items", "queries")


def _first(record: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.get_json_object(record, f"$.{n}") for n in names])


def _cases(records: DataFrame) -> DataFrame:
    """case_index, question, gold from records (line, record: JSON text)."""
    paired = F.from_json(F.get_json_object("record", "$.answer_arxiv_id"), "array<string>")
    rows = records.filter("trim(record) <> ''").select("line", _first(F.col("record"), QUESTION).alias("question"), gold_titles(_first(F.col("record"), ANSWER)).alias("gold"), paired.alias("gold_ids"), F.get_json_object("record", "$.source_meta.published_time").alias("published"))
    return rows.filter("question IS NOT NULL").withColumnRenamed("line", "case_index")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_index, question, gold (titles), gold_ids, published. The format follows the ending, else the first character."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("jsonl", "json", "csv", "tsv"):
        head = (spark.read.text(path).limit(1).first() or [""])[0].lstrip("﻿ \t")
        kind = "jsonl" if head.startswith("{") else "json" if head.startswith("[") else "tsv" if "\t" in head else "csv"
    if kind == "jsonl":
        text = spark.read.text(path).select((F.monotonically_increasing_id()).alias("line"), F.regexp_replace("value", "^﻿", "").alias("record"))
        return _cases(text)
    if kind == "json":
        whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
        listed = F.coalesce(F.from_json("v", "array<string>"), *[F.from_json(F.get_json_object("v", f"$.{w}"), "array<string>") for w in WRAPPERS], F.array("v"))
        return _cases(whole.select(F.posexplode(listed).alias("line", "record")))
    rows = spark.read.option("header", "true").option("multiLine", "true").option("sep", "\t" if kind == "tsv" else ",").csv(path)
    return _cases(rows.select(F.monotonically_increasing_id().alias("line"), F.to_json(F.struct("*")).alias("record")))


def by_gold_count(cases: DataFrame, low: int = 2, high: int = 8) -> DataFrame:
    return cases.filter(F.size("gold").between(low, high))


def paired_cases(records: DataFrame, record: str = "value") -> DataFrame:
    """name, question, gold (array of title, arxiv_id) of JSON records whose answers and ids are lists side by side.

    The n-th title takes the n-th id, if there is one and it is not empty; answers that are objects keep their own. Names count
    the records that have none. Null names of lists: answer or answers, answer_arxiv_id or answer_arxiv_ids; empty lists count as absent.
    """
    r, at = F.col(record), lambda f: F.get_json_object(F.col(record), f"$.{f}")
    own = lambda a, f: F.when(a.startswith("{"), F.get_json_object(a, f"$.{f}"))
    names = ("answer", "answers", "answer_arxiv_id", "answer_arxiv_ids")
    listed = lambda *of: F.coalesce(*[F.when(F.size(f"_{n}") > 0, F.col(f"_{n}")) for n in of], F.array().cast("array<string>"))
    pair = lambda a, i: F.struct(F.when(a.startswith("{"), own(a, "title")).otherwise(a).alias("title"), F.when(a.startswith("{"), own(a, "arxiv_id")).otherwise(F.nullif(i, F.lit(""))).alias("arxiv_id"))
    rows = records.filter(F.trim(r) != "").withColumn("_line", F.monotonically_increasing_id())
    rows = rows.withColumns({f"_{n}": F.from_json(at(n), "array<string>") for n in names})  # each list is read once, not once an answer
    rows = rows.withColumns({"_a": listed(*names[:2]), "_i": listed(*names[2:])})
    beside = F.slice(F.arrays_zip("_a", "_i"), F.lit(1), F.size("_a"))
    question = F.coalesce(F.nullif(at("question"), F.lit("")), F.nullif(at("query"), F.lit("")), F.lit(""))
    return rows.select(F.coalesce(F.nullif(at("qid"), F.lit("")), F.concat(F.lit("case-"), F.col("_line") + 1)).alias("name"), question.alias("question"), F.transform(beside, lambda x: pair(x["_a"], x["_i"])).alias("gold"))
