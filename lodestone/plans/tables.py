"""Access to the test tables and the views that several queries share."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.containment import contained
from lodestone.operators.search import ranked


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with the number of order lines that cite them (0 if none) and the last ship year (null if none)."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("citations"), F.year(F.max("l_shipdate")).alias("year"))
    return table(spark, sf_dir, "part").join(lines, "p_partkey", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))


PART_STATS_SQL = """part_stats AS (SELECT p.*, coalesce(n, 0) AS citations, y AS year FROM part p LEFT JOIN
  (SELECT l_partkey, count(*) AS n, year(max(l_shipdate)) AS y FROM lineitem GROUP BY 1) l ON l.l_partkey = p.p_partkey)"""


ROWS_A_TASK = 250_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by their keys, over tasks in number with the rows, so that a task's share stays the same when a table grows."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows.count() / ROWS_A_TASK))
    return rows.repartition(tasks, *keys)


def customer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked score lists: per customer with four orders or more, each order's price over the customer's highest."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").filter("o_custkey IS NOT NULL")
    own = Window.partitionBy("o_custkey")
    rows = dealt(o, "o_custkey").withColumns({"top": F.max("o_totalprice").over(own), "n": F.count("*").over(own)}).filter("n >= 4")
    rows = rows.withColumn("score", F.round(F.col("o_totalprice") / F.col("top"), 6))
    return ranked(rows, ["o_custkey"], [F.desc("score"), "o_orderkey"]).select("o_custkey", "o_orderkey", "score", "rank")


CUSTOMER_SCORES_SQL = """tops AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1 HAVING count(*) >= 4),
scores AS (SELECT o_custkey, o_orderkey, round(o_totalprice / top, 6) AS score,
  row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / top, 6) DESC, o_orderkey) AS rank FROM orders JOIN tops USING (o_custkey))"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold pairs (item_id, doc_id): documents that hold a benchmark passage, found in one pass over the texts."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    return contained(table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "passage")


PASSAGES_SQL = "gold AS (SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND b.text <> '')"
