"""Papers from id-to-title JSON, section files and nested API records; read-through caches; a small fixture."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T

PAPER = "paper_id string, title string, abstract string, year int, venue string, authors array<string>, doi string, arxiv_id string, citation_count int, source string, retrieval_path array<string>"
WORK = "id string, display_name string, publication_year int, doi string, cited_by_count int, abstract_inverted_index map<string,array<int>>, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>"


def fixture(spark: SparkSession) -> DataFrame:
    """Five papers for tests and offline runs."""
    rows = [(f"paper-{k:03d}", f"Fixture paper number {k} on retrieval", None, 2020 + k, None, [], None, f"240{k}.0000{k}", 7 * k, "mock", []) for k in range(1, 6)]
    return spark.createDataFrame(rows, PAPER)


def titles(spark: SparkSession, path: str) -> DataFrame:
    """arxiv_id, title, title_key from one JSON object of id to title; titles without letters are left out, of equal keys the last in the file wins."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("place", "e"))
    keyed = whole.select("place", F.col("e.key").alias("arxiv_id"), F.col("e.value").alias("title")).withColumn("title_key", T.letters_key(F.col("title"))).filter("title_key <> ''")
    last = keyed.groupBy("title_key").agg(F.max(F.struct("place", "title", "arxiv_id")).alias("last"))
    return last.select("title_key", "last.title", "last.arxiv_id")


def references(spark: SparkSession, path: str) -> DataFrame:
    """title_key, position, reference of papers with sections of reference titles, distinct in order of appearance."""
    ddl = "title string, abstract string, sections map<string,array<string>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", ddl).alias("p")).filter("p.title IS NOT NULL")
    listed = F.array_distinct(F.flatten(F.map_values("p.sections")))
    return whole.select(T.letters_key(F.col("p.title")).alias("title_key"), F.posexplode(listed).alias("position", "reference"))


def from_works(records: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The columns keep and PAPER rows from nested works records (JSON text); the abstract is put together from its word positions."""
    w = records.select(*keep, F.from_json(column, WORK).alias("w")).filter("w.display_name IS NOT NULL")
    return w.select(
        *keep, F.col("w.id").alias("paper_id"), F.col("w.display_name").alias("title"), F.nullif(T.abstract_from_positions(F.col("w.abstract_inverted_index")), F.lit("")).alias("abstract"),
        F.col("w.publication_year").alias("year"), F.col("w.primary_location.source.display_name").alias("venue"), F.transform("w.authorships", lambda a: a["author"]["display_name"]).alias("authors"),
        T.identifier(F.col("w.doi")).alias("doi"), F.lit(None).cast("string").alias("arxiv_id"), F.col("w.cited_by_count").alias("citation_count"), F.lit("openalex").alias("source"), F.array().cast("array<string>").alias("retrieval_path"),
    )


SCHOLAR = "paperId string, title string, abstract string, year int, venue string, url string, citationCount int, authors array<struct<name:string>>, externalIds struct<DOI:string,ArXiv:string>"


def from_scholar(records: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The columns keep and PAPER rows from a citation service's records (JSON text): the id, else the URL, else the title names a paper."""
    p = records.select(*keep, F.from_json(column, SCHOLAR).alias("p")).filter("p IS NOT NULL")
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    names = F.transform(F.filter("p.authors", lambda a: F.coalesce(a["name"], F.lit("")) != ""), lambda a: a["name"])
    return p.select(
        *keep, F.coalesce(filled("p.paperId"), filled("p.url"), filled("p.title"), F.lit("")).alias("paper_id"), F.coalesce(filled("p.title"), F.lit("Untitled")).alias("title"), F.col("p.abstract").alias("abstract"),
        F.col("p.year").alias("year"), F.col("p.venue").alias("venue"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), F.col("p.externalIds.DOI").alias("doi"),
        F.col("p.externalIds.ArXiv").alias("arxiv_id"), F.col("p.citationCount").alias("citation_count"), F.lit("semantic_scholar").alias("source"), F.array().cast("array<string>").alias("retrieval_path"),
    )


MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def assembled_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd from a record's parts: month as a number or name, missing ones December and 31; null without a year of digits."""
    number = lambda c, other: F.lpad(F.coalesce(F.nullif(c, F.lit("")), F.lit(other)).try_cast("int").cast("string"), 2, "0")
    named = F.coalesce(*[F.when(F.substring(F.lower(F.trim(month)), 1, 3) == m, F.lit(str(k))) for k, m in enumerate(MONTHS, 1)], F.trim(month))
    whole = F.concat_ws("-", F.lpad(year, 4, "0"), number(named, "12"), number(day, "31"))
    return F.when(year.rlike(r"^\d+$"), F.when(number(named, "12").isNull() | number(day, "31").isNull(), F.concat(F.lpad(year, 4, "0"), F.lit("-12-31"))).otherwise(whole))


PUBMED = (
    "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,ArticleDate:struct<Year:string,Month:string,Day:string>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,Month:string,Day:string>>>>>"
)


def from_pubmed(records: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """The columns keep, paper_id, title, abstract, venue, year, published (text) of article records (XML text); the article's own date goes before the issue's."""
    a = records.select(*keep, F.from_xml(F.col(column), PUBMED).alias("r")).select(*keep, F.col("r.MedlineCitation.PMID").alias("paper_id"), "r.MedlineCitation.Article.*")
    part = lambda n: F.coalesce(F.col(f"ArticleDate.{n}"), F.col(f"Journal.JournalIssue.PubDate.{n}"))
    published = assembled_date(part("Year"), part("Month"), part("Day"))
    return a.select(*keep, "paper_id", F.trim("ArticleTitle").alias("title"), F.array_join("Abstract.AbstractText", " ").alias("abstract"), F.col("Journal.Title").alias("venue"), F.substring(published, 1, 4).cast("int").alias("year"), published.alias("published"))


def from_atom(records: DataFrame, column: str = "value") -> DataFrame:
    """paper_id, title, abstract, published of Atom entries (XML text)."""
    ddl = "id string, title string, summary string, published string"
    e = records.select(F.from_xml(F.col(column), ddl).alias("e"))
    return e.select(T.arxiv_id(F.col("e.id")).alias("paper_id"), F.trim("e.title").alias("title"), F.trim("e.summary").alias("abstract"), T.publication_date(F.col("e.published")).alias("published"))


def cached(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(requests answered by cache, requests that miss) by sha1 of the key column; cache has sha1 and payload."""
    hashed = requests.withColumn("sha1", F.sha1(F.col(key)))
    return hashed.join(cache.select("sha1", "payload"), "sha1"), hashed.join(cache.select("sha1"), "sha1", "left_anti")
