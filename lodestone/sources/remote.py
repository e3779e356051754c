"""Paper services over HTTP: requests are made as columns, sent by the executors with pacing and retries, and parsed as tables.

Bodies are written to the shared folder of spark.checkpoint.dir, so that a lost executor sends its own requests again only. Keys are read
from the environment of the executors and never stand in a plan.
"""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import cycle
from urllib.parse import urlencode

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.provider_text import arxiv_search
from lodestone.sources import papers
from lodestone.sources.providers import Provider

# Answers after which a request is sent again, and the longest wait before it.
RETRIED, LONGEST_WAIT, MOST_TITLE = (429, 500, 502, 503, 504), 30.0, 180

Opener = Callable[[str, dict, float], str]


def opened(url: str, headers: dict, seconds: float) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=seconds) as answer:  # noqa: S310
        return answer.read().decode("utf-8")


@dataclass
class Http:
    """Requests one after the other: `interval` seconds apart, sent again `retries` times with doubled waits (twice as long after 429)."""

    seconds: float = 20.0
    retries: int = 2
    interval: float = 0.0
    wait: float = 1.0
    opener: Opener = opened
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    ready: float = field(default=0.0, init=False)

    def get(self, url: str, headers: dict | None = None) -> str:
        for n in range(self.retries + 1):
            if (early := self.ready - self.clock()) > 0:
                self.sleep(early)
            self.ready = self.clock() + self.interval
            try:
                return self.opener(url, headers or {}, self.seconds)
            except urllib.error.HTTPError as e:
                if e.code not in RETRIED or n == self.retries:
                    raise
                longer = 2 if e.code == 429 else 1
            except (urllib.error.URLError, TimeoutError, ValueError):
                if n == self.retries:
                    raise
                longer = 1
            self.sleep(min(longer * self.wait * 2**n, LONGEST_WAIT))
        raise ValueError("retries are fewer than none")


@dataclass(frozen=True)
class Access:
    """What a request carries for a service: parameters and headers, each with the name of the environment variable that holds it."""

    params: tuple[tuple[str, str], ...] = ()
    headers: tuple[tuple[str, str], ...] = ()

    def read(self) -> tuple[dict, dict]:
        held = lambda pairs: {name: os.environ[var] for name, var in pairs if os.environ.get(var)}
        return held(self.params), held(self.headers)


def fetched(requests: DataFrame, keys: Sequence[str], url: str, make_http: Callable[[], Http], access: Sequence[Access] = ()) -> DataFrame:
    """keys, body, error: the answers to the addresses in column url; null addresses are not asked, equal ones once. Accesses take
    turns, and where one is refused for now (429, or no answer in time) the next is tried.

    The requests are sent when this is called, not when its result is read: the answers are kept in the folder of
    spark.checkpoint.dir, so that no later step asks again.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        http, turns, n = make_http(), cycle(access or (Access(),)), max(1, len(access))
        for batch in batches:
            bodies, errors = [], []
            for address in batch.column(0).to_pylist():
                body = error = None
                for _ in range(n):
                    params, headers = next(turns).read()
                    try:
                        body, error = http.get(address + ("&" + urlencode(params) if params else ""), headers), None
                        break
                    except Exception as e:  # noqa: BLE001 - a service may fail in any way; the row says how
                        error = f"{type(e).__name__}: {e}"
                        if not (isinstance(e, TimeoutError) or getattr(e, "code", 0) == 429 or "timed out" in str(e)):
                            break
                bodies.append(body)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string()), pa.array(errors, pa.string())], ["_asked", "body", "error"])

    asked = requests.select(F.col(url).alias("_asked")).filter("_asked IS NOT NULL").distinct()
    answers = asked.mapInArrow(ask, "_asked string, body string, error string").checkpoint()
    return requests.select(*keys, F.col(url).alias("_url")).join(answers, F.col("_url") == F.col("_asked"), "left").select(*keys, "body", "error")


def address(base: str, **params: Column) -> Column:
    """base?name=value&... with encoded values; null parameters are left out. A _ in a name stands for -."""
    pairs = [F.concat(F.lit(f"{name.replace('_', '-')}="), F.url_encode(value.cast("string"))) for name, value in params.items()]
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *pairs))


def date_filter(first: Column, last: Column) -> Column:
    """The filter of publication dates from the first day of one year to the last day of another; null without either."""
    parts = F.concat_ws(",", F.concat(F.lit("from_publication_date:"), first.cast("string"), F.lit("-01-01")), F.concat(F.lit("to_publication_date:"), last.cast("string"), F.lit("-12-31")))
    return F.nullif(parts, F.lit(""))


class Works(Provider):
    """Search in a catalogue of works: words with the years in the request, or an exact title. Requests may have first_year and last_year."""

    name = "openalex"

    def __init__(self, base: str, make_http: Callable[[], Http] = Http, access: Sequence[Access] = ()) -> None:
        self.base, self.make_http, self.access = base, make_http, access

    def rows(self, requests: DataFrame, url: Column, limit: int) -> DataFrame:
        got = fetched(requests.withColumn("_url", url), ["query_id"], "_url", self.make_http, self.access)
        items = F.slice(F.from_json(F.get_json_object("body", "$.results"), "array<string>"), 1, limit)
        listed = got.select("query_id", F.posexplode(items).alias("rank", "value")).withColumn("rank", (F.col("rank") + 1).cast("long"))
        return papers.from_works(listed, keep=("query_id", "rank"))

    def search(self, requests: DataFrame, limit: int) -> DataFrame:
        year = lambda c: F.col(c) if c in requests.columns else F.lit(None).cast("int")
        return self.rows(requests, address(self.base, search=F.col("search"), per_page=F.lit(limit), filter=date_filter(year("first_year"), year("last_year"))), limit)

    def exact_title(self, requests: DataFrame, limit: int = 10) -> DataFrame:
        """Only texts that look like titles are asked, in at most MOST_TITLE letters."""
        title = F.trim(F.regexp_replace(F.substring("search", 1, MOST_TITLE), r"[\r\n]+", " "))
        quoted = F.concat(F.lit('title.search:"'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"'))
        return self.rows(requests, F.when(T.looks_like_title(title), address(self.base, filter=quoted, per_page=F.lit(limit))), limit)


    def expand(self, seeds: DataFrame, limit: int) -> DataFrame:
        """seed, route, position and PAPER rows of seeds (seed, references: addresses or ids of works, cited_by_url): the works of the
        first `limit` references, each asked once whoever refers to it, and the first `limit` works that cite the seed."""
        name = lambda c: F.nullif(F.upper(F.regexp_extract(F.trim(c), r"(?i)(?:^|/)(W\d+)$", 1)), F.lit(""))
        address_of = lambda c: F.concat(F.lit(self.base.rstrip("/") + "/"), name(c))
        named = seeds.select("seed", F.posexplode(F.slice(F.filter("references", lambda r: F.trim(r) != ""), 1, limit)).alias("_at", "_ref"))
        named = named.select("seed", F.lit("reference_expansion").alias("route"), (F.col("_at") + 1).cast("long").alias("position"), address_of(F.col("_ref")).alias("_url"))
        got = fetched(named, ["seed", "route", "position"], "_url", self.make_http, self.access).filter("body IS NOT NULL")
        references = papers.from_works(got.withColumnRenamed("body", "value"), keep=("seed", "route", "position"))
        paged = F.concat("cited_by_url", F.when(F.col("cited_by_url").contains("?"), "&").otherwise("?"), F.lit(f"per-page={limit}"))
        cited = seeds.filter("cited_by_url <> ''").select("seed", F.lit("citation_expansion").alias("route"), paged.alias("_url"))
        answers = fetched(cited, ["seed", "route"], "_url", self.make_http, self.access)
        items = F.slice(F.from_json(F.get_json_object("body", "$.results"), "array<string>"), 1, limit)
        listed = answers.select("seed", "route", F.posexplode(items).alias("_at", "value")).withColumn("position", (F.col("_at") + 1).cast("long"))
        return references.unionByName(papers.from_works(listed, keep=("seed", "route", "position")))


class Preprints(Provider):
    """Search in a preprint archive that answers with Atom feeds: in all fields, or for a title as it is."""

    name = "arxiv"
    EMPTY = "machine learning"  # fixed value: what is asked where nothing of a search text is left
    FEED = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>>>"

    def __init__(self, base: str, make_http: Callable[[], Http] = Http) -> None:
        self.base, self.make_http = base, make_http

    def rows(self, requests: DataFrame, text: Column, limit: int) -> DataFrame:
        url = F.when(text.isNotNull(), address(self.base, search_query=text, start=F.lit(0), max_results=F.lit(limit)))
        url = F.replace(F.replace(url, F.lit("search-query="), F.lit("search_query=")), F.lit("max-results="), F.lit("max_results="))
        got = fetched(requests.withColumn("_url", url), ["query_id"], "_url", self.make_http)
        feed = F.from_xml(F.col("body"), self.FEED)
        listed = got.filter("body IS NOT NULL").select("query_id", F.posexplode(F.slice(feed["entry"], 1, limit)).alias("_at", "e"))
        one_line = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
        title, ident = one_line(F.col("e.title")), F.nullif(F.trim("e.id"), F.lit(""))
        names = F.transform(F.filter("e.author", lambda a: F.trim(a["name"]) != ""), lambda a: F.trim(a["name"]))
        return listed.select(
            "query_id", (F.col("_at") + 1).cast("long").alias("rank"), F.coalesce(ident, title).alias("paper_id"), F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")).alias("title"),
            F.nullif(one_line(F.col("e.summary")), F.lit("")).alias("abstract"), F.substring(F.trim("e.published"), 1, 4).try_cast("int").alias("year"), F.lit(None).cast("string").alias("venue"),
            F.coalesce(names, F.array().cast("array<string>")).alias("authors"), F.lit(None).cast("string").alias("doi"), F.element_at(F.split(ident, "/"), -1).alias("arxiv_id"),
            F.lit(None).cast("int").alias("citation_count"), F.lit("arxiv").alias("source"), F.array().cast("array<string>").alias("retrieval_path"), F.substring(F.trim("e.published"), 1, 10).alias("published"),
        )

    def search(self, requests: DataFrame, limit: int) -> DataFrame:
        plain = F.nullif(F.trim(arxiv_search(F.col("search"))), F.lit(""))
        return self.rows(requests, F.concat(F.lit("all:"), F.coalesce(plain, F.lit(self.EMPTY))), limit)

    def exact_title(self, requests: DataFrame, limit: int = 10) -> DataFrame:
        title = F.nullif(F.trim(F.regexp_replace("search", r"[\r\n]+", " ")), F.lit(""))
        return self.rows(requests, F.concat(F.lit('ti:"'), title, F.lit('"')), limit)


class Scholar(Provider):
    """Search in a citation service. It is available where its key is, if it needs one."""

    name = "semantic_scholar"
    FIELDS = "paperId,title,abstract,year,venue,url,citationCount,authors,externalIds"

    def __init__(self, base: str, make_http: Callable[[], Http] = Http, key: str | None = None) -> None:
        self.base, self.make_http, self.key = base, make_http, key

    def available(self) -> bool:
        return bool(self.base) and (self.key is None or bool(os.environ.get(self.key)))

    def search(self, requests: DataFrame, limit: int) -> DataFrame:
        access = [Access(headers=(("x-api-key", self.key),))] if self.key else []
        url = address(self.base, query=F.col("search"), limit=F.lit(limit), fields=F.lit(self.FIELDS))
        got = fetched(requests.withColumn("_url", url), ["query_id"], "_url", self.make_http, access)
        items = F.slice(F.from_json(F.get_json_object("body", "$.data"), "array<string>"), 1, limit)
        listed = got.select("query_id", F.posexplode(items).alias("rank", "value")).withColumn("rank", (F.col("rank") + 1).cast("long"))
        return papers.from_scholar(listed, keep=("query_id", "rank"))


    def expand(self, seeds: DataFrame, limit: int) -> DataFrame:
        """seed, route, position and PAPER rows of seeds (seed, lookup_id): papers that the seed refers to and papers that cite it.

        The service's papers are asked below base without its last part; seeds without an id and papers without one are left out.
        """
        access, found = [Access(headers=(("x-api-key", self.key),))] if self.key else [], None
        root = self.base.rstrip("/").rsplit("/", 1)[0]
        for suffix, part, route in (("references", "citedPaper", "reference_expansion"), ("citations", "citingPaper", "citation_expansion")):
            url = F.concat(F.lit(root + "/"), F.url_encode("lookup_id"), F.lit(f"/{suffix}?fields={self.FIELDS}&limit={limit}&offset=0"))
            got = fetched(seeds.filter("lookup_id <> ''").withColumn("_url", url), ["seed"], "_url", self.make_http, access)
            items = F.slice(F.from_json(F.get_json_object("body", "$.data"), "array<string>"), 1, limit)
            listed = got.select("seed", F.lit(route).alias("route"), F.posexplode(items).alias("_at", "_item"))
            listed = listed.select("seed", "route", (F.col("_at") + 1).cast("long").alias("position"), F.get_json_object("_item", f"$.{part}").alias("value")).filter(F.get_json_object("value", "$.paperId") != "")
            rows = papers.from_scholar(listed, keep=("seed", "route", "position"))
            found = rows if found is None else found.unionByName(rows)
        return found


class Articles(Provider):
    """Search in an article index in two steps: the ids that fit, then their records. base is the folder of its services."""

    name = "pubmed"

    def __init__(self, base: str, make_http: Callable[[], Http] = Http) -> None:
        self.base, self.make_http = base.rstrip("/"), make_http

    def search(self, requests: DataFrame, limit: int) -> DataFrame:
        article = F.lit("pubmed")
        asked = address(f"{self.base}/esearch.fcgi", db=article, term=F.col("search"), retmode=F.lit("xml"), retmax=F.lit(limit))
        first = fetched(requests.withColumn("_url", asked), ["query_id"], "_url", self.make_http)
        ids = F.regexp_extract_all("body", F.lit(r"<Id>\s*([^<]+?)\s*</Id>"), F.lit(1))
        records = address(f"{self.base}/efetch.fcgi", db=article, id=F.array_join(ids, ","), retmode=F.lit("xml"))
        second = fetched(first.withColumn("_url", F.when(F.size(ids) > 0, records)), ["query_id"], "_url", self.make_http)
        items = F.regexp_extract_all("body", F.lit(r"(?s)<PubmedArticle>.*?</PubmedArticle>"), F.lit(0))
        listed = second.select("query_id", F.posexplode(items).alias("rank", "value")).withColumn("rank", (F.col("rank") + 1).cast("long"))
        return papers.from_pubmed(listed, keep=("query_id", "rank"))
