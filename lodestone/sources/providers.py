"""Paper providers behind one interface, as tables: local tables and cached answers work offline, remote ones are plugged in."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graphs, pools
from lodestone.operators.search import ranked
from lodestone.sources import papers


class Provider:
    """search() takes requests (query_id, search, route) and gives PAPER rows with query_id and rank. What a provider can't do it leaves as it is."""

    name = "provider"

    def available(self) -> bool:
        return True

    def search(self, requests: DataFrame, limit: int) -> DataFrame:
        raise NotImplementedError

    def exact_title(self, requests: DataFrame, limit: int = 10) -> DataFrame:
        raise NotImplementedError

    def expand(self, seeds: DataFrame, limit: int) -> DataFrame:
        raise NotImplementedError

    @classmethod
    def can(cls, what: str) -> bool:
        """Whether a subclass gives a method of its own."""
        return getattr(cls, what) is not getattr(Provider, what)

    def tagged(self, requests: DataFrame, limit: int) -> DataFrame:
        """search() with the provider's and the route's tags on every row."""
        found = self.search(requests, limit).join(requests.select("query_id", "route"), "query_id")
        return pools.enriched(found, self.name, F.col("route")).drop("route")


class Fixture(Provider):
    """The first rows of a fixed table, whatever is asked."""

    name = "mock"

    def __init__(self, spark: SparkSession, table: DataFrame | None = None) -> None:
        self.table = papers.fixture(spark) if table is None else table

    def search(self, requests: DataFrame, limit: int) -> DataFrame:
        first = ranked(self.table.withColumn("_all", F.lit(1)), ["_all"], ["paper_id"], limit).drop("_all")  # a fixture is a few rows
        return requests.select("query_id").crossJoin(F.broadcast(first))

    def exact_title(self, requests: DataFrame, limit: int = 10) -> DataFrame:
        from lodestone.functions.text import letters_key

        keyed = self.table.withColumn("title_key", letters_key(F.col("title")))
        return pools.exact_titles(requests, keyed, "query_id", "search", limit).drop("title_key")


class Cached(Provider):
    """Answers that a cache holds (sha1 of name|search|route|limit, payload: JSON rows); misses go to another provider, if given."""

    def __init__(self, name: str, cache: DataFrame, parse: Callable[[DataFrame], DataFrame], behind: Provider | None = None) -> None:
        self.name, self.cache, self.parse, self.behind = name, cache, parse, behind

    def search(self, requests: DataFrame, limit: int) -> DataFrame:
        keyed = requests.withColumn("key", F.concat_ws("|", F.lit(self.name), "search", "route", F.lit(str(limit))))
        hits, misses = papers.cached(keyed, self.cache, "key")
        rows = hits.select("query_id", F.posexplode(F.from_json("payload", "array<string>")).alias("rank", "value")).filter(F.col("rank") < limit)
        parts = rows.select("query_id", (F.col("rank") + 1).cast("long").alias("rank"), "value")
        found = self.parse(parts)
        return found if self.behind is None else found.unionByName(self.behind.search(misses.select(requests.columns), limit), allowMissingColumns=True)


class Edges(Provider):
    """References, citations and related works from an edge table (source, target, route, position)."""

    name = "edges"

    def __init__(self, edges: DataFrame) -> None:
        self.edges = edges

    def expand(self, seeds: DataFrame, limit: int) -> DataFrame:
        return graphs.expand(seeds, self.edges, limit)


Maker = Callable[[SparkSession], Provider]
MAKERS: dict[str, Maker] = {"mock": Fixture}


def register(name: str, make: Maker) -> None:
    MAKERS[name] = make


def build(spark: SparkSession, enabled: Mapping[str, bool], mode: str = "live") -> list[Provider]:
    """The enabled providers that are known and available; mock mode has the fixture only."""
    names = ["mock"] if mode == "mock" else [n for n, on in enabled.items() if on and n in MAKERS and n != "mock"]
    return [p for p in (MAKERS[n](spark) for n in names) if p.available()]
