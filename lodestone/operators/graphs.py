"""Citation graphs: one-hop expansion, induced subgraphs, link priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.search import ranked


def expand(seeds: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """seed, target, route, position: at most limit neighbours per seed and route of edges (source, target, route, position)."""
    near = edges.join(seeds.select(F.col("seed").alias("source")), "source", "left_semi")
    return ranked(near, ["source", "route"], ["position", "target"], limit).select(F.col("source").alias("seed"), "target", "route", F.col("rank").alias("position"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges (source, target) between the given nodes (node), without loops."""
    ends = lambda c: nodes.select(F.col("node").alias(c)).distinct()
    inside = edges.filter("source <> target").join(ends("source"), "source", "left_semi").join(ends("target"), "target", "left_semi")
    return inside.select("source", "target").distinct()


def link_prior(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, prior: 1.0 if the node is linked with another of the nodes, else 0.0."""
    within = induced(edges, nodes)
    linked = within.select(F.col("source").alias("node")).union(within.select("target")).distinct()
    return nodes.join(linked.withColumn("linked", F.lit(1.0)), "node", "left").select("node", F.coalesce("linked", F.lit(0.0)).alias("prior"))


def circular_layout(nodes: DataFrame, order: str, radius: float = 1.0) -> DataFrame:
    """nodes with x and y on a circle; for the few nodes that a page shows."""
    numbered = ranked(nodes.withColumn("_all", F.lit(1)), ["_all"], [order]).join(nodes.agg(F.count("*").alias("_n")), F.lit(True))
    angle = 2 * F.pi() * (F.col("rank") - 1) / F.col("_n")
    return numbered.select(nodes["*"], F.round(radius * F.cos(angle), 6).alias("x"), F.round(radius * F.sin(angle), 6).alias("y"))


# Measures of the page that shows a result's graph: its centre, the circles of methods and papers, how many of each it shows.
CENTRE, METHOD_CIRCLE, PAPER_CIRCLE, MOST_METHODS, MOST_PAPERS = (400.0, 300.0), 150.0, 300.0, 5, 20


def _shown_methods(jobs: DataFrame) -> DataFrame:
    listed = F.slice(F.coalesce("methods", F.array().cast("array<string>")), 1, MOST_METHODS)
    return jobs.select("job_id", F.size(listed).alias("of"), F.posexplode(listed).alias("nth", "method"))


def _on_circle(angle: Column, radius: float) -> list[Column]:
    return [F.round(CENTRE[0] + radius * F.cos(angle), 6).alias("x"), F.round(CENTRE[1] + radius * F.sin(angle), 6).alias("y")]


def page_nodes(jobs: DataFrame, papers: DataFrame) -> DataFrame:
    """job_id, id, type, label, short, x, y, size: the request in the centre, its methods around it and its first papers further out.

    jobs (job_id, query, methods, datasets), papers (job_id, place from 0, paper_id, title, score, citations, relevance, references, doi,
    arxiv_id). Papers stand at even angles of all of a job's papers, though only the first are shown.
    """
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
    query = F.col("query")
    centre = jobs.select("job_id", F.lit("query_center").alias("id"), F.lit("topic").alias("type"), cut(query, 30).alias("label"), cut(query, 30).alias("short"), F.lit(CENTRE[0]).alias("x"), F.lit(CENTRE[1]).alias("y"), F.lit(35.0).alias("size"))
    methods = _shown_methods(jobs)
    around = methods.select("job_id", F.concat(F.lit("method_"), "nth").alias("id"), F.lit("method").alias("type"), F.col("method").alias("label"), F.col("method").alias("short"), *_on_circle(2 * F.pi() * F.col("nth") / F.col("of"), METHOD_CIRCLE), F.lit(20.0).alias("size"))
    counts = papers.groupBy("job_id").agg(F.count("*").alias("of"))
    first = papers.filter(F.col("place") < MOST_PAPERS).join(counts, "job_id")
    size = 15 + F.least(F.lit(15.0), F.coalesce("citations", F.lit(0)) / 10) + 5 * F.col("score")
    title = F.coalesce("title", F.lit("Untitled"))
    shown = first.select("job_id", F.coalesce("paper_id", F.concat(F.lit("paper_"), "place")).alias("id"), F.lit("paper").alias("type"), title.alias("label"), cut(title, 15).alias("short"), *_on_circle(2 * F.pi() * F.col("place") / F.col("of") + 0.3, PAPER_CIRCLE), F.round(size, 6).alias("size"))
    return centre.unionByName(around).unionByName(shown)


def page_edges(jobs: DataFrame, papers: DataFrame) -> DataFrame:
    """job_id, source, target, type, weight: the request with its methods and papers, papers with methods that their titles name, and
    references between shown papers, by DOI or arXiv number. Tables as for page_nodes."""
    first = papers.filter(F.col("place") < MOST_PAPERS).withColumn("id", F.coalesce("paper_id", F.concat(F.lit("paper_"), "place")))
    methods = _shown_methods(jobs)
    edge = lambda source, target, kind, weight: ["job_id", source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), weight.cast("double").alias("weight")]
    centre, method = F.lit("query_center"), F.concat(F.lit("method_"), F.col("nth"))
    named = first.join(methods, "job_id").filter(F.lower(F.coalesce("title", F.lit("Untitled"))).contains(F.lower("method")))
    plain = lambda c: F.nullif(F.trim(F.lower(c)), F.lit(""))
    names = first.filter("paper_id IS NOT NULL").select("job_id", F.col("id").alias("cited"), "place", F.explode(F.array(plain(F.col("doi")), plain(F.col("arxiv_id")))).alias("name"))
    last = names.filter("name IS NOT NULL").groupBy("job_id", "name").agg(F.max_by("cited", "place").alias("cited"))  # of papers with one name, the last
    cites = first.filter("paper_id IS NOT NULL").select("job_id", "id", F.explode("references").alias("r")).withColumn("name", plain(F.col("r")))
    parts = [
        methods.select(*edge(centre, method, "association", F.lit(1.0))),
        first.select(*edge(centre, F.col("id"), "association", F.col("score"))),
        named.select(*edge(F.col("id"), method, "association", F.lit(0.8))),
        cites.join(last, ["job_id", "name"]).select(*edge(F.col("id"), F.col("cited"), "reference", F.lit(1.0))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def page_stats(jobs: DataFrame, papers: DataFrame) -> DataFrame:
    """job_id, papers, methods, datasets, edges, clusters, core (ids of the one cluster: shown papers of high relevance, in order)."""
    first = papers.filter(F.col("place") < MOST_PAPERS)
    core = F.transform(F.array_sort(F.collect_list(F.when(F.col("relevance") == "highly_relevant", F.struct("place", "paper_id")))), lambda p: p["paper_id"])
    counts = first.groupBy("job_id").agg(F.count("*").alias("papers"), core.alias("core"))
    edges = page_edges(jobs, papers).groupBy("job_id").agg(F.count("*").alias("edges"))
    few = lambda c: F.least(F.coalesce(F.size(F.coalesce(c, F.array().cast("array<string>"))), F.lit(0)), F.lit(MOST_METHODS)).cast("long")
    rows = jobs.join(counts, "job_id", "left").join(edges, "job_id", "left").fillna(0, ["papers", "edges"])
    core = F.coalesce("core", F.array().cast("array<string>"))
    return rows.select("job_id", "papers", few(F.col("methods")).alias("methods"), few(F.col("datasets")).alias("datasets"), "edges", (F.size(core) > 0).cast("long").alias("clusters"), core.alias("core"))
