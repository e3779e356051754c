"""Candidate scores and gates before and after evidence: rough and local scores, listwise gate, staged selection, three-phase recall.

Candidates have query_id, paper_id, pos (input order), path (array of route and provider tags) and the columns that each step names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scoring import level_of_score
from lodestone.operators.hooks import default_score
from lodestone.operators.search import ranked


def on_route(path: Column, part: str) -> Column:
    return F.coalesce(F.exists(path, lambda p: p.contains(part)), F.lit(False))


def rough_score(dense: Column, path: Column, citations: Column, overlap: Column, prerank: Column, coverage: Column) -> Column:
    """The score by which a pool is sorted before selection; 0.5 where there is no dense score.

    overlap: words that title and query share. An empty or missing path counts as one route. Without a plan, prerank and
    coverage are null and add nothing.
    """
    base = F.when(dense > 0, dense).otherwise(0.5)
    expanded = lambda p: F.when(p.contains("reference_expansion") | p.contains("citation_expansion"), 0.05).otherwise(0.0)
    of_tag = lambda p: F.when(p.contains("title_exact"), 1.0).when(p.contains("title_like"), 0.2).otherwise(0.0) + expanded(p)
    routes = F.aggregate(F.transform(F.coalesce(path, F.array()), of_tag), F.lit(0.0), lambda a, x: a + x)
    cited = F.log1p(F.greatest(F.coalesce(citations, F.lit(0)), F.lit(0)).cast("double"))
    planned = 0.65 * F.coalesce(prerank, F.lit(0.0)) + 0.35 * F.greatest(F.coalesce(coverage, F.lit(0.0)), F.lit(0.0))
    return base + 0.01 * F.greatest(F.coalesce(F.size(path), F.lit(1)), F.lit(1)) + 0.01 * cited + routes + F.least(0.1 * overlap, F.lit(0.5)) + planned


# What a route is worth to the evidence score, and the providers that a tag "name:..." names.
ROUTE_WORTH = ((0.60, ("title_exact",)), (0.40, ("title_like",)), (0.15, ("core_topic",)), (0.12, ("method_task", "entity_dataset", "dataset")), (0.10, ("evolved", "hybrid", "query2doc", "hyde")))
PROVIDERS = ("openalex", "semantic_scholar", "arxiv", "pubmed", "pasa_local")


def evidence_tokens(text: Column) -> Column:
    """Distinct lower-case words of two letters or more, plurals cut: -ies to -y, -ches, -shes, -xes and -zes without -es, -s off, not -ss."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b\w{2,}\b"), F.lit(0)))
    long, cut = lambda w, n: F.length(w) > n, lambda w, n: F.substring(w, F.lit(1), F.length(w) - n)
    es = lambda w: w.endswith("ches") | w.endswith("shes") | w.endswith("xes") | w.endswith("zes")
    single = lambda w: F.when(long(w, 4) & w.endswith("ies"), F.concat(cut(w, 3), F.lit("y"))).when(long(w, 4) & es(w), cut(w, 2)).when(long(w, 3) & w.endswith("s") & ~w.endswith("ss"), cut(w, 1)).otherwise(w)
    return F.array_distinct(F.transform(words, single))


def text_constraints(*lists: Column) -> Column:
    """The constraints of several lists that can be looked for in a text: trimmed, the first of equal ones, no years."""
    flat = F.filter(F.transform(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in lists])), lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))
    asked = F.filter(flat, lambda c: ~F.lower(c).startswith("year") & ~F.lower(c).rlike(r"(?:^|\s)(?:year|20\d{2})\s*[<>=]"))
    return F.filter(asked, lambda c, i: ~F.exists(F.slice(asked, F.lit(1), i), lambda e: F.lower(e) == F.lower(c)))


def evidence_features(rows: DataFrame, title: str, abstract: str, query_tokens: Column, constraints: Column, path: str, source: str) -> DataFrame:
    """rows with what evidence_score() asks for: title_match, abstract_match (shares of the query's tokens), worded (constraints
    whose tokens all stand in title or abstract), literal (others that stand there as they are), matched and missing (the constraints
    of either kind, and the rest), providers (a third each, at most 1)."""
    of_title, of_abstract = evidence_tokens(F.col(title)), evidence_tokens(F.col(abstract))
    share = lambda tokens: F.when(F.size(query_tokens) > 0, F.size(F.array_intersect(query_tokens, tokens)) / F.size(query_tokens)).otherwise(0.0)
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))
    asked = F.transform(constraints, lambda c: F.struct(F.lower(c).alias("c"), evidence_tokens(c).alias("words"), c.alias("own")))
    rows = rows.withColumns({"_title": of_title, "_abstract": of_abstract, "_text": text, "_asked": asked})
    every = F.array_union("_title", "_abstract")
    worded = lambda c: (F.size(c["words"]) > 0) & (F.size(F.array_except(c["words"], every)) == 0)
    literal = lambda c: ~worded(c) & F.col("_text").contains(c["c"])
    own = lambda test: F.transform(F.filter("_asked", test), lambda c: c["own"])
    named = lambda p: F.when(p.startswith("provider:"), F.replace(p, F.lit("provider:"), F.lit(""))).when(p.startswith("prov:"), F.get(F.split(p, ":"), F.lit(1))).when(F.get(F.split(p, ":"), F.lit(0)).isin(*PROVIDERS) & p.contains(":"), F.get(F.split(p, ":"), F.lit(0)))
    providers = F.array_distinct(F.array_compact(F.concat(F.transform(F.coalesce(path, F.array().cast("array<string>")), named), F.array(F.nullif(F.col(source), F.lit(""))))))
    return rows.withColumns({
        "title_match": share(F.col("_title")), "abstract_match": share(F.col("_abstract")),
        "worded": F.size(F.filter("_asked", worded)), "literal": F.size(F.filter("_asked", literal)),
        "matched": own(lambda c: worded(c) | literal(c)), "missing": own(lambda c: ~worded(c) & ~literal(c)),
        "providers": F.least(F.size(providers) / 3, F.lit(1.0)),
    }).drop("_title", "_abstract", "_text", "_asked")


def evidence_score(title_match: Column, abstract_match: Column, worded: Column, literal: Column, path: Column, providers: Column, year: Column, citations: Column) -> Column:
    """The local evidence score: shares of query words, constraints met (by words 0.15, literally 0.10), the best route, providers, recency, authority; at most 1."""
    worth = [(v, reduce(lambda a, b: a | b, [on_route(path, n) for n in names])) for v, names in ROUTE_WORTH]
    route = F.lit(0.0)
    for value, met in reversed([*worth, (0.05, F.coalesce(F.size(path), F.lit(0)) > 0)]):
        route = F.when(met, value).otherwise(route)
    year = F.nullif(year, F.lit(0))
    recency = F.when(year >= 2023, 0.05).when(year >= 2021, 0.04).when(year >= 2019, 0.03).when(year >= 2017, 0.02).when(year.isNotNull(), 0.01).otherwise(0.0)
    authority = F.least(0.008 * F.log1p(F.greatest(F.coalesce(citations, F.lit(0)), F.lit(0)).cast("double")), F.lit(0.05))
    constraints = F.least(0.15 * worded + 0.10 * literal, F.lit(0.30))
    return F.least(F.lit(1.0), 0.25 * title_match + 0.20 * abstract_match + constraints + route + 0.10 * providers + recency + authority)


def local_selection(rows: DataFrame, score: str) -> DataFrame:
    """rows (evidence_features(), a local score) as a selection: level, relevance_score, constraint_score, evidence_score, confidence.

    A level's default numbers are raised by the score and by the share of constraints that are matched.
    """
    s, asked = F.col(score), F.size("matched") + F.size("missing")
    rows = rows.withColumn("level", level_of_score(s))
    met = F.when(asked > 0, F.size("matched") / asked).otherwise(0.0)
    return rows.withColumns({
        "relevance_score": F.greatest(default_score(F.col("level")), s), "constraint_score": F.greatest(default_score(F.col("level"), 1), met),
        "evidence_score": default_score(F.col("level"), 2), "confidence": F.least(s + 0.1, F.lit(0.9)),
    })


def heuristic_level(hits: Column, citations: Column, year: Column, constrained: Column) -> Column:
    """The older rule: named methods and datasets in the text, citations and year; high from 0.5, medium from 0.3.

    A plan that names none (not constrained) scores 0.35, whatever the paper's citations and year.
    """
    words = F.least(0.2 * hits, F.lit(0.4))
    cited = F.when(citations > 200, 0.15).when(citations > 50, 0.08).when(citations > 10, 0.03).otherwise(0.0)
    recent = F.when(year >= 2022, 0.15).when(year >= 2020, 0.08).otherwise(0.0)
    score = F.when(constrained, F.round(words + F.least(cited + recent, F.lit(0.3)), 6)).otherwise(0.35)
    return F.when(score >= 0.5, "high").when(score >= 0.3, "medium").otherwise("low")


def shielded(rows: DataFrame, by: Sequence[str], score: str, first: int = 50, least: float = 0.75, k: int = 200) -> DataFrame:
    """The k best rows by score, where the first input rows count at least `least`."""
    held = rows.withColumn("shielded", F.when(F.col("pos") < first, F.greatest(F.col(score), F.lit(least))).otherwise(F.col(score)))
    return ranked(held, list(by), [F.desc("shielded"), "pos"], k)


def listwise_gate(rows: DataFrame, by: str, most_bridges: int = 12, most: int = 40) -> DataFrame:
    """rows that go to a listwise reranker, with `bridge` for low ones that strong retrieval carries over.

    High rows and medium rows of relevance 0.25 or more go; low rows may fill up to `most`, at most `most_bridges`,
    by local score. Columns: level, relevance, local, matched (constraints met), validated, year_broken, path, pos.
    """
    p, local, matched = F.col("path"), F.col("local"), F.col("matched")
    exact, like, routes = on_route(p, "title_exact"), on_route(p, "title_like"), F.size(F.array_distinct(p))
    strong = F.when(exact, (local >= 0.30) | (matched > 0) | (routes >= 2)).when(like, (local >= 0.55) | (local >= 0.45) & (matched > 0)).otherwise((local >= 0.70) & ((matched > 0) | (routes >= 3)))
    carried = (F.col("level") == "low") & ~F.col("year_broken") & (F.col("validated") | exact | like) & strong
    sure = (F.col("level") == "high") | (F.col("level") == "medium") & (F.coalesce("relevance", F.lit(0.0)) >= 0.25)
    marked = rows.withColumns({"sure": sure, "bridge": carried & ~sure}).filter("sure OR bridge")
    nth = F.row_number().over(Window.partitionBy(by, "sure").orderBy(F.desc("local"), "pos"))
    room = F.lit(most) - F.sum(F.col("sure").cast("int")).over(Window.partitionBy(by))
    kept = marked.withColumns({"_n": nth, "_room": room}).filter(F.col("sure") | (F.col("_n") <= F.least(F.lit(most_bridges), F.col("_room"))))
    return kept.drop("_n", "_room", "sure")


def staged_selection(rows: DataFrame, by: str, budget: int) -> DataFrame:
    """At most `budget` rows a query in stages: title hits, buckets in turn, dense-only hits, second chances, the rest; with `stage`.

    Columns: pos, path, dense, rough, dropped (pool review spoke against). A bucket is the last part of the first path tag. As buckets
    take turns until the budget is full, later stages only add rows where buckets run out.
    """
    titles = min(20, max(10, budget // 2))
    is_title = on_route(F.col("path"), "title_exact") | on_route(F.col("path"), "title_like")
    w = lambda *c: Window.partitionBy(by, *c)
    rows = rows.withColumn("is_title", is_title).withColumn("_t", F.row_number().over(w("is_title").orderBy("pos")))
    first = F.col("is_title") & (F.col("_t") <= titles)
    bucket = F.coalesce(F.element_at(F.split(F.get("path", F.lit(0)), r"\."), -1), F.lit("unknown"))
    rows = rows.withColumns({"_first": first, "_bucket": bucket})
    rows = rows.withColumn("_turn", F.row_number().over(w("_first", "_bucket").orderBy("pos")))
    seen = F.min("pos").over(w("_first", "_bucket"))
    rows = rows.withColumn("_seen", seen)
    stage = F.when(F.col("_first"), 1).otherwise(2)
    order = [F.when(F.col("_first"), 0).otherwise(1), F.when(F.col("_first"), F.col("pos")).otherwise(F.col("_turn")), F.col("_seen")]
    out = rows.withColumns({"stage": stage, "place": F.row_number().over(w().orderBy(*order))})
    return out.filter(F.col("place") <= budget).drop("is_title", "_t", "_first", "_bucket", "_turn", "_seen")


def phase_recall(gold: DataFrame, phases: dict[str, DataFrame], by: str, key: str) -> DataFrame:
    """by, gold and, per phase, the hits and recall (4 places): how many gold items pool, selection and result hold."""
    out = gold.groupBy(by).agg(F.countDistinct(key).alias("gold"))
    for name, rows in phases.items():
        hits = gold.join(rows.select(by, key).distinct(), [by, key], "left_semi").groupBy(by).agg(F.countDistinct(key).alias(f"{name}_hits"))
        out = out.join(hits, by, "left").withColumn(f"{name}_hits", F.coalesce(f"{name}_hits", F.lit(0)))
        out = out.withColumn(f"{name}_recall", F.round(F.col(f"{name}_hits") / F.col("gold"), 4))
    return out


def breaker(events: DataFrame, by: str, order: Sequence[str], kind: str, most_timeouts: int = 3, most_errors: int = 5) -> DataFrame:
    """events with whether a circuit breaker is open after each: it opens for good on a permanent error, on enough timeouts or errors.

    A success takes one error back; the running error count is a reflected walk, so its minimum is subtracted.
    """
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col(kind).isin("error", "timeout"), 1).when(F.col(kind) == "success", -1).otherwise(0)
    walked = events.withColumn("_walk", F.sum(step).over(w)).withColumn("_low", F.least(F.lit(0), F.min("_walk").over(w)))
    counted = walked.withColumns({"errors": F.col("_walk") - F.col("_low"), "timeouts": F.count(F.when(F.col(kind) == "timeout", 1)).over(w), "_dead": F.count(F.when(F.col(kind) == "permanent", 1)).over(w)})
    trips = (F.col("errors") >= most_errors) | (F.col("timeouts") >= most_timeouts) | (F.col("_dead") > 0)
    return counted.withColumn("open", F.max(trips).over(w)).drop("_walk", "_low", "_dead")
