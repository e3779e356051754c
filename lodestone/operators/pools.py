"""Candidate pools: provenance, append and merge, review verdicts, fan-out to providers, look-ups, reports over pools and runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.resolve import first_by_key
from lodestone.operators.search import ranked

BROAD_TYPES = ("survey", "broad_topic", "method_comparison")
Round = Callable[[DataFrame, int], DataFrame]


def enriched(rows: DataFrame, provider: str, route: Column, path: str = "retrieval_path") -> DataFrame:
    """rows with source and the tags provider:<name> and route:<route> appended to the path, each once."""
    tags = F.array(F.lit(f"provider:{provider}"), F.concat(F.lit("route:"), route))
    return rows.withColumns({path: F.array_union(F.coalesce(path, F.array().cast("array<string>")), tags), "source": F.lit(provider)})


def appended(parts: Sequence[DataFrame], by: Sequence[str], key: str, limit: int | None = None) -> DataFrame:
    """The rows of parts (by, key, rank) one part after the other, the first of equal keys, at most limit a query; rank anew."""
    every = reduce(DataFrame.unionByName, [p.withColumn("_part", F.lit(n)) for n, p in enumerate(parts)])
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy(*by, key).orderBy("_part", "rank"))).filter("_n = 1")
    return ranked(first.withColumnRenamed("rank", "_rank"), list(by), ["_part", "_rank"], limit).drop("_part", "_rank", "_n")


def fused_records(lists: DataFrame, by: Sequence[str], key: str, k: float = 60.0) -> DataFrame:
    """by, key, score, record, metadata, rank of lists (by, key, list_no, rank from 0, weight, record struct, metadata map).

    score is the sum of weight / (k + rank). The first record stays unless a later one adds an abstract or an arxiv_id that the one
    kept lacks; of metadata the last value of a name counts. Ties keep the order of first sight. A key has a record a list at most.
    """
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    better = lambda kept, r: F.when((filled(r["abstract"]) & ~filled(kept["abstract"])) | (filled(r["arxiv_id"]) & ~filled(kept["arxiv_id"])), r).otherwise(kept)
    before = lambda a, b: F.when((a["list_no"] < b["list_no"]) | (a["list_no"] == b["list_no"]) & (a["rank"] < b["rank"]), -1).when((a["list_no"] == b["list_no"]) & (a["rank"] == b["rank"]), 0).otherwise(1)
    seen = F.array_sort(F.collect_list(F.struct("list_no", "rank", "record", "metadata")), before)
    got = lists.groupBy(*by, key).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"), seen.alias("seen"))
    record = F.aggregate(F.slice("seen", F.lit(2), F.size("seen")), F.get("seen", F.lit(0))["record"], lambda kept, x: better(kept, x["record"]))
    merge = lambda a, x: F.when(x["metadata"].isNull(), a).otherwise(F.map_zip_with(a, x["metadata"], lambda _, old, new: F.coalesce(new, old)))
    meta = F.aggregate("seen", F.create_map().cast("map<string,string>"), merge)
    out = got.select(*by, key, "score", record.alias("record"), meta.alias("metadata"), F.get("seen", F.lit(0))["list_no"].alias("_l"), F.get("seen", F.lit(0))["rank"].alias("_r"))
    return ranked(out, list(by), [F.desc("score"), "_l", "_r"]).drop("_l", "_r")


def vector_reranked(pool: DataFrame, scores: DataFrame, by: str, key: str, limit: int = 100) -> DataFrame:
    """The pool's rows that scores (by, key, score) name, by score, with vector_score, rank and the tags of the vector route."""
    tags = F.array(F.lit("provider:vector_rerank"), F.lit("route:vector_semantic"))
    joined = pool.join(scores.select(by, key, F.col("score").alias("vector_score")), [by, key])
    return ranked(joined.withColumn("retrieval_path", F.concat("retrieval_path", tags)), [by], [F.desc("vector_score"), key], limit)


def verdicts_applied(pool: DataFrame, verdicts: DataFrame, by: str, key: str, citations: str, order: str | None = None) -> DataFrame:
    """pool with action and reason: a review's verdict (verdicts: by, key, action, reason), keep where there is none.

    Discarded rows go, but at most a tenth of the pool (one at least): the most cited beyond that stay as noise, of
    equally cited ones the first by `order` (the key by default).
    """
    joined = pool.join(verdicts.select(by, key, "action", "reason"), [by, key], "left").fillna({"action": "keep", "reason": ""})
    cited = Window.partitionBy(by, "action").orderBy(F.asc(F.coalesce(citations, F.lit(0))), F.desc(order or key))
    room = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(by)) / 10))
    marked = joined.withColumns({"_n": F.row_number().over(cited), "_room": room})
    gone = (F.col("action") == "discard") & (F.col("_n") <= F.col("_room"))
    return marked.filter(~gone).withColumn("action", F.when(F.col("action") == "discard", "noise").otherwise(F.col("action"))).drop("_n", "_room")


def needs_broad_search(size: Column, threshold: Column, providers: Column, query_type: Column) -> Column:
    """Whether a pool is too small, lacks one provider's results (providers: those without errors), or too small for a broad request."""
    broad = query_type.isin(*BROAD_TYPES) & (size < F.greatest(threshold, F.lit(250)))
    return F.coalesce((size < threshold) | ~F.array_contains(providers, "semantic_scholar") | broad, F.lit(True))


def fanned_out(queries: DataFrame, providers: DataFrame, by: str, text: str, order: Sequence, most: int = 5) -> DataFrame:
    """Every provider (a few rows of configuration) with the first title-like queries of each request."""
    titles = ranked(queries.filter(T.looks_like_title(F.col(text))), [by], list(order), most, "nth")
    return titles.crossJoin(F.broadcast(providers))


def not_yet_run(calls: DataFrame, log: DataFrame) -> DataFrame:
    """calls (provider, search) without those that the log has as successful."""
    return calls.join(log.filter("error IS NULL").select("provider", "search").distinct(), ["provider", "search"], "left_anti")


def exact_titles(asked: DataFrame, titles: DataFrame, by: str, text: str, limit: int = 10) -> DataFrame:
    """by and the columns of titles (title_key, title, ...) whose letters are those of the asked text; at most limit a request.

    Of equal letters only the first `limit` titles can be among a request's, so no others meet the requests.
    """
    keyed = asked.select(by, T.letters_key(F.col(text)).alias("title_key")).filter("title_key <> ''")
    first = ranked(titles, ["title_key"], ["title"], limit, "_nth").drop("_nth")
    return ranked(keyed.join(first, "title_key"), [by], ["title"], limit)


def passed_through(selections: DataFrame, papers: DataFrame, by: str, key: str, level: Column) -> DataFrame:
    """selections with the level that checks give (level: over both tables' columns); unmatched ones keep theirs."""
    joined = selections.join(papers.withColumn("_known", F.lit(True)), [by, key], "left")
    return joined.withColumn("level", F.when(F.col("_known"), level).otherwise(F.col("level"))).drop("_known")


def timeline(papers: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """papers by year, newest first, those without a year last; rank within by."""
    return ranked(papers, list(by), [F.desc(F.coalesce("year", F.lit(0))), order])


def method_clusters(papers: DataFrame, methods: DataFrame, by: str, key: str, text: str) -> DataFrame:
    """by, topic, papers (sorted ids): papers of a request whose text names one of its methods (by, method); others are General Method."""
    named = papers.select(by, key, F.lower(text).alias("_t")).join(methods.select(by, "method"), by).filter(F.col("_t").contains(F.lower("method")))
    rest = papers.select(by, key).join(named.select(by, key), [by, key], "left_anti").withColumn("method", F.lit("General Method"))
    every = named.select(by, key, "method").unionByName(rest)
    return every.groupBy(by, F.col("method").alias("topic")).agg(F.array_sort(F.collect_set(key)).alias("papers"))


def level_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, high, medium, rejected."""
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    level = F.coalesce("level", F.lit("irrelevant"))
    return rows.groupBy(*by).agg(count(level == "high", "high"), count(level == "medium", "medium"), count(~level.isin("high", "medium"), "rejected"))


def provider_counts(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, source, hits."""
    return rows.groupBy(*by, F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("hits"))


def gold_counts(cases: DataFrame, gold: str) -> DataFrame:
    """gold (number of gold items), cases."""
    return cases.groupBy(F.size(F.coalesce(gold, F.array().cast("array<string>"))).alias("gold")).agg(F.count("*").alias("cases"))


def run_counts(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """One row: runs, logs and runs of each terminal state."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return runs.agg(F.count("*").alias("runs"), count("succeeded"), count("failed"), count("running")).crossJoin(F.broadcast(logs.agg(F.count("*").alias("logs"))))  # one row


def recent_runs(runs: DataFrame, k: int = 10, left_out: Sequence[str] = ("eval",)) -> DataFrame:
    """The k runs with the largest job ids, evaluations aside."""
    return runs.filter(~F.col("kind").isin(*left_out)).orderBy(F.desc("job_id")).limit(k)


def batch_summary(cases: DataFrame, values: Sequence[str]) -> DataFrame:
    """One row: cases, those that succeeded, and the means of values over them to 4 places."""
    done = F.col("state") == "succeeded"
    return cases.agg(F.count("*").alias("cases"), F.count(F.when(done, 1)).alias("succeeded"), *[F.round(F.avg(F.when(done, F.col(v))), 4).alias(v) for v in values])


def in_rounds(pool: DataFrame, search: Round, by: str, key: Sequence[str], order: Sequence, most: int, target: int, cut: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """pool grown by rounds, with `rounds`: the rounds that the row's request (by) took part in.

    search(pool, round) adds rows to the requests still going. A request ends when a round adds none to it or it has target
    rows; the others go on, most rounds at the most. Of equal keys within a request the first by order stays, earlier rounds
    first. Only going requests are searched and moved again: the pool is split after each round, and both parts are cut off
    their lineage (by checkpoint() in the shared folder unless cut is given), so a lost executor costs a round.
    """
    cut = cut or (lambda df: df.checkpoint())
    sized = lambda df: df.groupBy(by).agg(F.count("*").alias("_size"))
    finished, columns = [], pool.columns
    going = cut(first_by_key(pool.withColumn("_key", F.struct(by, *key)), "_key", [*order]).drop("_key"))
    before = cut(sized(going))
    for n in range(1, most + 1):
        joined = going.withColumn("_round", F.lit(0)).unionByName(search(going, n).select(columns).withColumn("_round", F.lit(n)))
        grown = first_by_key(joined.withColumn("_key", F.struct(by, *key)), "_key", ["_round", *order]).drop("_key", "_round")
        old = before.select(F.col(by).alias("_by"), F.col("_size").alias("_old"))
        now = sized(grown := cut(grown)).join(old, F.col(by).eqNullSafe(F.col("_by")), "left").withColumn("_ends", F.col("_size").eqNullSafe(F.col("_old")) | (F.col("_size") >= target))
        before = cut(now.select(by, "_size", "_ends"))
        marks = before.select(F.col(by).alias("_by"), "_ends")
        marked = grown.join(marks, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
        last = F.lit(True) if n == most else F.col("_ends")
        finished.append(marked.filter(last).drop("_ends").withColumn("rounds", F.lit(n)))
        if n == most or before.filter("NOT _ends").isEmpty():
            return reduce(DataFrame.unionByName, finished)
        going = marked.filter("NOT _ends").select(columns)
        before = before.filter("NOT _ends").select(by, "_size")
    return going.withColumn("rounds", F.lit(0))


def simulated_cutoffs(curves: DataFrame, cutoffs: dict[str, DataFrame], by: str) -> DataFrame:
    """by, approach, k, precision, recall, f1 of cut-offs (by, k) over curves (by, rank, gold as boolean)."""
    from lodestone.operators.evaluation import ratios

    names = {n: f"_k{i}" for i, n in enumerate(cutoffs)}
    beside = [c.select(by, F.struct(F.col("k").cast("long").alias("k")).alias(names[n])) for n, c in cutoffs.items()]
    every = reduce(lambda a, b: a.join(b, by, "full_outer"), beside)  # not a union, whose parts adaptive execution may split differently
    gold, inside = F.when(F.col("gold"), 1), lambda c: F.col("rank") <= F.col(c)["k"]
    counts = [F.struct(F.count(F.when(inside(c), 1)).alias("n"), F.count(F.when(inside(c), gold)).alias("hits")).alias(f"{c}_n") for c in names.values()]
    whole = curves.join(every, by).groupBy(by).agg(F.count(gold).alias("gold_count"), *[F.max(c).alias(c) for c in names.values()], *counts)
    parts = F.array(*[F.struct(F.lit(n).alias("approach"), F.col(c).alias("at"), F.col(f"{c}_n").alias("found")) for n, c in names.items()])
    rows = whole.select(by, "gold_count", F.explode(parts).alias("p")).filter("p.at IS NOT NULL").select(by, "gold_count", "p.approach", "p.at.k", "p.found.*")
    return rows.select(by, "approach", "k", *ratios(F.col("hits"), F.col("n"), F.col("gold_count")))


def before_cutoff(rows: DataFrame, day: str, last: DataFrame | None = None, by: str | None = None, cutoff: str = "cutoff") -> DataFrame:
    """rows whose day is not after their request's cut-off (last: by, cutoff; without by one row for all); unknown days and cut-offs pass."""
    if last is None:
        return rows
    if by is None:
        return rows.join(F.broadcast(last.select(F.col(cutoff).alias("_cut")).limit(1)), how="left").filter(F.col(day).isNull() | F.col("_cut").isNull() | (F.col(day) <= F.col("_cut"))).drop("_cut")  # one row
    cuts = last.groupBy(F.col(by).alias("_by")).agg(F.min(cutoff).alias("_cut"))
    joined = rows.join(cuts, F.col(by).eqNullSafe(F.col("_by")), "left")
    return joined.filter(F.col(day).isNull() | F.col("_cut").isNull() | (F.col(day) <= F.col("_cut"))).drop("_by", "_cut")


def most_recent(rows: DataFrame, time: str, key: Sequence[str], k: int, by: Sequence[str] = ()) -> DataFrame:
    """The k rows of the latest time (of each `by`), unknown times last, ties by key; with rank.

    Without `by` each task keeps k rows before the last step numbers them.
    """
    order = [F.desc_nulls_last(time), *key]
    if by:
        return ranked(rows, list(by), order, k)
    first = rows.orderBy(*order).limit(k)
    return ranked(first.withColumn("_all", F.lit(1)), ["_all"], order).drop("_all")
