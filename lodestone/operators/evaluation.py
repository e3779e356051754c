"""Retrieval metrics over ranked results and gold sets, per query and averaged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import corpus_id, identifier, title_key
from lodestone.operators.resolve import components


def match_keys(ids: Sequence[Column], corpus_ids: Sequence[Column] = (), title: Column | None = None, strict: bool = False) -> Column:
    """The keys by which a record or a gold item is matched: ids, corpus ids and the title (strict: marked, so that it meets titles only)."""
    name = [] if title is None else [F.concat(F.lit("title_strict:"), title_key(title)) if strict else title_key(title)]
    return F.array_distinct(F.array_compact(F.array(*map(identifier, ids), *map(corpus_id, corpus_ids), *name)))


def merged_gold(gold: DataFrame, results: DataFrame, by: str, key: str) -> DataFrame:
    """by, key, item: gold's keys, where items that share a key, or that one result touches, are one item.

    gold (by, gold_id, keys) and results (by, rank, keys). Each record links its keys to its first one, so links grow with the keys.
    """
    named = lambda k: F.concat_ws("|", F.col(by).cast("string"), k)
    known = gold.select(by, F.explode("keys").alias(key)).distinct()
    several = F.size("keys") > 1  # a record of one key links nothing
    golds = gold.filter(several).select(by, F.col("gold_id").alias("of"), F.explode("keys").alias(key)).filter(F.col(key).isNotNull())
    touched = results.filter(several).select(by, F.col("rank").alias("of"), F.explode("keys").alias(key)).join(known, [by, key]).select(by, "of", key)
    ends = [df.withColumn("node", named(F.col(key))).select("node", F.min("node").over(Window.partitionBy(by, "of")).alias("first")) for df in (golds, touched)]
    found = components(ends[0].union(ends[1]).filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")))
    marked = known.withColumn("node", named(F.col(key))).join(found, "node", "left")
    return marked.select(by, key, F.coalesce("component", "node").alias("item"))


def scored_against_gold(results: DataFrame, gold: DataFrame, by: str, k: int | None = None) -> DataFrame:
    """by, true_positive, predicted_count, gold_count, precision, recall, f1 of the first k results of each query that has gold.

    gold (by, gold_id, keys), results (by, rank, keys); keys as match_keys gives them, strict or not. Gold items are merged first, so
    a result can match one item at most, and matches are the items that any result touches. Results are counted as they are.
    """
    results = results if k is None else results.filter(F.col("rank") <= k)
    items = merged_gold(gold, results, by, "key")
    asked = results.select(by, F.explode("keys").alias("key")).distinct().withColumn("touched", F.lit(1))
    met = items.join(asked, [by, "key"], "left").groupBy(by, "item").agg(F.max("touched").alias("touched"))
    total = met.groupBy(by).agg(F.count("item").alias("gold_count"), F.count("touched").alias("true_positive"))
    n = results.groupBy(by).agg(F.count("*").alias("predicted_count"))
    rows = total.join(n, by, "left").fillna(0, ["predicted_count"])
    return rows.select(by, "true_positive", "predicted_count", "gold_count", *ratios(F.col("true_positive"), F.col("predicted_count"), F.col("gold_count")))


def ratios(hits: Column, predicted: Column, gold: Column) -> list[Column]:
    """precision, recall and f1 to 4 places; 0 where there is nothing to divide by."""
    p, r = F.when(predicted > 0, hits / predicted).otherwise(0.0), F.when(gold > 0, hits / gold).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [F.round(c, 4).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f, "f1"))]


def relaxed_matches(records: DataFrame, gold: DataFrame, by: str, record: str) -> DataFrame:
    """by, record, gold_id: distinct pairs of a query that share a key, or one's title key holds the other's.

    records (by, record, keys, title) and gold (by, gold_id, keys, title), title as title_key gives it. Titles are compared within a
    query only, where candidates are a bounded list.
    """
    keyed = records.select(by, record, F.explode("keys").alias("k")).join(gold.select(by, "gold_id", F.explode("keys").alias("k")), [by, "k"])
    named = records.select(by, record, "title").join(gold.select(by, "gold_id", F.col("title").alias("other")), by)
    inside = named.filter((F.col("title") != "") & (F.col("other") != "") & (F.col("title").contains(F.col("other")) | F.col("other").contains(F.col("title"))))
    return keyed.select(by, record, "gold_id").union(inside.select(by, record, "gold_id")).distinct()


def hits_at(results: DataFrame, gold: DataFrame, by: str, ks: Sequence[int]) -> DataFrame:
    """by, k, hit (0 or 1): whether any of the first k results matches gold, relaxed."""
    first = relaxed_matches(results, gold, by, "rank").groupBy(by).agg(F.min("rank").alias("first"))
    queries = gold.select(by).distinct().join(first, by, "left").select(by, "first", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return queries.select(by, F.col("k").cast("long").alias("k"), F.coalesce((F.col("first") <= F.col("k")).cast("long"), F.lit(0)).alias("hit"))


def relaxed_sweep(results: DataFrame, strict_results: DataFrame, gold: DataFrame, strict_gold: DataFrame, by: str, ks: Sequence[int] = (1, 2, 3, 5, 10)) -> DataFrame:
    """by, k, hit, and precision, recall, f1 both relaxed and strict, for each k; the strict tables hold the strict keys."""
    out = hits_at(results, gold, by, ks)
    for kind, found, wanted in (("relaxed", results, gold), ("strict", strict_results, strict_gold)):
        parts = [scored_against_gold(found, wanted, by, k).withColumn("k", F.lit(k).cast("long")) for k in ks]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        out = out.join(every.select(by, "k", *[F.col(c).alias(f"{kind}_{c}") for c in ("precision", "recall", "f1")]), [by, "k"], "left")
    return out


def selector_errors(pool: DataFrame, selections: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """by, false_positive, false_negative: chosen rows that aren't gold, and gold in the pool that was judged low or not at all.

    pool (by, paper_id, keys, title), selections (by, paper_id, level), gold (by, gold_id, keys, title). Matching is relaxed.
    """
    good = relaxed_matches(pool, gold, by, "paper_id").select(by, "paper_id").distinct().withColumn("good", F.lit(True))
    marked = good.join(selections.select(by, "paper_id", "level"), [by, "paper_id"], "full_outer")
    chosen, is_gold = F.coalesce(F.col("level").isin("high", "medium"), F.lit(False)), F.coalesce("good", F.lit(False))
    lost = is_gold & (F.col("level").isNull() | F.col("level").isin("low", "irrelevant"))
    return marked.groupBy(by).agg(F.count(F.when(chosen & ~is_gold, 1)).alias("false_positive"), F.count(F.when(lost, 1)).alias("false_negative"))


def micro_scores(rows: DataFrame, hits: str, predicted: str, gold: str) -> DataFrame:
    """One row: precision, recall and f1 of all hits over all results and all gold."""
    sums = rows.agg(*[F.sum(c).alias(c) for c in (hits, predicted, gold)])
    return sums.select(hits, predicted, gold, *ratios(F.col(hits), F.col(predicted), F.col(gold)))


def gold_trace(gold: DataFrame, stages: dict[str, DataFrame], by: str, key: str) -> DataFrame:
    """gold (by, key) with the best rank in each stage's rows (by, key, rank) and the last stage that still has the item."""
    out, last = gold.select(by, key).distinct(), F.lit("absent")
    for name, rows in stages.items():
        out = out.join(rows.groupBy(by, key).agg(F.min("rank").alias(name)), [by, key], "left")
        last = F.when(F.col(name).isNotNull(), name).otherwise(last)
    return out.withColumn("last_stage", last)


def transfer_report(pool: DataFrame, selected: DataFrame, final: DataFrame, gold: DataFrame, by: str, ks: Sequence[int] = (50, 100, 300, 500)) -> DataFrame:
    """by, recall_at_k for each k of the pool, selector_recall, final_transfer: where gold is lost on the way to a result.

    pool, selected and final are (by, rank, keys), gold (by, gold_id, keys). Selector recall is over all gold, the transfer rate over the
    pool's hits. Each list has gold items merged for itself, so all lists are matched in one go, as cases of their own.
    """
    cuts = F.array_compact(F.array(F.lit("pool"), *[F.when(F.col("rank") <= k, f"at{k}") for k in ks]))
    lists = {"pool": cuts, "selected": F.array(F.lit("selected")), "final": F.array(F.lit("final"))}
    case = lambda name: F.to_json(F.struct(F.col(by).alias("of"), name.alias("list")))
    parts = [rows.select(by, "rank", "keys", F.explode(lists[name]).alias("list")) for name, rows in (("pool", pool), ("selected", selected), ("final", final))]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).select(case(F.col("list")).alias("case"), "rank", "keys")
    listed = F.explode(F.array(*map(F.lit, (*lists, *[f"at{k}" for k in ks])))).alias("list")
    wanted = gold.select(by, "gold_id", "keys", listed).select(case(F.col("list")).alias("case"), "gold_id", "keys")
    cases = gold.select(by).distinct().select(by, listed).select(case(F.col("list")).alias("case"), by, "list")
    scored = scored_against_gold(found, wanted, "case").join(cases, "case")
    of = lambda name, c: F.max(F.when(F.col("list") == name, F.col(c)))
    rate = lambda a, b: F.round(F.coalesce(F.when(b > 0, a / b), F.lit(0.0)), 4)
    recalls = [of(f"at{k}", "recall").alias(f"recall_at_{k}") for k in ks]
    hits = lambda name: of(name, "true_positive")
    return scored.groupBy(by).agg(*recalls, rate(hits("selected"), of("pool", "gold_count")).alias("selector_recall"), rate(hits("final"), hits("pool")).alias("final_transfer"))


def overdue(cases: DataFrame, elapsed: str, budget: float) -> DataFrame:
    """One row: cases, and how many took longer than the budget."""
    return cases.agg(F.count("*").alias("cases"), F.count(F.when(F.col(elapsed) > budget, 1)).alias("over_budget"))


def loose_number(c: Column) -> Column:
    """An arXiv number without what URLs, DOIs, file names and versions put around it; null if nothing is left."""
    out = F.lower(F.trim(c))
    for around in (r"^https?://arxiv\.org/(abs|pdf)/", "^arxiv:", r"^10\.48550/arxiv\.", "^10[.]48550/arxiv_", r"\.pdf$", r"v\d+$"):
        out = F.regexp_replace(out, around, "")
    return F.nullif(F.trim(out), F.lit(""))


def vocabulary_gap(results: DataFrame, gold: DataFrame, by: str) -> DataFrame:
    """by, variant, results, rank, found: whether each wording of a request finds its paper, and where.

    results (by, variant, rank, ids (array of identifiers of any kind), title), gold (by, number, name): one paper a case. A number
    matches an identifier that ends in it, or the other way round, or holds it; a title matches one that it holds or that holds it.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    rows = results.join(gold.select(by, loose_number(F.col("number")).alias("_n"), F.nullif(plain(F.col("name")), F.lit("")).alias("_t")), by)
    n = F.col("_n")
    ends = lambda x: F.coalesce(loose_number(x).endswith(n) | n.endswith(loose_number(x)), F.lit(False)) | F.coalesce(F.lower(x).contains(n), F.lit(False))
    title = F.nullif(plain(F.col("title")), F.lit(""))
    named = title.contains(F.col("_t")) | F.col("_t").contains(title)
    met = F.coalesce(F.exists("ids", ends), F.lit(False)) | F.coalesce(named, F.lit(False))
    return rows.groupBy(by, "variant").agg(F.count("*").alias("results"), F.min(F.when(met, F.col("rank"))).alias("rank")).withColumn("found", F.col("rank").isNotNull())


def lost_cases(scored: DataFrame, by: str, hits: str) -> DataFrame:
    """The cases without any hit, of rows per case and setting (by, hits)."""
    return scored.groupBy(by).agg(F.max(hits).alias("best")).filter("best = 0").select(by)


def ablation(settings: dict[str, DataFrame], by: str, metric: str) -> DataFrame:
    """setting, cases, mean, delta (from the setting before) of per-case results (by, metric), in the order of settings."""
    every = None
    for place, (name, rows) in enumerate(settings.items()):
        one = rows.agg(F.countDistinct(by).alias("cases"), F.round(F.avg(metric), 4).alias("mean")).select(F.lit(place).alias("place"), F.lit(name).alias("setting"), "cases", "mean")
        every = one if every is None else every.unionByName(one)
    before = every.select((F.col("place") + 1).alias("place"), F.col("mean").alias("before"))
    return every.join(before, "place", "left").select("setting", "cases", "mean", F.round(F.col("mean") - F.col("before"), 4).alias("delta"))


def at_k(results: DataFrame, gold: DataFrame, by: str, key: str, ks: Sequence[int]) -> DataFrame:
    """by, k, predicted, hits, gold, precision, recall, f1, hit for each query of gold; results have rank from 1.

    gold is (by, key), results (by, key, rank). Metrics are rounded to 4 places.
    """
    totals = gold.groupBy(by).agg(F.countDistinct(key).alias("gold"))
    marked = results.join(gold.select(by, key, F.lit(1).alias("good")).distinct(), [by, key], "left")
    cuts = F.explode(F.array(*map(F.lit, ks))).alias("k")
    within = [F.count(F.when(F.col("rank") <= k, 1)).alias(f"p{k}") for k in ks] + [F.count(F.when((F.col("rank") <= k) & F.col("good").isNotNull(), 1)).alias(f"h{k}") for k in ks]
    counted = totals.join(marked.groupBy(by).agg(*within), by, "left").select("*", cuts)
    pick = lambda c: F.coalesce(*[F.when(F.col("k") == k, F.col(f"{c}{k}")) for k in ks], F.lit(0)).cast("long")
    rows = counted.select(by, F.col("k").cast("long").alias("k"), pick("p").alias("predicted"), pick("h").alias("hits"), F.col("gold"))
    p = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).otherwise(0.0)
    rows = rows.withColumns({"p": p, "r": r})
    f = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    four = lambda c: F.round(c, 4)
    return rows.select(by, "k", "predicted", "hits", "gold", four(F.col("p")).alias("precision"), four(F.col("r")).alias("recall"), four(f).alias("f1"), (F.col("hits") > 0).cast("long").alias("hit"))


def best_k(swept: DataFrame, by: str) -> DataFrame:
    """by, k, f1: the smallest k with the best f1."""
    return swept.groupBy(by).agg(F.max_by("k", F.struct("f1", -F.col("k"))).alias("k"), F.max("f1").alias("f1"))


def averages(swept: DataFrame) -> DataFrame:
    """Per k: micro recall (hits of all over gold of all), macro recall, precision, f1, and the share of queries with a hit."""
    four = lambda c: F.round(c, 4)
    return swept.groupBy("k").agg(
        F.count("*").alias("queries"), four(F.sum("hits") / F.sum("gold")).alias("micro_recall"), four(F.avg("recall")).alias("macro_recall"),
        four(F.avg("precision")).alias("precision"), four(F.avg("f1")).alias("f1"), four(F.avg("hit")).alias("hit_rate"),
    )


def coverage(gold: DataFrame, results: DataFrame, by: str, key: str) -> DataFrame:
    """gold with the best rank at which results have it (null: not found)."""
    best = results.groupBy(by, key).agg(F.min("rank").alias("rank"))
    return gold.join(best, [by, key], "left").select(by, key, F.col("rank"), F.col("rank").isNotNull().alias("matched"))


def drop_reason(gold: DataFrame, most_candidates: int = 300) -> DataFrame:
    """gold (candidate_rank, level, notes, final_rank; null: absent) with the stage that lost each item."""
    late = F.col("candidate_rank").isNull()
    low = F.col("level").isin("low", "irrelevant")
    reason = (
        F.when(late, "source_missing")
        .when((F.col("candidate_rank") > most_candidates) | F.col("level").isNull(), "candidate_rank_too_low")
        .when(low & F.coalesce(F.lower("notes").rlike("downgrade|violation|violated|missing|hallucinated"), F.lit(False)), "evidence_validator_downgrade")
        .when(low, "llm_selector_misjudge")
        .when(F.col("final_rank").isNull(), "dynamic_k_cutoff")
        .otherwise("unknown")
    )
    return gold.withColumn("reason", reason)
