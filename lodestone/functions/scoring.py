"""Scores and calibrations as Column expressions. Weights and limits are parameters with their usual values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Weights, level scores and level ranges.
PRERANK_WEIGHTS = {"title": 0.18, "constraint": 0.28, "source": 0.12, "route": 0.10, "citation": 0.08, "recency": 0.04, "dense": 0.12, "sparse": 0.08}
FINAL_WEIGHTS = {"level": 0.22, "prerank": 0.18, "dense": 0.14, "constraint": 0.15, "source": 0.10, "evidence": 0.09, "recency": 0.04, "authority": 0.03, "graph": 0.05}
LISTWISE_WEIGHTS = {"listwise": 0.50, "level": 0.15, "constraint": 0.12, "evidence": 0.08, "source": 0.05, "dense": 0.04, "recency": 0.02, "authority": 0.02, "graph": 0.02}
LEVELS = {"high": 1.0, "medium": 0.55, "low": 0.15}
LABELS = {"gold": (1.0, 1.0), "strong_related": (0.9, 1.0), "medium_core": (0.55, 0.70), "bridge": (0.35, 0.50), "weak": (0.0, 0.20)}  # least and most
LEVEL_RANGES = {"high": (0.80, 0.95), "medium": (0.40, 0.70), "low": (0.08, 0.25), "irrelevant": (0.0, 0.08)}
OTHER_RANGE = (0.0, 0.1)
# Words of biomedical advances, and the strong ones among them.
ADVANCES = ("rna", "microrna", "mrna", "pd-1", "immune checkpoint", "targeted therap", "molecular testing", "precision oncology")
STRONG_ADVANCES = ("rna therap", "microrna mimic", "pd-1 blockade", "molecular testing")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def citation_score(count: Column, full: float = 500.0) -> Column:
    return F.coalesce(F.least(F.log1p(F.greatest(F.lit(0), count).cast("double")) / F.log1p(F.lit(full)), F.lit(1.0)), F.lit(0.0))


def recency_score(year: Column, base: int = 2026, a_year: float = 0.08, unknown: float = 0.4) -> Column:
    return F.when(year.isNull(), F.lit(unknown)).otherwise(F.greatest(F.lit(0.0), 1 - a_year * F.greatest(F.lit(0), base - year)))


def prerank_score(features: Mapping[str, Column], weights: Mapping[str, float] = PRERANK_WEIGHTS) -> Column:
    """Weighted mean of the features that are there, each held within 0..1: missing ones give up their weight."""
    features = {k: F.when(v.isNotNull(), clamp(v)) for k, v in features.items()}  # least and greatest pass over nulls
    total = sum((F.when(features[k].isNotNull(), F.lit(w)).otherwise(0.0) for k, w in weights.items() if k in features), F.lit(0.0))
    score = sum((F.coalesce(features[k] * w, F.lit(0.0)) for k, w in weights.items() if k in features), F.lit(0.0))
    return F.when(total > 0, score / total).otherwise(0.0)


def level_score(level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in LEVELS.items()], F.lit(0.0))


def final_subscores(of: Mapping[str, Column]) -> dict[str, Column]:
    """The parts of a final score. of: level, label, dense, vector, matched, missing (constraint counts), evidence (support or score), quotes
    (number of evidence texts), path, year, citations, linked (cites or is cited within the pool), listwise, prerank. Any may be left out.
    """
    get = lambda k, kind="double": of[k] if k in of else F.lit(None).cast(kind)
    level, label, path = get("level", "string"), get("label", "string"), get("path", "array<string>")
    good = F.coalesce(level.isin("high", "medium"), F.lit(False))
    relevance = F.coalesce(*[F.when(label == k, F.least(F.lit(most), F.greatest(F.lit(least), level_score(level)))) for k, (least, most) in LABELS.items()], level_score(level))
    matched, all_of = F.coalesce(get("matched"), F.lit(0)), F.coalesce(get("matched"), F.lit(0)) + F.coalesce(get("missing"), F.lit(0))
    evidence = get("evidence")
    routes = F.coalesce(F.size(path), F.lit(0))
    return {
        "level": relevance,
        "dense": F.coalesce(get("dense"), get("vector"), F.lit(0.0)),
        "constraint": F.when(all_of > 0, matched / all_of).when(good, 1.0).otherwise(0.5),
        "evidence": F.when(evidence > 0, clamp(evidence)).when(good & (F.coalesce(get("quotes"), F.lit(0)) > 0), 1.0).otherwise(0.0),
        "source": F.when(routes > 0, F.least(routes / 2, F.lit(1.0))).otherwise(0.5),
        "recency": F.when(get("year").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - 0.1 * (2026 - get("year")))),  # later years exceed 1
        "authority": F.coalesce(F.when(get("citations").isNotNull(), F.least(get("citations") / 100, F.lit(1.0))), F.lit(0.0)),
        "graph": F.when(F.coalesce(get("linked", "boolean"), F.lit(False)), 1.0).otherwise(0.0),
        "listwise": F.coalesce(get("listwise"), F.lit(0.0)),
        "prerank": clamp(F.coalesce(get("prerank"), F.lit(0.0))),
    }


def title_bonus(path: Column) -> Column:
    """What a hit by title adds to the final score."""
    on = lambda part: F.coalesce(F.exists(path, lambda p: p.contains(part)), F.lit(False))
    return F.when(on("title_exact"), 0.10).when(on("title_like"), 0.03).otherwise(0.0)


def biomedical_bonus(path: Column, level: Column, text: Column) -> Column:
    """What a hit on the biomedical route adds where its text names an advance."""
    low = F.lower(text)
    any_of = lambda words: F.coalesce(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), F.lit(False))
    routed = F.coalesce(F.exists(path, lambda p: p.contains("route:biomedical")), F.lit(False))
    high, medium = ((F.when(any_of(STRONG_ADVANCES), a + b).otherwise(a)) for a, b in ((0.08, 0.10), (0.04, 0.05)))
    return F.when(routed & any_of(ADVANCES), F.when(level == "high", high).when(level == "medium", medium)).otherwise(0.0)


def paper_score(parts: Mapping[str, Column], titles: Column, biomedical: Column | None = None, cap: Column | None = None) -> Column:
    """The final score of subscores: the listwise weights where a listwise score is above 0, else the others; within 0..1 and the cap."""
    biomedical = F.lit(0.0) if biomedical is None else F.coalesce(biomedical, F.lit(0.0))
    led, plain = (sum((parts[k] * w for k, w in weights.items()), titles) for weights in (LISTWISE_WEIGHTS, FINAL_WEIGHTS))
    score = clamp(F.when(parts["listwise"] > 0, led).otherwise(plain + biomedical))
    return score if cap is None else F.when(cap.isNotNull(), F.least(score, clamp(cap))).otherwise(score)


def dense_of_pool(dense: Column, vector: Column, by: str) -> Column:
    """The dense score, or the vector score over the largest positive one of the query's rows without a dense score (at most 1)."""
    best = F.max(F.when(dense.isNull() & (vector > 0), vector)).over(Window.partitionBy(by))
    return F.coalesce(dense, F.when(vector.isNotNull() & best.isNotNull(), F.least(vector / best, F.lit(1.0))))


def year_broken(year: Column, first: Column, last: Column) -> Column:
    """Whether a year lies outside first..last; an unknown year or end breaks nothing."""
    return F.coalesce(year < first, F.lit(False)) | F.coalesce(year > last, F.lit(False))


def logistic(score: Column, midpoint: float = 0.5, temperature: float = 0.12) -> Column:
    return 1 / (1 + F.exp(-(score - midpoint) / temperature))


def level_of_score(score: Column, high: float = 0.50, medium: float = 0.20, low: float = 0.08) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low").otherwise("irrelevant")


def calibrated(prior: Column, level: Column, local: Column, signals: Column, confidence: Column | None = None) -> Column:
    """Probability of relevance from a model's prior and the mean of local signals, held near its level's range.

    The middle of the level's range stands for a missing prior or mean. Fewer than two signals trust the prior more. A prior (without
    one, the fused value) under 0.35 cools low, medium and unknown levels. Low and irrelevant levels have a ceiling.
    """
    edge = lambda k: F.coalesce(*[F.when(level == name, F.lit(r[k])) for name, r in LEVEL_RANGES.items()], F.lit(OTHER_RANGE[k]))
    middle = (edge(0) + edge(1)) / 2
    alpha = F.lit(0.55) if confidence is None else F.when(confidence.isNull(), 0.55).otherwise(clamp(0.3 + 0.4 * confidence, 0.3, 0.8))
    alpha = F.when(F.coalesce(signals, F.lit(0)) < 2, F.greatest(alpha, F.lit(0.65))).otherwise(alpha)
    fused = alpha * F.coalesce(prior, middle) + (1 - alpha) * F.coalesce(local, middle)
    held = F.least(F.lit(1.0), edge(1) + 0.05, F.greatest(F.lit(0.0), edge(0) - 0.05, fused))
    cool = (F.coalesce(prior, held) < 0.35) & F.coalesce(level.isin("low", "medium", "unknown"), F.lit(True))
    held = F.when(cool, F.greatest(F.lit(0.0), F.least(held, F.lit(0.30), 1.15 * prior, edge(1) + 0.05))).otherwise(held)  # least passes over a null prior
    held = F.when(level == "low", F.least(held, F.lit(0.15))).when(level == "irrelevant", F.least(held, F.lit(0.05))).otherwise(held)
    return F.round(held, 4)


def validated_level(level: Column, failed: Column, notes: Column, year_noted: Column, evidence: Column, coverage: Column, has_constraints: Column, is_fallback: Column) -> Column:
    """The level after evidence checks; then weak evidence pushes high to medium and medium to low.

    failed: checks that failed now. One takes the level down a step, low to irrelevant. With notes from before (`notes` of
    them) two in all, or a note on a year (`year_noted`), make it low, even where it was irrelevant.
    """
    down = F.when(level == "high", "medium").when(level == "medium", "low").when(level == "low", "irrelevant").otherwise(level)
    first = F.when(failed == 0, level).when((failed + notes >= 2) | year_noted, F.lit("low")).otherwise(down)
    weak_high = ~is_fallback & (evidence < 0.5) | has_constraints & (coverage < 0.5)
    second = F.when((first == "high") & weak_high, "medium").otherwise(first)
    weak_medium = ~is_fallback & ((evidence < 0.2) | (coverage < 0.25) & (evidence < 0.5))
    return F.when((second == "medium") & weak_medium, "low").otherwise(second)


def constraint_coverage(text: Column, text_tokens: Column, constraints: Column, tokenizer) -> Column:
    """Share of constraints that the text holds literally or by stemmed words; 0.5 if there are none."""
    met = F.filter(constraints, lambda c: F.lower(text).contains(F.lower(c)) | (F.size(F.array_except(tokenizer(c), text_tokens)) == 0) & (F.size(tokenizer(c)) > 0))
    return F.when(F.size(constraints) > 0, F.size(met) / F.size(constraints)).otherwise(0.5)


def source_agreement(path: Column, full: int = 3) -> Column:
    providers = F.array_distinct(F.filter(path, lambda p: p.startswith("provider:")))
    return F.least(F.size(providers) / full, F.lit(1.0))


def route_prior(path: Column) -> Column:
    any_of = lambda part: F.exists(path, lambda p: p.contains(part))
    title = F.when(any_of("title_exact"), 0.20).when(any_of("title_like"), 0.06).otherwise(0.0)
    links = sum((F.when(any_of(k), v).otherwise(0.0) for k, v in (("citation_expansion", 0.04), ("reference_expansion", 0.03), ("related_work_expansion", 0.03))), F.lit(0.0))
    return F.least(F.lit(0.25), title + links)


# Words that a constraint's core goes without, and names that stand for one another.
CORE_STOPWORDS = ("the", "a", "an", "of", "and", "in", "to", "for", "with", "on", "at", "by", "from", "that", "this", "these", "those", "language", "model", "models")
SYNONYMS = {
    "llm": ("llm", "llms", "large language model", "large language models", "foundation model", "foundation models"),
    "nlp": ("nlp", "natural language processing"),
    "multilingual": ("multilingual", "multi-lingual", "cross-lingual", "crosslingual"),
    "cross-lingual": ("multilingual", "multi-lingual", "cross-lingual", "crosslingual"),
    "contrastive learning": ("contrastive learning", "contrastive loss", "contrastive pretraining", "contrastive pre-training"),
}


def squeezed(c: Column) -> Column:
    """Letters, digits and Chinese characters only, in lower case."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9\\u4e00-\\u9fff]+", "")


def constraint_met(text: Column, constraint: Column, synonyms: Mapping[str, Sequence[str]] = SYNONYMS) -> Column:
    """Whether a text holds a constraint: squeezed as it is, by all its core words in any order, or by a synonym of a name in it."""
    held, words = squeezed(text), F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w+\b"), F.lit(0))
    core = F.filter(F.regexp_extract_all(F.lower(constraint), F.lit(r"(?U)\b\w{3,}\b"), F.lit(0)), lambda w: ~w.isin(*CORE_STOPWORDS))
    of_name = [F.lower(constraint).contains(k) & reduce(lambda a, b: a | b, [held.contains(squeezed(F.lit(v))) for v in vs]) for k, vs in synonyms.items()]
    met = (squeezed(constraint) == "") | held.contains(squeezed(constraint)) | (F.size(core) > 0) & (F.size(F.array_except(core, words)) == 0)
    return F.coalesce(reduce(lambda a, b: a | b, of_name, met), F.lit(False))


def plan_coverage(wanted: Column, matched: Column, level: Column) -> Column:
    """The share of a plan's constraints that a selection's matched ones cover, either holding the other; without constraints by level."""
    asked, got = F.array_distinct(F.filter(wanted, lambda c: c != "")), F.transform(matched, lambda c: F.lower(c))
    met = F.filter(asked, lambda c: F.exists(got, lambda m: m.contains(F.lower(c)) | F.lower(c).contains(m)))
    return F.when(F.size(asked) > 0, F.size(met) / F.size(asked)).when(level.isin("high", "medium"), 1.0).otherwise(0.3)


def paper_text(title: Column, abstract: Column, concepts: Column, venue: Column, path: Column) -> Column:
    """All that evidence may be quoted from: title, abstract, concepts, venue and the words of the routes."""
    return F.concat_ws(" ", title, abstract, concepts, venue, F.transform(path, lambda p: F.translate(p, "._", "  ")))


def evidence_ratio(quotes: Column, text: Column) -> Column:
    """The share of quoted texts that stand in a paper's text, case aside; 0 if there are none."""
    found = F.filter(quotes, lambda q: (F.trim(F.lower(q)) != "") & F.lower(text).contains(F.trim(F.lower(q))))
    return F.when(F.size(quotes) > 0, F.size(found) / F.size(quotes)).otherwise(0.0)
