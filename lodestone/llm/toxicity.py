"""Operator 9, toxicity by a classifier chain.

Categories are predicted in a fixed order by logistic models over hashed words; the model of a category also sees the
logits of the categories before it. For training, those earlier probabilities are out of fold: each labelled row gets
them from models that were fitted without its fold. Words are runs of letters (a-z after lower-casing, and all bytes
above 127). A category's model uses the FEATURES words with the largest chi-square against its label, and is fitted by
Newton steps with a ridge. The labelled sample's words are counted by the executors, and only the CANDIDATES words of each
category with the largest chi-square over the whole sample come to the driver, with the rows' hits among them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table
from lodestone.llm.wordhash import text_slices, words

CATEGORIES = ("quality", "toxic")
TRAINING_ROWS = 8_000  # labelled rows used for fitting, those with the smallest hash of doc_id
FEATURES, CANDIDATES, FOLDS, RIDGE, LEAST_DOCS = 128, 4096, 5, 0.1, 2
THRESHOLD = 0.3  # on held-out labels: recall 0.98 with no clean document above it
_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


@dataclass
class Link:
    """The model of one category: words (sorted hashes) with weights, weights of earlier logits, bias."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def logits(self, hits: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.clip(hits @ self.weights + before @ self.earlier + self.bias, -30, 30)


def hits(features: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0/1 matrix, rows by features: which of the features a row's words hold."""
    out = np.zeros((len(offsets) - 1, len(features)), np.float64)
    if len(features) and len(hashes):
        at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
        found = np.flatnonzero(features[at] == hashes)
        out[np.searchsorted(offsets, found, "right") - 1, at[found]] = 1
    return out


def fit_link(hashes: np.ndarray, offsets: np.ndarray, before: np.ndarray, y: np.ndarray) -> Link:
    """Fit a category from the distinct words of rows, the earlier logits and labels 0/1."""
    positive, n = y.sum(), len(y)
    if not 0 < positive < n:
        sure = 0.0 if not n else 6.0 if positive else -6.0
        return Link(np.zeros(0, np.uint64), np.zeros(0), np.zeros(before.shape[1]), sure)
    found, at = np.unique(hashes, return_inverse=True)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    df, a = np.bincount(at, minlength=len(found)).astype(float), np.bincount(at, weights=y[rows], minlength=len(found))
    b, c, d = df - a, positive - a, n - df - positive + a
    chi = np.where(df >= LEAST_DOCS, n * (np.abs(a * d - b * c) - np.minimum(n / 2, np.abs(a * d - b * c))) ** 2 / np.maximum(df * (n - df) * positive * (n - positive), 1e-9), -1)
    best = np.lexsort((found, -chi))[:FEATURES]
    features = np.sort(found[best[chi[best] > 0]])
    x = np.column_stack([hits(features, hashes, offsets), before / 4, np.ones(n)])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    k = len(features)
    return Link(features, w[:k], w[k:-1] / 4, float(w[-1]))


def fit_chain(hashes: np.ndarray, offsets: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[Link]:
    """labels: rows by categories, NaN where unknown. Later links are trained with out-of-fold logits of earlier ones."""
    chain, before = [], np.zeros((len(labels), 0))
    for category in range(labels.shape[1]):
        y = labels[:, category]
        known = ~np.isnan(y)
        out_of_fold = np.zeros(len(y))
        for fold in range(FOLDS):
            link = fit_link(*_rows(hashes, offsets, known & (folds != fold)), before[known & (folds != fold)], y[known & (folds != fold)])
            held = folds == fold
            out_of_fold[held] = link.logits(hits(link.features, *_rows(hashes, offsets, held)), before[held])
        chain.append(fit_link(*_rows(hashes, offsets, known), before[known], y[known]))
        before = np.column_stack([before, out_of_fold])
    return chain


def _rows(hashes: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(offsets)
    return hashes[np.repeat(mask, sizes)], np.concatenate(([0], np.cumsum(sizes[mask])))


def letter_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, row offsets) for slices of a text column."""
    for first, data, offsets in text_slices(column):
        yield (first, *words(_LETTERS[data], offsets))


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CATEGORIES, rows: int = TRAINING_ROWS) -> list[Link]:
    """The chain from docs (doc_id, text) and labels (doc_id and one 0/1 column a category, null where unknown).

    The sample is at most `rows` labelled documents, those with the smallest hash of doc_id, then doc_id, then words, so
    it is the same on every run. What comes to the driver is bounded by rows and CANDIDATES, however long texts are.
    """
    known = labels.select("doc_id", *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)]).filter("doc_id IS NOT NULL")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most `rows` ids and labels
    ys = [f"y{k}" for k in range(len(categories))]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[bytes] = []
            for _, hashes, offsets in letter_words(batch.column(1)):
                found += [np.unique(hashes[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *batch.columns[2:]], ["doc_id", "words", *ys])

    held = joined.mapInArrow(features, f"doc_id long, words binary, {', '.join(f'{y} double' for y in ys)}")
    held = held.orderBy(F.xxhash64("doc_id"), "doc_id", F.sha2("words", 256)).limit(rows)
    held = materialize(held.repartition(max(1, rows // 500)), "labelled")

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = np.frombuffer(batch.column(1)[row].as_py(), np.int64)
                for at in range(0, len(found), 1 << 16):
                    part = found[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.repeat(c[row], len(part)) for c in batch.columns[2:])], ["word", *ys])

    totals = held.agg(*[F.count(y).alias(f"n{y}") for y in ys], *[F.coalesce(F.sum(y), F.lit(0)).alias(f"p{y}") for y in ys]).first()
    counted = held.mapInArrow(words_of, f"word long, {', '.join(f'{y} double' for y in ys)}").groupBy("word")
    counted = materialize(counted.agg(*[F.count(y).alias(f"n{y}") for y in ys], *[F.coalesce(F.sum(y), F.lit(0)).alias(f"p{y}") for y in ys]), "counted")
    chosen: set[int] = set()
    for y in ys:
        n, p, df, a = float(totals[f"n{y}"]), float(totals[f"p{y}"]), F.col(f"n{y}"), F.col(f"p{y}")
        off = F.abs(a * n - df * p)  # ad - bc
        chi = n * F.pow(off - F.least(F.lit(n / 2), off), F.lit(2.0)) / F.greatest(df * (n - df) * p * (n - p), F.lit(1e-9))
        best = counted.filter(df >= LEAST_DOCS).orderBy(F.desc(chi), "word").limit(CANDIDATES).select("word").collect()
        chosen |= {r.word for r in best}
    every = np.sort(np.array(sorted(chosen), np.int64).view(np.uint64))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.intersect1d(np.frombuffer(w, np.uint64), every, assume_unique=True).tobytes() for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *batch.columns[2:]], batch.schema.names)

    got = held.mapInArrow(within, held.schema).collect()  # at most rows times the candidate words
    got.sort(key=lambda r: (r.doc_id, bytes(r.words)))
    sets = [np.frombuffer(r.words, np.uint64) for r in got]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    y = np.array([[np.nan if v is None else v for v in r[2:]] for r in got], float).reshape(len(got), len(categories))
    return fit_chain(np.concatenate([*sets, np.zeros(0, np.uint64)]), offsets, y, np.array([r.doc_id % FOLDS for r in got], int))


def score(docs: DataFrame, chain: list[Link], categories: Sequence[str] = CATEGORIES, keep: Sequence[str] = (), prefix: str = "p_") -> DataFrame:
    """doc_id, one probability column <prefix><category> a category, and the columns named by keep, for each row of docs (doc_id, text).

    Null and empty texts have no words and get the models' biases. Whole texts are read; repeated rows are scored alike.
    """
    names = [f"{prefix}{c}" for c in categories]
    kept = docs.select("doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")])
    out = ["doc_id", *(["text"] if "text" in keep else []), *kept.columns[2:]]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, hashes, offsets in letter_words(batch.column(1)):
                before = np.zeros((len(offsets) - 1, 0))
                for link in chain:
                    before = np.column_stack([before, link.logits(hits(link.features, hashes, offsets), before)])
                parts.append(1 / (1 + np.exp(-before)))
            p = np.concatenate(parts) if parts else np.zeros((0, len(chain)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), *(pa.array(p[:, k]) for k in range(len(chain)))], [*out, *names])

    schema = ", ".join([f"`{c}` {dict(kept.dtypes)[c]}" for c in out] + [f"`{c}` double" for c in names])
    return kept.mapInArrow(predict, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    toxic = F.col("p_toxic") >= THRESHOLD
    return scored.select("doc_id", F.col("p_quality").alias("quality_score"), F.col("p_toxic").alias("toxicity_score"), toxic.alias("toxic"), (~toxic).alias("kept"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE_SQL: dict[str, str] = {}
