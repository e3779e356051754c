"""Operator 5, language identification by hyperdimensional profiles.

Every letter has a random vector of +-1. A letter trigram's vector binds (multiplies) the first letter's vector
permuted twice, the second's permuted once and the third's as it is; white space and all other characters count as one
blank between words, which has a vector too. A document's vector bundles (adds) its trigrams' vectors; a language's
prototype bundles the unit vectors of its training documents. A document gets the language whose prototype has the largest
cosine with its vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

DIMENSIONS = 512
TRAINING_ROWS = 20_000  # at most about so many training documents a language, chosen by a hash of doc_id
SLICE_CHARS = 200_000
GRAMS, COUNT_CELLS = 16_384, 1 << 21  # trigrams and counts at a time
BLANK = 32
UNKNOWN = "und"


class Profiles:
    """Document vectors; letter vectors depend on the code point alone, so every task makes the same ones."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions, self.letters = dimensions, {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.Generator(np.random.PCG64([code, 7])).integers(0, 2, self.dimensions)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of trigrams, coded as three 21-bit code points."""
        made = np.ones((len(grams), self.dimensions), np.int8)
        for place in range(3):
            codes, at = np.unique((grams >> (21 * (2 - place))) & 0x1FFFFF, return_inverse=True)
            made *= np.stack([np.roll(self.letter(int(c)), 2 - place) for c in codes])[at]
        return made.astype(np.float32)

    def vectors(self, texts: list[str]) -> np.ndarray:
        """One row per text; a row of zeros where a text has no letter."""
        joined = "\0".join([f" {t.lower()} ".replace("\0", " ") for t in texts])
        chars = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        codes, at = np.unique(chars, return_inverse=True)
        letters = np.array([chr(c).isalpha() for c in codes], bool)
        mapped = np.where(letters | (codes == 0), codes, BLANK)[at]
        keep = np.ones(len(mapped), bool)
        keep[1:] = (mapped[1:] != BLANK) | (mapped[:-1] != BLANK)
        mapped = mapped[keep]
        row = np.cumsum(mapped == 0)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        whole = (mapped[:-2] != 0) & (mapped[1:-1] != 0) & (mapped[2:] != 0)
        grams = ((mapped[:-2] << 42) | (mapped[1:-1] << 21) | mapped[2:])[whole]
        if len(grams):
            found, gram = np.unique(grams, return_inverse=True)
            row = row[:-2][whole]
            for low in range(0, len(found), GRAMS):  # neither vectors of grams nor counts grow with the texts
                vectors = self.bound(found[low : low + GRAMS])
                mine = (gram >= low) & (gram < low + GRAMS) if len(found) > GRAMS else slice(None)
                rows, at, step = row[mine], gram[mine] - low, max(1, COUNT_CELLS // len(vectors))
                for first in range(0, len(texts), step):
                    last = min(len(texts), first + step)
                    part = slice(*np.searchsorted(rows, (first, last)))
                    counts = np.bincount((rows[part] - first) * len(vectors) + at[part], minlength=(last - first) * len(vectors))
                    out[first:last] += counts.reshape(last - first, -1).astype(np.float32) @ vectors
        return out

    def slices(self, column: pa.Array) -> Iterator[tuple[int, list[str]]]:
        """(first row, texts) of about SLICE_CHARS characters."""
        first, texts, size = 0, [], 0
        for k, text in enumerate(column.to_pylist()):
            texts.append(text or "")
            size += len(texts[-1])
            if size >= SLICE_CHARS:
                yield first, texts
                first, texts, size = k + 1, [], 0
        if texts:
            yield first, texts


def train(labelled: DataFrame, dimensions: int = DIMENSIONS, rows: int = TRAINING_ROWS) -> dict[str, np.ndarray]:
    """A unit prototype for each language of labelled (doc_id, text, lang). Its size depends on the number of languages only."""
    labelled = labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))])
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions), {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, texts in profiles.slices(batch.column(0)):
                made = profiles.vectors(texts)
                made /= np.maximum(np.linalg.norm(made, axis=1, keepdims=True), 1e-9)
                for k, lang in enumerate(langs[first : first + len(texts)]):
                    sums[lang] = sums.get(lang, 0) + made[k].astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "part"])

    parts = chosen.select("text", "lang").mapInArrow(bundle, "lang string, part array<double>")
    cells = parts.select("lang", F.posexplode("part").alias("at", "x")).groupBy("lang", "at").agg(F.sum(F.round("x", 6).cast("decimal(28,6)")).alias("x"))
    found: dict[str, np.ndarray] = {}
    for r in cells.collect():  # languages x dimensions numbers
        found.setdefault(r.lang, np.zeros(dimensions))[r["at"]] = float(r.x)
    return {k: v / max(np.linalg.norm(v), 1e-9) for k, v in sorted(found.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs (doc_id, text). score is the cosine, mapped from -1..1 to 0..1.

    A text that is null or has no letter gets UNKNOWN and 0, as do all texts if there is no prototype. Ties go to the
    first language by code point. Texts are read whole. Other columns are ignored.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]).astype(np.float32) if names else None

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions)
        for batch in batches:
            langs, scores = [], []
            for _, texts in profiles.slices(batch.column(1)):
                if matrix is None:
                    langs += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                made = profiles.vectors(texts)
                norms = np.linalg.norm(made, axis=1)
                cosine = (made @ matrix.T) / np.maximum(norms, 1e-9)[:, None]
                best = cosine.argmax(1)
                langs += [names[b] if n > 0 else UNKNOWN for b, n in zip(best, norms, strict=True)]
                top = np.clip((1 + cosine[np.arange(len(best)), best]) / 2, 0, 1)
                scores += [float(t) if n > 0 else 0.0 for t, n in zip(top, norms, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def is_held_out() -> Column:
    """Whether crc32 of the id as text leaves 0 by 5; a null id is held out, since it can't be told from others."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs.filter(~is_held_out())))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language_id": op5_language_id}
ORACLE_SQL: dict[str, str] = {}
