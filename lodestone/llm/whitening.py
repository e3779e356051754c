"""Embedding whitening: scatters of partitions merged pairwise (Chan), eigenvectors on the driver, a second pass as proof."""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
LARGEST = float(1 << 45)  # of |64 * entry|: beyond, a float64 sum of a partition would no longer be exact
DEPTH = 3  # of the tree of merges
SCHEMA = "vec_id {0}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array<long>, floor(64 * entry) + 1000000) of the rows whose vector is not null and holds finite numbers only."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.filter(F.col("embedding").isNotNull()).filter(finite)
    whole = lambda c: F.floor(c.cast("double") * SCALE)
    checked = lambda c: F.when(F.abs(c.cast("double")) * SCALE < LARGEST, whole(c) + SHIFT).otherwise(F.raise_error(F.lit("entry too large to whiten")).cast("long"))
    return kept.select("vec_id", F.transform("embedding", checked).alias("x"))


@dataclass
class Moments:
    """Count, exact sums, mean and centred scatter of some rows; `mean` and `scatter` are those of x minus SHIFT."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(y: np.ndarray) -> Moments:
        mean = y.mean(axis=0)
        centred = y - mean
        sums = [int(s) for s in y.sum(axis=0)] if np.issubdtype(y.dtype, np.integer) else []
        return Moments(len(y), sums, mean, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        """Chan, Golub and LeVeque's pairwise formula."""
        if len(self.mean) != len(other.mean):
            raise ValueError("vectors differ in length")
        n, gap = self.n + other.n, other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + gap * (other.n / n), scatter)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column as integers about 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(ends)
    if len(lengths) and lengths.min() != lengths.max():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1).astype(np.int64) - SHIFT


def moments(vectors: DataFrame, projected=lambda y: y) -> Moments | None:
    """Moments of all rows of x (projected): one state a partition, merged in a tree. None without rows."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                found = Moments.of(projected(matrix(batch.column(0))))
                state = state.merged(found) if state else found
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    states = vectors.select("x").mapInArrow(partial, "state binary").rdd.map(lambda r: pickle.loads(r.state))
    return states.treeAggregate(None, _either, _either, DEPTH)


def _either(a: Moments | None, b: Moments | None) -> Moments | None:
    return a.merged(b) if a and b else a or b


@dataclass
class Whitening:
    """What turns y = x - SHIFT into whitened entries: (n * y - sums) / n @ weights."""

    n: int
    sums: list[int]
    weights: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def gaps(self, y: np.ndarray) -> np.ndarray:
        """n * x - S, exact; Python integers where 64 bits may not hold them."""
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        return y.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def deviations(self, gaps: np.ndarray) -> list[int]:
        most = int(np.abs(gaps).max(initial=0))
        if most * most * max(1, gaps.shape[1]) >= 1 << 63:
            gaps = gaps.astype(object)
        found = (gaps * gaps).sum(axis=1)
        if len(found) and int(max(found)) >= 1 << 63:
            raise OverflowError("a deviation does not fit 64 bits")
        return [int(v) for v in found]

    def whitened(self, gaps: np.ndarray) -> np.ndarray:
        return (gaps / self.n).astype(np.float64) @ self.weights


def fitted(vectors: DataFrame, components: int) -> Whitening | None:
    """Whitening by the rows of x, which are distinct; None where there are none. The second pass measures its error."""
    first = moments(vectors)
    if first is None:
        return None
    covariance = first.scatter / first.n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(values)[::-1]
    values, axes = values[order], axes[:, order]
    rank = int((values > max(values[0], 0) * len(values) * np.finfo(float).eps).sum()) if len(values) else 0
    kept = min(components, rank)
    total = float(np.trace(covariance))
    found = Whitening(first.n, first.sums, axes[:, :kept] / np.sqrt(values[:kept]), values[:kept] / total if kept else np.zeros(0))
    if kept:
        second = moments(vectors, lambda y: found.whitened(found.gaps(y)))
        found.identity_error = float(np.abs(second.scatter / second.n - np.eye(kept)).max())
    return found


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every usable row and component.

    Fitted on the distinct integer vectors. Rows whose vector is null or holds null or non-finite entries are left out; a
    null vec_id and repeated rows stay. Components whose eigenvalue is zero to double precision cannot be whitened and are
    left out, so equal, single or empty vectors give no rows; of equal eigenvalues any orthogonal axes are right. Vectors
    of different lengths, entries of 2**39 or more and deviations beyond 64 bits are errors. Other columns are ignored.

    A task holds one scatter, 8 bytes a pair of dimensions, and so does the driver (32 KB for 64 dimensions). Nothing else
    is gathered; copies are merged by partial aggregates before they are shuffled.
    """
    usable = integer_vectors(vectors)
    fit = materialize(usable.select("x").distinct(), "fit")
    ddl = SCHEMA.format(vectors.schema["vec_id"].dataType.simpleString())
    spark, found = vectors.sparkSession, fitted(fit, components)
    if found is None or not found.weights.size:
        return spark.createDataFrame([], ddl)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = len(found.explained)
        for batch in batches:
            if not batch.num_rows:
                continue
            gaps, count = found.gaps(matrix(batch.column(1))), batch.num_rows
            each = np.repeat(np.arange(count), kept)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, kept + 1), count), pa.int32()),
                    pa.array(np.full(count * kept, found.n), pa.int64()),
                    pa.array(found.deviations(gaps), pa.int64()).take(pa.array(each)),
                    pa.array(found.whitened(gaps).ravel()),
                    pa.array(np.tile(found.explained, count)),
                    pa.array(np.full(count * kept, found.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return usable.mapInArrow(rows, ddl)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLE_SQL: dict[str, str] = {}
