"""Stored vectors in blocks around centres, searched exactly: a block is skipped where no vector in it can reach the k-th score.

    path/vectors/block=B   vec_id, embedding
    path/blocks            block, n, radius, centre; written last
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.search import ranked
from lodestone.operators.vectors import BLOCK, QUERY_BLOCK, best_of_cell

MOST_BLOCKS = 4096  # blocks of one index; their centres are all that every task is sent
SAMPLE = 20_000  # vectors that centres are found on; every vector is stored whatever they are
ROUNDS = 8
PAIRS = 8_192  # pairs of query and block that a task makes at once


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def whole(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """Rows with an id and a vector of finite numbers, of one width if it is given."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.filter(F.col("embedding").isNotNull()).filter(finite)
    return kept if width is None else kept.filter(F.size("embedding") == width)


def centres_of(sample: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k centres by Lloyd's rounds; a centre that loses all its vectors keeps its place."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = nearest(sample, centres)[0]
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and its distance, computed from the difference itself."""
    scores = rows @ centres.T - (centres**2).sum(1) / 2
    near = scores.argmax(1)
    return near, np.sqrt(((rows - centres[near]) ** 2).sum(1))


def write_blocks(vectors: DataFrame, path: str, blocks: int | None = None) -> int:
    """Store vectors (vec_id, embedding) and return how many blocks they make. Rows without a whole vector are left out.

    Centres are found on SAMPLE vectors; sqrt(n) of them by default. A centre's vectors are cut into parts of BLOCK, so a third of
    all vectors around one centre are many blocks. Vectors of a length other than the first's are an error.
    """
    spark, kept = vectors.sparkSession, whole(vectors.select("vec_id", "embedding").filter("vec_id IS NOT NULL"))
    n = kept.count()
    if not n:
        return 0
    chosen = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0)
    sample = np.array(chosen.to_pylist(), dtype=np.float64)
    centres = centres_of(sample, min(blocks or ceil(sqrt(n)), MOST_BLOCKS))
    sent, kind = spark.sparkContext.broadcast(centres), dict(kept.dtypes)["vec_id"]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(1))
                if rows.shape[1] != sent.value.shape[1]:
                    raise ValueError("vectors differ in length")
                near, far = nearest(rows, sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32)), pa.array(far)], ["vec_id", "embedding", "centre", "far"])

    placed = kept.mapInArrow(assign, f"vec_id {kind}, embedding {dict(kept.dtypes)['embedding']}, centre int, far double")
    placed.write.mode("overwrite").parquet(f"{path}/placed")
    placed = spark.read.parquet(f"{path}/placed")
    sizes = placed.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))  # at most MOST_BLOCKS rows
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    parted = placed.join(F.broadcast(sizes), "centre").withColumn("block", F.concat_ws("-", "centre", part))
    parted.select("block", "vec_id", "embedding").repartitionByRange("block", "vec_id").write.mode("overwrite").partitionBy("block").parquet(f"{path}/vectors")
    stats = parted.groupBy("block", "centre").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    listed = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "centre int, middle array<double>")
    stats = stats.join(F.broadcast(listed), "centre").select("block", "n", "radius", "middle")
    stats.write.mode("overwrite").parquet(f"{path}/blocks")
    return spark.read.parquet(f"{path}/blocks").count()


class Bounds:
    """What every task knows of the blocks: no vector of block b scores above q . centre + |q| radius."""

    def __init__(self, stats: list) -> None:
        self.names = [r.block for r in stats]
        self.middles = np.array([r.middle for r in stats])
        self.radii = np.array([r.radius for r in stats])
        self.sizes = np.array([r.n for r in stats])

    def of(self, asked: np.ndarray) -> np.ndarray:
        bound = asked @ self.middles.T + np.sqrt((asked**2).sum(1))[:, None] * self.radii
        return bound + 1e-9 * (1 + np.abs(bound))

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """The blocks of highest bound that hold k vectors and one more (the query's own) together."""
        order = np.argsort(-bounds, kind="stable")
        return order[: 1 + int(np.searchsorted(np.cumsum(self.sizes[order]), k + 1))]


def chosen(known: Bounds, batch: pa.RecordBatch, k: int, digits: int, first: bool) -> Iterator[pa.RecordBatch]:
    """query_id, asked, part, block of a batch's queries and the blocks that each one meets; a few queries at a time, so that at most about PAIRS rows are made at once."""
    step = max(1, PAIRS // len(known.names))
    for start in range(0, batch.num_rows, step):
        some = batch.slice(start, step)
        floors = None if first else some.column(3).to_numpy(zero_copy_only=False)
        rows, blocks = [], []
        for at, bound in enumerate(known.of(_matrix(some.column(1)))):
            now = known.first(bound, k)
            if not first:
                now = np.setdiff1d(np.flatnonzero(bound >= floors[at] - 10.0**-digits), now)
            rows.append(np.full(len(now), at))
            blocks += [known.names[b] for b in now]
        taken = some.select(["query_id", "asked", "part"]).take(pa.array(np.concatenate(rows).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(blocks, pa.string())], ["query_id", "asked", "part", "block"])


def search_blocks(spark: SparkSession, queries: DataFrame, path: str, k: int, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, vec_id, score), (query_id, block): the k best stored vectors of each query (query_id, embedding) but itself,
    and the blocks that were scored for it. Scores and ties are those of vectors.similar().

    First each query meets its most promising blocks; its k-th score there is then held against the bound of every other block, and
    those that may still reach it are scored too. Queries without a whole vector, or of another length, get no rows.
    """
    bounds = Bounds(spark.read.parquet(f"{path}/blocks").collect())  # at most some thousand rows
    queries = whole(queries.filter("query_id IS NOT NULL"), bounds.middles.shape[1]).select("query_id", F.col("embedding").alias("asked"))
    parts = max(1, ceil(queries.count() / QUERY_BLOCK))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    sent, kinds = spark.sparkContext.broadcast(bounds), dict(queries.dtypes)
    vectors = spark.read.parquet(f"{path}/vectors").withColumn("block", F.col("block").cast("string"))
    pairs_ddl = f"query_id {kinds['query_id']}, asked {kinds['asked']}, part int, block string"

    def met(first: bool):
        return lambda batches: (pairs for batch in batches for pairs in chosen(sent.value, batch, k, digits, first))

    def scored(pairs: DataFrame) -> DataFrame:
        dealt = vectors.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        cells = pairs.groupBy("block", "part").cogroup(dealt.join(pairs.select("block", "part").distinct(), ["block", "part"], "left_semi").groupBy("block", "part"))
        found = cells.applyInArrow(lambda q, c: best_of_cell(q, c, k, None, digits), f"query_id {kinds['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, score double")
        return ranked(found.select("query_id", "vec_id", F.round("score", digits).alias("score")), ["query_id"], [F.desc("score"), "vec_id"], k)

    near = queries.mapInArrow(met(True), pairs_ddl)
    best = scored(near).drop("rank").checkpoint()
    floor = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(float("-inf")).alias("floor"))
    rest = queries.join(floor, "query_id", "left").fillna(float("-inf"), "floor").select("query_id", "asked", "part", "floor").mapInArrow(met(False), pairs_ddl)
    found = ranked(best.unionByName(scored(rest).drop("rank")), ["query_id"], [F.desc("score"), "vec_id"], k)
    return found.select("query_id", "rank", "vec_id", "score"), near.unionByName(rest).select("query_id", "block")
