"""Operator 4, exact top-k search by exhaustive term-at-a-time accumulation.

A dimension is a term; a vector is a sparse row of integer weights, floor(SCALE * x). Candidates and queries are dealt
into blocks by a hash of their ids, and every (query block, candidate block) cell is one group of bounded size. In a
cell each query block walks its terms: a term's postings (candidates with a weight there) are scattered, times the
queries' weights, into dense score arrays. Partition selection keeps a query's best of the cell, ties included; the
cells' bests are merged by a window over k rows a cell.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table

SCALE = 256
K = 5
CANDIDATES_A_BLOCK, QUERIES_A_BLOCK = 65_536, 16_384  # at most; also bounded by WEIGHTS_A_BLOCK numbers
WEIGHTS_A_BLOCK, LEAST_BLOCK = 1 << 22, 4096
LARGEST_WEIGHT = 2.0**53
SCORE_CELLS = 1 << 20  # of a dense score array


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id and weights (long array) of usable rows: id and vector not null, all components finite. Repeated rows count once;
    of different vectors under one id the least counts. A weight beyond LARGEST_WEIGHT either way is an error: it would not be exact."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    usable = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(F.coalesce(finite, F.lit(False)))
    too_large = F.raise_error(F.lit("a component times SCALE is beyond LARGEST_WEIGHT")).cast("long")
    weights = F.transform(x, lambda v: F.when(F.abs(v * SCALE) > LARGEST_WEIGHT, too_large).otherwise(F.floor(v * SCALE).cast("long")))
    return usable.select(F.col("vec_id").cast("long").alias("vec_id"), weights.alias("weights")).groupBy("vec_id").agg(F.min("weights").alias("weights"))


def dense(column: pa.ChunkedArray, terms: int) -> np.ndarray:
    out = np.zeros((len(column), terms), np.int64)
    sizes = np.array([len(v) for v in column], np.int64)
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best_of_cell(queries: pa.Table, candidates: pa.Table, k: int) -> pa.Table:
    terms = max((len(v) for t in (queries, candidates) for v in t.column("weights")), default=0)
    candidates = candidates.sort_by("vec_id")
    ids = candidates.column("vec_id").to_numpy()
    query_ids, query_weights = queries.column("vec_id").to_numpy(), dense(queries.column("weights"), terms)
    weights = dense(candidates.column("weights"), terms)
    largest = terms * int(np.abs(weights).max(initial=0)) * int(np.abs(query_weights).max(initial=0))
    if largest >= 2**63:
        raise ValueError("inner products of these weights may not fit 64 bits")
    narrow = largest < 2**31
    kind = np.int32 if narrow else np.int64
    postings = [(np.flatnonzero(weights[:, t]), weights[:, t].astype(kind)) for t in range(terms)]
    postings = [(docs, values if len(docs) == len(ids) else values[docs]) for docs, values in postings]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, SCORE_CELLS // max(1, len(ids)))
    for first in range(0, len(query_ids), step):
        rows = query_weights[first : first + step].astype(kind)
        scores = np.zeros((len(rows), len(ids)), kind)
        for term, (docs, values) in enumerate(postings):
            has = np.flatnonzero(rows[:, term])
            if len(has) == len(rows) and len(docs) == len(ids):
                scores += rows[:, term, None] * values
            elif len(has) and len(docs):
                scores[has[:, None], docs] += rows[has, term, None] * values
        own = query_ids[first : first + step, None] == ids
        least = np.iinfo(kind).min
        scores = np.where(own, least, scores)
        if len(ids) > k:
            floor = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None]
            q, c = np.nonzero((scores >= floor) & ~own)
        else:
            q, c = np.nonzero(~own)
        order = np.lexsort((c, -scores[q, c].astype(np.int64), q))
        q, c = q[order], c[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        q, c = q[nth < k], c[nth < k]
        found.append((query_ids[first + q], ids[c], scores[q, c].astype(np.int64)))
    columns = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products (all, if fewer).

    Both tables have vec_id and weights (long array; a shorter array lacks the last terms). A candidate with the query's
    own id takes no part. Ties go to the smaller vec_id. Weights whose products may not fit 64 bits are an error. Empty
    tables give no rows. Other columns are ignored. A cell moves queries plus candidates for their product of scores, so
    blocks are as large as memory allows; only small tables are cut further, to keep all cores busy.
    """
    size = lambda df: df.agg(F.count("*"), F.coalesce(F.max(F.size("weights")), F.lit(1))).first()
    (n, terms), (m, _) = size(candidates), size(queries)
    most = lambda rows: max(1, min(rows, WEIGHTS_A_BLOCK // max(1, terms)))
    busy = min(2 * candidates.sparkSession.sparkContext.defaultParallelism, ceil(n / LEAST_BLOCK))
    blocks, query_blocks = max(1, busy, ceil(n / most(CANDIDATES_A_BLOCK))), max(1, ceil(m / most(QUERIES_A_BLOCK)))
    block = lambda parts: F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = queries.select("vec_id", "weights", block(query_blocks).alias("query_block"), every(blocks).alias("block"))
    right = candidates.select("vec_id", "weights", block(blocks).alias("block"), every(query_blocks).alias("query_block"))
    cells = left.groupBy("query_block", "block").cogroup(right.groupBy("query_block", "block"))
    best = cells.applyInArrow(lambda a, b: best_of_cell(a, b, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = materialize(quantized(table(spark, sf_dir, "embeddings")), "weights")
    return top_k(vectors.filter("vec_id % 50 = 0"), vectors)


QUERIES = {"op4_exact_topk": op4_exact_topk}
ORACLE_SQL = {
    "op4_exact_topk": """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
t AS (SELECT vec_id, unnest(w) AS w, generate_subscripts(w, 1) AS dim FROM u),
s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.w * c.w)::BIGINT AS score FROM t q JOIN t c ON q.dim = c.dim
  WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
