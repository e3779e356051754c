"""Vector search by exact inner products, in cells of query and candidate blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.search import ranked

QUERY_BLOCK, BLOCK, STEP = 4096, 8192, 64


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return inner(a, b) / (F.sqrt(inner(a, a)) * F.sqrt(inner(b, b)))


def similar(queries: DataFrame, candidates: DataFrame, k: int, least: float | None = None, digits: int = 6) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates (vec_id, embedding) of each query (query_id, embedding), but itself.

    Cells of a block of queries and a block of candidates each keep their k best of every query; these are merged.
    Vectors have one length; a score with a null or shorter vector is null and comes last.
    """
    queries = queries.filter("query_id IS NOT NULL").select("query_id", F.col("embedding").alias("asked"))
    candidates = candidates.filter("vec_id IS NOT NULL").select("vec_id", "embedding")
    blocks, others = (max(1, ceil(df.count() / n)) for df, n in ((queries, QUERY_BLOCK), (candidates, BLOCK)))

    def dealt(rows: DataFrame, key: str, own: str, blocks: int, other: str, others: int) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).groupBy("i", "j")

    kinds = f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(candidates.dtypes)['vec_id']}, score double"
    cells = dealt(queries, "query_id", "i", blocks, "j", others).cogroup(dealt(candidates, "vec_id", "j", others, "i", blocks))
    scored = cells.applyInArrow(lambda q, c: best_of_cell(q, c, k, least, digits), kinds).select("query_id", "vec_id", F.round("score", digits).alias("score"))
    return ranked(scored, ["query_id"], [F.desc("score"), "vec_id"], k)


def best_of_cell(q: pa.Table, c: pa.Table, k: int, least: float | None = None, digits: int = 6) -> pa.Table:
    """query_id, vec_id, score: the k best candidates (vec_id, embedding) of each query (query_id, asked) of a cell, by score to `digits` places, then vec_id."""
    c = c.sort_by("vec_id")
    names, ids = (t.column(n).to_numpy() for t, n in ((q, "query_id"), (c, "vec_id")))
    x, y = _matrices(q.column("asked"), c.column("embedding"))
    found: list[tuple[np.ndarray, ...]] = [(names[:0], ids[:0], np.zeros(0))]
    for first in range(0, len(names), STEP):
        part = x[first : first + STEP]
        sums = np.zeros((len(part), len(ids)))
        for n in range(x.shape[1]):  # in the order of inner(), so that sums are the same
            sums += part[:, n, None] * y[None, :, n]
        rounded = np.copysign(np.floor(np.abs(sums) * 10**digits + 0.5) / 10**digits, sums)
        for row, name in enumerate(names[first : first + STEP]):
            own = np.flatnonzero(ids != name)
            if least is not None:
                own = own[rounded[row, own] >= least]
            own = own[np.argsort(-rounded[row, own], kind="stable")[:k]]
            found.append((np.full(len(own), name, names.dtype), ids[own], sums[row, own]))
    out = [np.concatenate(part) for part in zip(*found, strict=True)]
    return pa.table({"query_id": out[0], "vec_id": out[1], "score": pa.array(out[2], from_pandas=True)})


def _matrices(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Rows of equal length; those of null or shorter vectors are NaN."""
    rows = [c.to_pylist() for c in columns]
    width = max((len(v) for part in rows for v in part if v is not None), default=0)
    whole = lambda v: v if v is not None and len(v) == width and None not in v else [np.nan] * width
    return [np.array([whole(v) for v in part], np.float64).reshape(len(part), width) for part in rows]


def summed(hits: DataFrame, by: list[str], key: str, k: int) -> DataFrame:
    """Scores of several queries added up per key."""
    total = hits.groupBy(*by, key).agg(F.round(F.sum("score"), 6).alias("score"), F.count("*").alias("hits"))
    return ranked(total, by, [F.desc("score"), key], k)


Encoder = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def embedded(texts: DataFrame, key: str, text: str, make_encoder: Callable[[], Encoder], known: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """key, sha256, embedding: the mean of a text's token vectors. An encoder gives, for some texts, states (texts, tokens, width) and a mask
    of the tokens that count (texts, tokens); make_encoder is called once a partition, on its executor.

    Equal texts are encoded once, and not at all if known (sha256, embedding) has them. A null text has no embedding; one without tokens zeros.
    """
    rows = texts.select(key, text, F.sha2(text, 256).alias("sha256"))
    new = rows.filter(F.col(text).isNotNull()).groupBy("sha256").agg(F.first(text).alias("text"))
    new = new if known is None else new.join(known.select("sha256"), "sha256", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                states, mask = (np.asarray(a, np.float32) for a in encoder(part.column(1).to_pylist()))
                means = np.einsum("ntd,nt->nd", states, mask) / np.maximum(mask.sum(1, keepdims=True), 1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(means), pa.list_(pa.float32()))], ["sha256", "embedding"])

    made = new.mapInArrow(encode, "sha256 string, embedding array<float>")
    made = made if known is None else made.unionByName(known.select("sha256", F.col("embedding").cast("array<float>").alias("embedding")))
    return rows.join(made, "sha256", "left").select(key, "sha256", "embedding")
