"""Operator 7, removal of repeated passages by merging shard Burrows-Wheeler transforms.

A passage is LENGTH bytes. Which bytes belong to a passage that starts anywhere else is found exactly:

1. Every window of LENGTH bytes has an anchor, the GRAM bytes in it with the smallest hash. Neighbouring windows
   mostly share theirs, so a text is a row of contexts: an anchor and the run of windows it serves. Equal windows have
   equal anchors, so only contexts whose anchor occurs again can hold repeats.
2. Equal contexts are collapsed first; all their windows are repeats.
3. Distinct contexts of an anchor are compared by the transforms: cells of anchors of bounded size are cut into
   shards, each shard gets its transform, and the shards are merged by interleave refinement (bwt.py), whose common
   prefixes of LENGTH bytes are the repeats.
4. An anchor with more than MOST_CONTEXTS distinct contexts would make a cell unbounded. Its contexts are compared by
   counting hashes of ever shorter runs of windows instead, which is as exact and splits over tasks.

Contexts are equal when the 128 bits of their BLAKE2 digests are; runs of windows when 128 bits of SHA-256 are. Anchors and
the transforms' grams go by 64-bit hashes: a shared anchor hash only adds contexts to compare, and grams of a cell with equal
hashes are compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from hashlib import blake2b
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bwt
from lodestone.llm.common import materialize, release, table
from lodestone.llm.wordhash import grams, mix64, text_slices

LENGTH = bwt.STEP * bwt.DEPTH
GRAM = 32
MOST_CONTEXTS, CELL_BYTES, SHARDS = 64, 1 << 18, 2
RUNS = (12, 1)  # lengths of the runs of windows that the contexts of a common anchor are cut into
_U = np.uint64
_FULL = _U(0xFFFFFFFF)


def gram_ranks(data: np.ndarray, size: int = bwt.STEP, hashes: np.ndarray | None = None) -> np.ndarray:
    """A rank (from 1) of the size bytes from each place of data on, equal for equal bytes only; size is from 9 to 512."""
    if len(data) < size:
        return np.zeros(0, np.int64)
    if hashes is None:
        half = 1 << ((size - 1).bit_length() - 1)
        halves = grams(data, half)
        hashes = mix64(halves[: len(data) - size + 1] * _U(3) + halves[size - half :])
    order = np.argsort(hashes)
    change = hashes[order[1:]] != hashes[order[:-1]]
    rows = np.lib.stride_tricks.as_strided(data, (len(data) - size + 1, size), (1, 1))
    same = np.flatnonzero(~change)
    for at in range(0, len(same), 1 << 16):
        part = same[at : at + (1 << 16)]
        if (rows[order[part]] != rows[order[part + 1]]).any():  # a collision: rank the bytes themselves
            return np.unique(np.ascontiguousarray(rows).view(f"V{size}").ravel(), return_inverse=True)[1].astype(np.int64) + 1
    ranks = np.empty(len(hashes), np.int64)
    ranks[order] = np.concatenate(([1], 1 + np.cumsum(change)))
    return ranks


def smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of width keys."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, _U(2**64 - 1))
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, text -> doc_id, text_key, anchor, c1, c2, first, last, place: the contexts of each text.

    Windows first..last of a text share an anchor that starts at first + place; c1 and c2 are the digest of their bytes,
    which settle the place too.
    """
    names = ["doc_id", "text_key", "anchor", "c1", "c2", "first", "last", "place"]
    for batch in batches:
        for row, data, offsets in text_slices(batch.column(2)):
            if len(data) < LENGTH:
                continue
            hashes = grams(data, GRAM)
            keys = (hashes & ~_FULL) | (_FULL - np.arange(len(hashes), dtype=_U))  # the later of equal grams
            anchor = (_FULL - (smallest(keys, LENGTH - GRAM + 1) & _FULL)).astype(np.int64)
            doc = np.searchsorted(offsets, np.arange(len(anchor)), "right") - 1
            inside = np.arange(len(anchor)) + LENGTH <= offsets[doc + 1]
            start = inside.copy()
            start[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (doc[1:] != doc[:-1])
            first = np.flatnonzero(start)
            if not len(first):
                continue
            stop = inside.copy()
            stop[:-1] &= ~inside[1:] | start[1:]
            last = np.flatnonzero(stop)
            doc, at = doc[first], anchor[first]
            raw = data.tobytes()
            ends = zip(first.tolist(), (last + LENGTH).tolist(), strict=True)
            content = np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in ends]), np.int64).reshape(-1, 2)
            found = [batch.column(k).take(pa.array(row + doc)) for k in (0, 1)]
            found += [pa.array(hashes[at].view(np.int64)), *(pa.array(np.ascontiguousarray(content[:, k])) for k in (0, 1))]
            found += [pa.array((first - offsets[doc]).astype(np.int32)), pa.array((last - offsets[doc]).astype(np.int32)), pa.array((at - first).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(found, names)


ASKED = "anchor long, c1 long, c2 long, contexts long, first int, last int, place int"


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text_key, text, asked (contexts) -> doc_id, text_key, the fields of ASKED, bytes: one row per context."""
    names = [x.split()[0] for x in ASKED.split(", ")]
    for batch in batches:
        for row in range(batch.num_rows):
            data = batch.column(2)[row].as_buffer()
            listed = batch.column(3)[row].values
            for at in range(0, len(listed), 4096):
                part = listed.slice(at, 4096)
                fields = [part.field(n) for n in names]
                spans = zip(part.field("first").to_pylist(), part.field("last").to_pylist(), strict=True)
                cut = pa.array([data[a : b + LENGTH].to_pybytes() for a, b in spans], pa.binary())
                same = [pa.repeat(batch.column(k)[row], len(part)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, *fields, cut], ["doc_id", "text_key", *names, "bytes"])


def repeats_of_cell(part: pa.Table) -> pa.Table:
    """Of distinct contexts (doc_id, text_key, first, bytes): the runs of windows that repeat, by merged transforms."""
    part = part.sort_by([("anchor", "ascending"), ("c1", "ascending"), ("c2", "ascending")])
    chunks = part.column("bytes").to_pylist()
    lengths = np.array([len(c) for c in chunks], np.int64)
    data = np.frombuffer(b"".join(c + b"\0" for c in chunks), np.uint8)
    end = np.cumsum(lengths + 1)
    begin = end - lengths - 1
    ranks = np.ones(len(data), np.int64)
    made = gram_ranks(data)
    ranks[: len(made)] = made
    found = bwt.repeated_ranks(ranks, begin, end, SHARDS)
    k = np.searchsorted(end, found, "right")
    breaks = np.flatnonzero(np.concatenate(([True], (np.diff(found) != 1) | (np.diff(k) != 0)))) if len(found) else found
    ends = np.append(breaks[1:], len(found)) - 1 if len(found) else found
    k = k[breaks]
    base = part.column("first").to_numpy()[k] - begin[k]
    return pa.table({"doc_id": part.column("doc_id").take(pa.array(k)), "text_key": part.column("text_key").take(pa.array(k)), "first": (found[breaks] + base).astype(np.int32), "last": (found[ends] + base).astype(np.int32)})


INTERVALS = "doc_id long, text_key long, first int, last int"


def repeats_of_common(rows: DataFrame) -> DataFrame:
    """The same for contexts of common anchors, by counting hashes of runs of windows of falling length.

    Runs are cut at the same places relative to the anchor in every context, so equal windows are in equal runs. Of equal
    runs one goes on to be cut further, as a partner for parts of runs that are equal to no other.
    """
    keys = ["doc_id", "text_key", "anchor", "place", "first"]
    left, done = rows.select(*keys, F.lit(0).alias("low"), (F.col("last") - F.col("first")).alias("high"), "bytes"), None
    for length in RUNS:
        number = lambda x: F.floor((F.col(x) - F.col("place")) / length).cast("int")  # noqa: E731, B023
        runs = left.withColumn("run", F.explode(F.sequence(number("low"), number("high"))))
        begin = F.col("run") * length + F.col("place")
        runs = runs.select(*keys, F.greatest("low", begin).alias("a"), F.least(F.col("high"), begin + (length - 1)).alias("b"), "bytes")
        span = F.substring(F.col("bytes"), F.col("a") + 1, F.col("b") - F.col("a") + LENGTH)
        placed = F.concat(span, F.concat_ws(",", F.lit(""), F.col("a") - F.col("place"), F.col("b") - F.col("place")).cast("binary"))
        hashed = F.unhex(F.substring(F.sha2(placed, 256), 1, 32))
        runs = materialize(runs.select(*keys, "a", "b", hashed.alias("hash"), *(["bytes"] if length > 1 else [])), "runs")
        row = F.struct("doc_id", "text_key", "first", "a")
        again = runs.groupBy("anchor", "hash").agg(F.count("*").alias("n"), F.min(row).alias("one")).filter("n > 1").drop("n")
        joined = runs.join(materialize(again, "counts"), ["anchor", "hash"], "left")
        found = joined.filter("one IS NOT NULL").select("doc_id", "text_key", (F.col("first") + F.col("a")).alias("first"), (F.col("first") + F.col("b")).alias("last"))
        done = found if done is None else done.unionByName(found)
        if length > 1:
            left = joined.filter(F.col("one").isNull() | (F.col("one") == row)).select(*keys, F.col("a").alias("low"), F.col("b").alias("high"), "bytes")
    return done


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, runs -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            out: list[tuple] = []
            part = batch.slice(at, 512)
            for doc, text, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for r in sorted((r["first"], r["last"] + LENGTH) for r in runs or ()):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1])
                    else:
                        spans.append(list(r))
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), F.xxhash64("text").alias("text_key"), "text", F.col("doc_id").cast("long").alias("named"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, first, last, way: windows (by start byte, inclusive) of each text that start anywhere else too, and how they were found."""
    texts = keyed(docs).drop("named")
    made = texts.mapInArrow(contexts, "doc_id long, text_key long, anchor long, c1 long, c2 long, first int, last int, place int")
    every = materialize(made, "contexts")
    differ = (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))
    anchors = every.groupBy("anchor").agg(F.count("*").alias("n"), differ.alias("differ")).filter("n > 1").drop("n")
    again = materialize(every.join(materialize(anchors, "anchors"), "anchor"), "again")
    release(every)
    key = ["anchor", "c1", "c2"]
    one = F.min(F.struct("doc_id", "text_key", "first", "last", "place")).alias("one")
    groups = materialize(again.groupBy(*key, "differ").agg(F.count("*").alias("n"), one), "groups")
    whole = again.join(groups.filter("n > 1").select(key), key).select("doc_id", "text_key", "first", "last")

    distinct = groups.filter("differ").select(*key, "one.*")
    sizes = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("contexts")), "sizes")
    size = F.col("last") - F.col("first") + LENGTH
    asked = F.struct(*key, "contexts", "first", "last", "place")
    per_text = distinct.join(sizes, "anchor").groupBy("doc_id", "text_key").agg(F.collect_list(asked).alias("asked"))
    cut = texts.join(per_text, ["doc_id", "text_key"]).mapInArrow(cut_contexts, f"doc_id long, text_key long, {ASKED}, bytes binary")
    cut = materialize(cut, "cut")
    rare, common = cut.filter(F.col("contexts") <= MOST_CONTEXTS), cut.filter(F.col("contexts") > MOST_CONTEXTS)
    cells = max(1, ceil((rare.agg(F.sum(size)).first()[0] or 0) / CELL_BYTES))
    rare = rare.select("doc_id", "text_key", *key, "first", "bytes", F.pmod(F.xxhash64("anchor"), F.lit(cells)).alias("cell"))
    merged = rare.groupBy("cell").applyInArrow(repeats_of_cell, INTERVALS)
    ways = {"equal contexts": whole, "merged transforms": merged, "runs of common anchors": repeats_of_common(common)}
    found = [df.withColumn("way", F.lit(way)) for way, df in ways.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) for each row of docs (doc_id, text).

    Texts are UTF-8 bytes; null counts as empty. Every byte in a passage of LENGTH bytes that starts anywhere else in the
    input, the same text included, is removed; passages never cross texts. Repeated rows are texts like others, so they
    remove each other. n_spans counts maximal removed runs. Other columns are ignored; an empty table gives no rows.
    """
    runs = repeated_runs(docs).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = keyed(docs).join(runs, ["doc_id", "text_key"], "left").select("named", "text", "runs")
    return joined.mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op7_repeats": op7_repeats}
ORACLE_SQL: dict[str, str] = {}
