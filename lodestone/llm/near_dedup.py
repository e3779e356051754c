"""Operator 3, MinHash near-dedup with sequential Bayesian verification.

Documents with the same word sequence (by a 128-bit digest of its bytes) form a class with one representative (its smallest doc_id). Representatives get
BANDS bands of ROWS minimum hashes over their five-word shingles, which make buckets (a pair at the threshold
shares none with probability (1 - 0.85**5)**24 < 1e-6). Members of shared buckets get a signature of HASHES further
minimum hashes. Candidate pairs are compared in batches of signature values: under a uniform prior the posterior of the
similarity after m matches of n is Beta(m + 1, n - m + 1), and a pair is pruned once its chance of reaching the threshold
is below MISS. Survivors are verified exactly, on the words of their full shingle sets.

Pairs are taken so that groups of copies never expand into all pairs. In two rounds members meet a pivot: the member of
their buckets that shares most buckets with most others, then the like member of those not yet linked with it. Last, the pairs
across components in buckets that still hold several are compared in blocks of BLOCK members, in memory. Pairs never become
rows there: a member that has survivors is one row, with its mates as bits, and meets their texts in cells of about
CELL_SHINGLES shingles, from which only links that join two components leave, fewer than members. Pairs within one component
add nothing and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, materialize, table
from lodestone.llm.components import components
from lodestone.llm.wordhash import SHINGLE, distinct, mix64, shingles, text_slices, words

PERCENT = 85
BANDS, ROWS, HASHES, BATCH = 24, 5, 384, 64
MISS = 1e-6
PAIR_BYTES = 1 << 20
BLOCK, CELL_ROWS, CELL_SHINGLES = 256, 4096, 1 << 18
POSSIBLE = "key long, i int, j int, node long, label long, n_shingles long, place int, mates binary, members int, total long"
_rng = np.random.Generator(np.random.PCG64(99))
_XOR = _rng.integers(0, 2**32, BANDS * ROWS + HASHES, dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, BANDS * ROWS + HASHES, dtype=np.uint32) | np.uint32(1)
_SEED = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> dict[int, int]:
    """For n compared values, the fewest matches at which P(similarity >= percent | matches) is at least miss."""
    t, table_ = percent / 100, {}
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:  # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        table_[n] = m
    return table_


def surviving(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which rows of two signature matrices are still possible after all batches."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, fewest in least.items():
        matches[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1)
        alive = alive[matches[alive] >= fewest]
    return alive


def minima(hashes: np.ndarray, offsets: np.ndarray, first: int, last: int) -> np.ndarray:
    """The minimum hashes (32 bit) number first..last - 1 of each row; rows must not be empty."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, last - first), np.uint32)
    for k in range(first, last):
        out[:, k - first] = np.minimum.reduceat((h ^ _XOR[k]) * _ODD[k], offsets[:-1])
    return out


def word_list(text: bytes) -> list[bytes]:
    """The words of a text: bytes.lower() touches A-Z only, and bytes.split() cuts at space and \\t..\\r."""
    return text.lower().split()


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text -> doc_id, k1, k2 (of the word sequence), n_shingles, bands."""
    for batch in batches:
        for first, data, row_offsets in text_slices(batch.column(1)):
            w, word_offsets = words(data, row_offsets)
            n = len(row_offsets) - 1
            s, shingle_offsets = shingles(w, word_offsets)
            sets, set_offsets = distinct(s, shingle_offsets)
            full = np.flatnonzero(np.diff(set_offsets))
            keys = np.zeros((2, n), np.uint64)
            for row in full.tolist():
                keys[:, row] = np.frombuffer(blake2b(b" ".join(word_list(data[row_offsets[row] : row_offsets[row + 1]].tobytes())), digest_size=16).digest(), "<u8")
            bands: list[list[int] | None] = [None] * n
            if len(full):
                found = minima(sets, np.concatenate((set_offsets[full], [len(sets)])), 0, BANDS * ROWS)
                parts = found.astype(np.uint64).reshape(len(full), BANDS, ROWS)
                mixed = np.tile(_SEED, (len(full), 1))
                for k in range(ROWS):
                    mixed = mix64(mixed ^ parts[:, :, k])
                for row, made in zip(full, mixed.view(np.int64).tolist(), strict=True):
                    bands[row] = made
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), *(pa.array(x.view(np.int64)) for x in keys), pa.array(np.diff(set_offsets)), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "k1", "k2", "n_shingles", "bands"],
            )


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n_shingles, bands, text -> the same and signature (the low bytes of the minimum hashes). No text is empty."""
    for batch in batches:
        found: list[bytes] = []
        for _, data, offsets in text_slices(batch.column(3)):
            sets, ends = distinct(*shingles(*words(data, offsets)))
            found += [m.tobytes() for m in minima(sets, ends, BANDS * ROWS, BANDS * ROWS + HASHES).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "signature"])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, sa, sb -> a, b of the pairs that the posterior bounds leave."""
    least = least_matches()
    for batch in batches:
        if batch.num_rows:
            alive = surviving(matrix(batch.column(2)), matrix(batch.column(3)), least)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(alive)) for k in (0, 1)], ["a", "b"])


def runs(cell: pa.Table, names: tuple[str, ...]) -> list[tuple[int, int]]:
    """First and last row + 1 of the runs of equal values of the columns named."""
    new = np.zeros(max(cell.num_rows - 1, 0), bool)
    for name in names:
        new |= np.diff(cell.column(name).to_numpy()) != 0
    cuts = (np.flatnonzero(new) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, cell.num_rows], strict=True)) if cell.num_rows else []


def prune_cell(cell: pa.Table) -> pa.Table:
    """The members with survivors of each block pair (key, i, j) of a cell, across labels, one row each (POSSIBLE).

    A member's place is its number among them, mates has a bit for each place of a pair, at the pair's first place only;
    total is the shingles of all members. A pair that shares an earlier band is left to that band's bucket.
    """
    least = least_matches()
    cell = cell.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
    key, i, j, block, node, label, size = (cell.column(c).to_numpy() for c in ("key", "i", "j", "block", "node", "label", "n_shingles"))
    signatures = matrix(cell.column("signature"))
    bands = cell.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    kept, places, counts, totals = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    mates: list[bytes] = []
    for first, last in runs(cell, ("key", "i", "j")):
        rows = np.arange(first, last)
        if i[first] == j[first]:
            p, q = np.triu_indices(len(rows), 1)
            a, b = rows[p], rows[q]
        else:
            a, b = (x.ravel() for x in np.meshgrid(rows[block[rows] == i[first]], rows[block[rows] == j[first]], indexing="ij"))
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        good = (label[a] != label[b]) & (100 * low >= PERCENT * high)
        a, b, matches = a[good], b[good], np.zeros(int(good.sum()), np.int64)
        for n, fewest in least.items():
            for at in range(0, len(a), 1 << 16):
                part = slice(at, at + (1 << 16))
                matches[part] += (signatures[a[part], n - BATCH : n] == signatures[b[part], n - BATCH : n]).sum(1)
            good = matches >= fewest
            a, b, matches = a[good], b[good], matches[good]
        if len(a):
            band = int(np.flatnonzero(bands[first] == key[first])[0])
            good = ~(bands[a, :band] == bands[b, :band]).any(1)
            a, b = a[good], b[good]
        if len(a):
            members, at = np.unique(np.concatenate((node[a], node[b])), return_inverse=True)  # rows that repeat an id are one member
            bits = np.zeros((len(members), len(members)), bool)
            bits[np.minimum(*np.split(at, 2)), np.maximum(*np.split(at, 2))] = True
            kept.append(first + np.searchsorted(node[first:last], members))
            places.append(np.arange(len(members), dtype=np.int32))
            counts.append(np.full(len(members), len(members), np.int32))
            mates += [x.tobytes() for x in np.packbits(bits, axis=1)]
            totals.append(np.full(len(members), size[kept[-1]].sum()))
    out = cell.select(["key", "i", "j", "node", "label", "n_shingles"]).take(pa.array(np.concatenate(kept)))
    for name, made in {"place": np.concatenate(places), "mates": pa.array(mates, pa.binary()), "members": np.concatenate(counts), "total": np.concatenate(totals)}.items():
        out = out.append_column(name, pa.array(made))
    return out


def link_cell(cell: pa.Table) -> pa.Table:
    """Links a, b of the survivors that prune_cell left, in each (key, i, j, u, v): those that join two labels not joined yet.

    Shared shingles are counted by their hashes, links confirmed on words.
    """
    names = ("key", "i", "j", "u", "v")
    cell = cell.sort_by([(c, "ascending") for c in (*names, "place")])
    node, label, place, part, u, v = (cell.column(c).to_numpy() for c in ("node", "label", "place", "part", "u", "v"))
    texts, mates = cell.column("text").combine_chunks(), cell.column("mates")
    out: list[tuple[int, int]] = []
    joined: dict[int, int] = {}

    def top(x: int) -> int:
        while joined[x] != x:
            joined[x] = x = joined[joined[x]]
        return x

    for first, last in runs(cell, names):
        sets: list[np.ndarray] = []
        for _, data, offsets in text_slices(texts.slice(first, last - first)):
            found, ends = distinct(*shingles(*words(data, offsets)))
            sets += np.split(found, ends[1:-1])
        named, numbers = np.unique(np.concatenate(sets), return_inverse=True)
        ids = np.split(numbers, np.cumsum([len(x) for x in sets])[:-1])
        at: dict[int, list[int]] = {}
        for row in range(first, last):
            at.setdefault(int(place[row]), []).append(row)
        joined = {x: x for x in label[first:last].tolist()}
        mine = np.zeros(len(named), bool)
        for a in range(first, last):
            mine[ids[a - first]] = True
            for other in np.flatnonzero(np.unpackbits(np.frombuffer(mates[a].as_py(), np.uint8))).tolist():
                for b in at.get(other, ()):
                    if u[a] != v[a] and part[a] == part[b] or (one := top(int(label[a]))) == (two := top(int(label[b]))):
                        continue
                    both = int(np.count_nonzero(mine[ids[b - first]]))
                    if 100 * both >= PERCENT * (len(ids[a - first]) + len(ids[b - first]) - both) and alike(texts[a].as_py(), texts[b].as_py()):
                        joined[one] = two
                        out.append((int(node[a]), int(node[b])))
            mine[ids[a - first]] = False
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, ta, tb -> a, b of the pairs whose full shingle sets are similar enough."""
    for batch in batches:
        sizes = np.cumsum([len(x or "") + len(y or "") for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PAIR_BYTES)))
            part = batch.slice(at, end - at)
            good = [k for k, (x, y) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)) if alike(x, y)]
            yield pa.RecordBatch.from_arrays([part.column(k).take(pa.array(good, pa.int64())) for k in (0, 1)], ["a", "b"])
            at = end


def alike(one: str | None, two: str | None) -> bool:
    """Whether the full shingle sets of two texts are similar enough."""
    x, y = shingle_set(one), shingle_set(two)
    both = len(x & y)
    return bool(x and y) and 100 * both >= PERCENT * (len(x) + len(y) - both)


def shingle_set(text: str | None) -> set[tuple[bytes, ...]]:
    """The shingles of a text, as words."""
    w = word_list((text or "").encode("utf-8", "surrogatepass"))
    return set(zip(*(w[k:] for k in range(SHINGLE)), strict=False)) if len(w) >= SHINGLE else {tuple(w)} if w else set()


def dealt_rows(rows: DataFrame) -> DataFrame:
    """key, node, label, block, i, j: rows (key, node, label) of buckets with several labels, dealt to pairs of blocks.

    A bucket's largest label is apart: its members, linked already, meet the blocks of the other labels only, and those
    meet all blocks. So copies of a large group are dealt once for every BLOCK strangers, not once for every BLOCK copies.
    """
    sizes = materialize(rows.groupBy("key", "label").agg(F.count("*").alias("n")), "sizes")
    per = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("all"))
    in_blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    per = per.select("key", F.col("most.label").alias("largest"), in_blocks(F.col("all") - F.col("most.n")).alias("others"), in_blocks(F.col("most.n")).alias("own"))
    rows = rows.select("key", "node", "label").join(per, "key").withColumn("apart", F.col("label") == F.col("largest"))
    spot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.withColumn("block", F.when(F.col("apart"), F.col("others") + spot(F.col("own"))).otherwise(spot(F.col("others"))))
    met = F.when(F.col("apart"), F.col("others")).otherwise(F.col("others") + F.col("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), met - 1)))
    return rows.select("key", "node", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def text_cells(possible: DataFrame) -> DataFrame:
    """possible (POSSIBLE) with part, u, v, cell: block pairs of more than CELL_SHINGLES shingles are dealt to pairs of parts.

    A part has two members or more in the mean, so that long texts of few members are not repeated for nothing.
    """
    parts = F.least(F.ceil(F.col("total") / CELL_SHINGLES), F.ceil(F.col("members") / 2)).cast("int")
    rows = possible.withColumn("part", F.pmod(F.xxhash64("node", "key"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.withColumn("u", F.least("part", "other")).withColumn("v", F.greatest("part", "other")).drop("other", "members", "total")
    shingles_ = rows.agg(F.sum("n_shingles")).first()[0] or 0
    return rows.withColumn("cell", F.pmod(F.xxhash64("key", "i", "j", "u", "v"), F.lit(max(1, ceil(shingles_ / CELL_SHINGLES))))).drop("n_shingles")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text); other columns are ignored.

    Words are compared after lower-casing A-Z. Null, empty and blank texts have no shingles and are linked with
    nothing; texts of fewer than five words have their whole sequence as the one shingle. Rows that repeat a doc_id are
    one document. A row without doc_id never stands for others: it stays only if nothing else has its words.
    An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = materialize(docs.mapInArrow(describe, "doc_id long, k1 long, k2 long, n_shingles long, bands array<long>"), "described")
    classes = materialize(described.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("node")), "classes")
    members = described.select("doc_id", "k1", "k2", "n_shingles").join(classes, ["k1", "k2"], "left")
    reps = described.join(classes.withColumn("doc_id", F.col("node")), ["k1", "k2", "doc_id"])
    reps = materialize(reps.select("node", "n_shingles", "bands"), "reps")

    banded = reps.select("node", F.explode("bands").alias("key")).distinct()
    buckets = materialize(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = materialize(banded.join(buckets, "key"), "shared")
    scores = materialize(shared.groupBy("node").agg(F.sum("n").alias("score")), "scores")
    known = reps.join(scores.select("node"), "node").join(docs.select(F.col("doc_id").alias("node"), "text"), "node")
    known = known.select("node", "n_shingles", "bands", "text").filter(F.col("text").rlike(WORD))
    known = materialize(known.mapInArrow(sign, "node long, n_shingles long, bands array<long>, text string, signature binary"), "known")

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links, by exact comparison."""
        side = lambda x, t: known.select(F.col("node").alias(x), F.col("text").alias(t))
        return pairs.join(side("a", "ta"), "a").join(side("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")

    def linked(pairs: DataFrame) -> DataFrame:
        side = lambda x: known.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
        return similar(materialize(sized.select("a", "b", "sa", "sb").mapInArrow(prune, "a long, b long"), "survivors"))

    scored = shared.join(scores, "node")
    best = F.max(F.struct("score", "node"))
    pivots = materialize(scored.groupBy("key").agg(best.alias("pivot")), "pivots")
    met = shared.join(pivots, "key").filter(F.col("node") != F.col("pivot.node")).groupBy("node").agg(F.max("pivot").alias("pivot"))
    labels = components(linked(met.select(F.col("node").alias("a"), F.col("pivot.node").alias("b"))))
    for last in (False, True):
        labelled = scored.join(labels, "node", "left").select("key", "node", "n", "score", F.coalesce("component", "node").alias("label"))
        labelled = materialize(labelled, "labelled")
        best = F.max(F.struct("score", "node")).alias("best")
        named = materialize(labelled.groupBy("key", "label").agg(best), "named")  # few rows a bucket once copies are linked
        top = F.max(F.struct("best", "label")).alias("top")
        mixed = materialize(named.groupBy("key").agg(F.count("*").alias("labels"), top).filter("labels > 1").select("key", "top"), "mixed")
        if mixed.isEmpty():
            break
        if last:
            dealt = materialize(dealt_rows(labelled.join(mixed.select("key"), "key")), "dealt")
            cells = max(1, ceil(dealt.count() / CELL_ROWS))
            dealt = dealt.join(known.select("node", "n_shingles", "bands", "signature"), "node").filter(F.array_contains("bands", F.col("key")))
            dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("key", "i", "j"), F.lit(cells)))
            possible = materialize(dealt.groupBy("cell").applyInArrow(prune_cell, POSSIBLE), "possible")
            found = text_cells(possible).join(known.select("node", "text"), "node").groupBy("cell").applyInArrow(link_cell, "a long, b long")
        else:
            rest = named.join(mixed, "key").filter(F.col("label") != F.col("top.label"))
            second = materialize(rest.groupBy("key").agg(F.max(F.struct("best", "label")).alias("second")), "second")
            pairs = labelled.join(second, "key").filter(F.col("label") != F.col("second.label"))
            found = linked(pairs.select(F.col("node").alias("a"), F.col("second.best.node").alias("b")).distinct())
        ends = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))  # noqa: E731, B023
        contracted = found.join(ends("a"), "a", "left").join(ends("b"), "b", "left")
        contracted = components(contracted.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        moved = labels.join(contracted.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
        old = moved.select("node", F.coalesce("to", "component").alias("component"))
        new = contracted.join(labels.select("node"), "node", "left_anti")
        labels = materialize(old.unionByName(new), "labels")
    out = members.join(labels, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLE_SQL: dict[str, str] = {}
