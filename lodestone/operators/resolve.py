"""Identity: simple and multi-key de-duplication, key-overlap joins, connected components of keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cut = Callable[[DataFrame], DataFrame]


def first_by_key(rows: DataFrame, key: Column | str, order: Sequence) -> DataFrame:
    """Of rows with equal key, the first by order."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def merged(rows: DataFrame, key: Column, order: str, absorb: Sequence[str] = (), largest: Sequence[str] = (), union: Sequence[str] = ()) -> DataFrame:
    """One row per key: the first by order survives and takes missing fields from later ones.

    absorb: first non-null by order; largest: maximum; union: array fields, distinct values in order of appearance.
    """
    fields = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in absorb]
    fields += [F.max(c).alias(c) for c in largest]
    sort = lambda c: F.array_sort(F.collect_list(F.struct(order, c)))
    fields += [F.array_distinct(F.flatten(sort(c).getField(c))).alias(c) for c in union]
    return rows.groupBy(key.alias("key")).agg(F.min(order).alias(order), *fields, F.count("*").alias("merged"))


EDGES_A_TASK = 500_000


def _stars(edges: DataFrame, tasks: int) -> DataFrame:
    """Two star steps over edges (a, b) with a > b: to the least neighbour of the smaller end, then between the smaller neighbours of a node.

    Every node's larger neighbours are linked to its least neighbour or itself, which for an edge is a look-up of its smaller end. Then
    every node's smaller neighbours and the node itself are linked to the least of them.
    """
    least = edges.repartition(tasks, "a").groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m")
    risen = edges.repartition(tasks, "b").join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b")).repartition(tasks, "a")
    near = risen.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return near.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).repartition(tasks, "a").distinct()


def _settled(links: DataFrame, tasks: int) -> bool:
    """Whether every node a has one b only, which is no a: then each b is the least node of its component."""
    once = links.repartition(tasks, "a").groupBy("a").count().filter("count > 1").isEmpty()
    return once and links.repartition(tasks, "b").join(links.select(F.col("a").alias("b")).repartition(tasks, "b"), "b", "left_semi").isEmpty()


def components(edges: DataFrame, cut: Cut | None = None) -> DataFrame:
    """node, component (smallest node reachable) for edges (a, b), by alternating two star steps until all links form stars.

    Edges only move to smaller nodes, so this ends, and after about log(n) rounds; it never stops earlier. cut materialises a
    round's edges (checkpoint() in the shared folder of spark.checkpoint.dir by default). Tasks grow in number with the edges.
    """
    cut = cut or (lambda df: df.checkpoint())
    down = F.col("a") < F.col("b")
    first = cut(edges.select(F.when(down, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(down, F.col("a")).otherwise(F.col("b")).alias("b")))
    apart = F.coalesce(F.col("a") != F.col("b"), F.lit(False))
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(first.count() / EDGES_A_TASK))
    links = first.filter(apart)
    while not _settled(links, tasks):
        links = cut(_stars(links, tasks))
    linked = links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b").distinct().select("b", "b"))
    alone = first.filter(~apart).select(F.explode(F.array("a", "b")).alias("node")).distinct().repartition(tasks, "node").join(linked.repartition(tasks, "node"), "node", "left_anti")
    return linked.union(alone.select("node", F.col("node").alias("component")))


PAIRS_A_TASK = 8_000_000
IDS_A_CELL = 4096
IDS_A_RUN = 256
ROWS_HELD = 16_384
SETS_TO_BROADCAST = 100_000


def _runs(ids: str, n: int) -> Column:
    """Arrays of up to n entries of the array ids. Exploding them is not compiled, so pairs are held for one array at a time, not for a cell."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / n).cast("int")), lambda k: F.slice(ids, k * n + 1, n))


def _class_parts(ids: DataFrame, sets: DataFrame, asked: DataFrame, few: bool, name: str) -> tuple[DataFrame, DataFrame]:
    """Keys of each class (_class, _parts, _k, _n) and lists of its members (_class, _part, _ids), each about IDS_A_CELL long at most.

    A class holds the ids with the same keys, as far as they are asked for, and is named by the least of them.
    """
    kept = sets.select("_own", "_first", "_size", F.explode("_own").alias("_k")).join(asked, "_k", "left_semi").groupBy("_own", "_first", "_size").agg(F.array_sort(F.collect_list("_k")).alias("_kept"))
    found = kept.groupBy("_kept").agg(F.min("_first").alias(f"{name}_class"), F.ceil(F.sum("_size") / IDS_A_CELL).cast("int").alias(f"{name}_parts"))
    named = kept.join(found, "_kept").select("_own", f"{name}_class", f"{name}_parts")
    part = F.pmod(F.xxhash64("_id"), F.col(f"{name}_parts")).cast("int")
    lists = ids.join(F.broadcast(named) if few else named, "_own").groupBy(f"{name}_class", part.alias(f"{name}_part")).agg(F.array_sort(F.collect_list(F.struct("_id")))["_id"].alias(f"{name}_ids"))
    return found.select(f"{name}_class", f"{name}_parts", F.explode("_kept").alias("_k")).groupBy(f"{name}_class", f"{name}_parts", "_k").agg(F.count("*").alias(f"{name}_n")), lists


def key_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, keys: str = "keys") -> DataFrame:
    """left_key, right_key, shared (how many keys): distinct pairs that share any key of the array column keys.

    Rows with the same keys, as far as the other side has them, are one class. Classes are paired by an equi-join of exploded keys; a pair
    of classes becomes cells of two lists of ids each, and only these are shuffled. Pairs are written out in the tasks that cells are dealt
    to, a run of right ids for one left id after the other, so that columnar files, which write runs and repeats once, stay small.
    """
    names = ("_a", "_b")
    ids = [df.select(F.col(key).alias("_id"), F.array_sort(F.filter(keys, lambda k: k.isNotNull())).alias("_own")).filter(F.size("_own") > 0) for df, key in ((left, left_key), (right, right_key))]
    most = ids[0].groupBy("_id").count().agg(F.max("count")).crossJoin(ids[1].groupBy("_id").count().agg(F.max("count"))).first()
    ids = [df.groupBy("_id").agg(F.array_sort(F.flatten(F.collect_list("_own"))).alias("_own")) if (n or 0) > 1 else df for df, n in zip(ids, most, strict=True)]  # keys are only moved if ids repeat
    sets = [df.groupBy("_own").agg(F.min(F.struct("_id")).alias("_first"), F.count("*").alias("_size")) for df in ids]
    held = [df.select("_size", F.explode("_own").alias("_k")).groupBy("_k").agg(F.sum("_size").alias(f"{name}_n")) for df, name in zip(sets, names, strict=True)]
    pairs = held[0].join(held[1], "_k").agg(F.sum(F.col("_a_n").cast("double") * F.col("_b_n")))
    pairs, *known = pairs.crossJoin(sets[0].agg(F.count("*"))).crossJoin(sets[1].agg(F.count("*"))).first()
    few = [n <= SETS_TO_BROADCAST for n in known]
    (a, a_lists), (b, b_lists) = (_class_parts(df, own, other.select("_k"), n, name) for df, own, other, n, name in zip(ids, sets, held[::-1], few, names, strict=True))
    met = a.join(b, "_k").groupBy("_a_class", "_a_parts", "_b_class", "_b_parts").agg(F.sum(F.col("_a_n") * F.col("_b_n")).alias("shared"))
    numbers = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}_parts") - 1)).alias(f"{name}_part")
    cells = met.select("*", numbers("_a")).select("*", numbers("_b")).drop("_a_parts", "_b_parts")
    cell, tasks = ["_a_class", "_a_part", "_b_class", "_b_part"], max(1, ceil((pairs or 0) / PAIRS_A_TASK))
    dealt = [cells.join(df, cell[at : at + 2]).select(*cell, *more).repartition(tasks, *cell) for df, at, more in ((a_lists, 0, ("_a_ids", "shared")), (b_lists, 2, ("_b_ids",)))]
    # long lists first, as writers judge by the first rows whether a column repeats
    rows = dealt[0].join(dealt[1], cell).sortWithinPartitions(F.desc(F.size("_b_ids"))).select("_a_ids", "shared", F.explode(_runs("_b_ids", IDS_A_RUN)).alias("_b_run"))
    return rows.select(F.explode(_runs("_a_ids", ROWS_HELD // IDS_A_RUN)).alias("_a_run"), "_b_run", "shared").select(F.explode("_a_run").alias(left_key), "_b_run", "shared").select(left_key, F.explode("_b_run").alias(right_key), "shared")


def resolve_entities(rows: DataFrame, key_columns: Sequence[str], order: str, cut: Cut | None = None) -> DataFrame:
    """rows with `entity`: records linked through any shared non-null key, transitively; named by the least order value."""
    keyed = rows.select(order, F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))) for c in key_columns])).alias("k")).filter("k IS NOT NULL")
    edges = keyed.select(F.col(order).alias("a"), F.min(order).over(Window.partitionBy("k")).alias("b")).filter("a <> b")
    found = components(edges, cut)
    return rows.join(found, rows[order] == found["node"], "left").select(rows["*"], F.coalesce("component", rows[order]).alias("entity"))


def absorbed(rows: DataFrame, by: str, order: str, paper_id: str = "paper_id", keys: Sequence[str] = ("doi", "arxiv_id", "title")) -> DataFrame:
    """rows with `entity`, the order value of the first-seen record that each one becomes part of (its own, if none).

    A record is looked up by its id, then by each key in turn; the first hit absorbs it and takes over the keys that are not known
    yet, but not its id. Unlike resolve_entities this isn't transitive. Groups are one query's candidates, a bounded list.
    """

    def absorb(part: pa.Table) -> pa.Table:
        part = part.sort_by(order)
        seen: list[dict] = [{} for _ in range(len(keys) + 1)]
        entity = []
        for place, own in zip(part.column(order).to_pylist(), zip(*(part.column(c).to_pylist() for c in (paper_id, *keys)), strict=True), strict=True):
            found = seen[0].get(own[0])
            for known, key in zip(seen[1:], own[1:], strict=True):
                found = known.get(key) if found is None and key else found
            if found is None:
                found = seen[0][own[0]] = place
            for known, key in zip(seen[1:], own[1:], strict=True):
                if key:
                    known.setdefault(key, found)
            entity.append(found)
        return part.append_column("entity", pa.array(entity, part.column(order).type))

    kind = dict(rows.dtypes)[order]
    return rows.groupBy(by).applyInArrow(absorb, ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("entity", kind)]))


def greedy_unique(rows: DataFrame, by: str, order: str, keys: str = "keys") -> DataFrame:
    """Rows of each group in order, without those any of whose keys an earlier kept row has. Groups are small case lists."""

    def unique(part: pa.Table) -> pa.Table:
        part = part.sort_by(order)
        seen: set[str] = set()
        kept = []
        for k, own in enumerate(part.column(keys).to_pylist()):
            if own and seen.isdisjoint(own):
                seen.update(own)
                kept.append(k)
        return part.take(pa.array(kept, pa.int64()))

    return rows.groupBy(by).applyInArrow(unique, rows.schema)


ROWS_A_TASK = 500_000


def greedy_score(predicted: DataFrame, gold: DataFrame, by: str, order: str) -> DataFrame:
    """by, true_positive, false_positive, false_negative, precision, recall, f1 of predicted and gold (by, order, keys).

    Both sides are made unique first (as greedy_unique does). A prediction that only meets gold already matched is neither true nor false.
    Cases pass their task as a sorted stream, gold first, so that a small case costs no call of its own; rows of one order go by their keys.
    """
    sides = [df.select(by, order, "keys").withColumn("side", F.lit(s)) for s, df in ((0, gold), (1, predicted))]
    rows = sides[0].unionByName(sides[1])
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows.count() / ROWS_A_TASK))
    rows = rows.repartition(tasks, by).sortWithinPartitions(by, "side", F.asc_nulls_last(order), "keys").select(by, "side", "keys")
    names = ("true_positive", "false_positive", "false_negative", "precision", "recall", "f1")

    def table_of(done: list[tuple], kind: pa.DataType | None) -> list[pa.RecordBatch]:
        return [pa.RecordBatch.from_arrays([pa.array(c) if n else pa.array(c, kind) for n, c in enumerate(zip(*done, strict=True))], [by, *names])] if done else []

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, some, golds, owner, seen, taken, wrong = None, False, 0, {}, set(), set(), 0
        done: list[tuple] = []

        def finish() -> None:
            if some:
                tp, fp, fn = len(taken), wrong if golds else 0, golds - len(taken)
                p = tp / (tp + fp) if tp + fp else 0.0
                r = tp / (tp + fn) if tp + fn else 0.0
                f = 2 * p * r / (p + r) if p + r else 0.0
                done.append((case, tp, fp, fn, round(p, 4), round(r, 4), round(f, 4)))

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for of, side, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if of != case:
                    finish()
                    case, some, golds, owner, seen, taken, wrong = of, False, 0, {}, set(), set(), 0
                if not own:
                    continue
                if side == 0:
                    if owner.keys().isdisjoint(own):
                        owner.update(dict.fromkeys(own, golds))
                        golds, some = golds + 1, True
                elif seen.isdisjoint(own):
                    seen.update(own)
                    near, some = sorted({owner[k] for k in own if k in owner}), True
                    wrong += not near
                    taken.update([i for i in near if i not in taken][:1])
            yield from table_of(done, kind)
            done.clear()
        finish()
        yield from table_of(done, kind)

    ddl = f"`{by}` {dict(predicted.dtypes)[by]}, true_positive long, false_positive long, false_negative long, precision double, recall double, f1 double"
    return rows.mapInArrow(score, ddl)
