"""Queries take every row and the whole of each text: held against brute force on small tables."""

import re
from collections import Counter
from random import Random

import pytest
from helpers import DATA
from pyspark.sql import functions as F

from lodestone.functions import repair
from lodestone.operators import resolve, vectors
from lodestone.plans import catalogue


def union_find(pairs):
    """The smallest node of its component for every node."""
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def write_lines(spark, folder):
    """Order lines of every quantity, discount and tax, in many small groups of shared keys."""
    some = Random(1)
    rows = [(k // 3, k % 3, some.randrange(150), some.randrange(20), float(some.randrange(40, 51)), some.randrange(11) / 100, some.randrange(9) / 100, "ARN"[k % 3]) for k in range(240)]
    ddl = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/lineitem.parquet")
    return rows


def test_components_settle_after_many_rounds(spark):
    path = [0, *range(60, 0, -1)]  # the 0 moves one node a round towards the 1, whose label all others have
    edges = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long")
    got = {r.node: r.component for r in resolve.components(edges).collect()}
    assert got == dict.fromkeys(path, 0)


def test_components_of_a_long_shuffled_path(spark):
    names = list(range(2000))
    Random(7).shuffle(names)
    edges = spark.createDataFrame([*zip(names, names[1:], strict=False), (5000, 5000), (5001, 5002)], "a long, b long")
    got = {r.node: r.component for r in resolve.components(edges).collect()}
    assert got == dict.fromkeys(range(2000), 0) | {5000: 5000, 5001: 5001, 5002: 5001}


def test_entity_resolution_links_every_line(spark, tmp_path):
    rows = write_lines(spark, tmp_path)
    first, pairs = {}, []
    for order, line, part, supplier, quantity, _, _, flag in rows:
        for key in (("d", part, supplier, quantity), ("a", order, flag)):
            pairs.append((order * 10 + line, first.setdefault(key, order * 10 + line)))
    want = Counter(union_find(pairs).values())
    assert 1 < len(want) < len(rows)
    assert {r.entity: r.records for r in catalogue.QUERIES["entity_resolution"](spark, str(tmp_path)).collect()} == want


def test_components_link_every_line(spark, tmp_path):
    want = union_find((part * 2, order * 2 + 1) for order, _, part, *_ in write_lines(spark, tmp_path))
    assert {r.node: r.component for r in catalogue.QUERIES["components"](spark, str(tmp_path)).collect()} == want


def nearest(rows, k):
    """query_id, vec_id, score, rank by brute force for ids divisible by 50."""
    out = set()
    for q, x in rows:
        if q % 50 == 0:
            scores = sorted((-round(sum(a * b for a, b in zip(x, y, strict=True)), 6), v) for v, y in rows if v != q)
            out |= {(q, v, -s, n + 1) for n, (s, v) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("sizes", [(4096, 8192), (3, 70)])
def test_vectors_of_every_fiftieth_row(spark, monkeypatch, sizes):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", sizes[0])
    monkeypatch.setattr(vectors, "BLOCK", sizes[1])
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    got = {(r.query_id, r.vec_id, r.score, r.rank) for r in catalogue.QUERIES["vector_topk"](spark, DATA).collect()}
    assert got == nearest(rows, 5)
    asked = {r.query_id for r in catalogue.QUERIES["vector_recall_at_k"](spark, DATA).collect()}
    assert asked == {v for v, _ in rows if v % 50 == 0}


def test_vectors_of_missing_values_come_last(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.5, 1.0])], "vec_id long, embedding array<float>")
    got = vectors.similar(rows.filter("vec_id = 1").withColumnRenamed("vec_id", "query_id"), rows, 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 0.5), (2, None)]


def test_titles_are_normalised_and_compared_whole(spark, tmp_path):
    same = "a b c d e f g h i j " * 30
    rows = [(1, "en", same + "First tail\nx"), (2, "en", same + "wholly other words, 12345 and 67890 " * 30 + "\ny")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    titles = {r.doc_id: r.title for r in catalogue.QUERIES["normalize_title"](spark, str(tmp_path)).collect()}
    assert titles == {k: " ".join(re.findall("[a-z0-9]+", text.lower())) for k, _, text in rows}
    first, second = (text.split("\n")[0] for _, _, text in rows)
    want = spark.createDataFrame([(second, first)], "a string, b string").select(repair.title_similarity(F.col("a"), F.col("b"))).first()[0]
    got = catalogue.QUERIES["rows_only_seqmatch"](spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.similarity) for r in got] == [(2, round(want, 6))] and want < 0.9


def test_passages_are_planned_and_searched_whole(spark, tmp_path):
    words = [f"word{k}" for k in range(12)]
    texts = [(4, " ".join(words) + " survey of retrieval augmented generation"), (9, "x " * 20 + "dataset")]
    spark.createDataFrame(texts, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(1, words[11]), (2, " ".join(words[:6])), (3, " ".join(words)), *((k, f"other text {k}") for k in range(4, 12))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    plans = {r.item_id: r for r in run("query_plans")}
    assert plans[4].query_type == "survey" and "retrieval augmented generation" in plans[4].methods and plans[9].query_type == "dataset_constraint"
    assert {r.query_type: r.queries for r in run("query_types")} == {"survey": 1, "dataset_constraint": 1}
    assert {r.doc_id: r.phase for r in run("two_phase_search") if r.item_id == 4} == {1: 1, 2: 1, 3: 0}
    assert {r.doc_id for r in run("bm25_fields") if r.item_id == 4} == {1, 2, 3}


def test_previous_rows_across_blocks(spark):
    from lodestone.operators.search import with_previous

    data = [(k % 3 if k % 7 else None, k * k % 1009, f"v{k}") for k in range(400)] + [(1, None, "first"), (1, -50, "below")]
    rows = spark.createDataFrame(data, "g int, n int, v string").dropDuplicates(["g", "n"])
    want, last = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (str(r.g), -(10**9) if r.n is None else r.n)):
        want[(r.g, r.n)] = last.get(r.g)
        last[r.g] = r.v
    for width in (1, 64, 10**6):
        got = with_previous(rows, "g", "n", "v", "before", width)
        assert got.columns == ["g", "n", "v", "before"] and {(r.g, r.n): r.before for r in got.collect()} == want
