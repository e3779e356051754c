import hashlib
from collections import defaultdict

from helpers import DATA
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, mixing


def test_chunks_join_to_the_text(spark, edge):
    rows = edge.select("text", F.array_join(exact_dedup.chunks(F.col("text")), "").alias("joined"), F.size(exact_dedup.chunks(F.col("text"))).alias("n")).collect()
    assert all(r.text == r.joined for r in rows if r.text is not None)
    assert max(r.n for r in rows if r.text) > 20


def check(rows, got):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    seen = defaultdict(int)
    for g in got:
        seen[g.text_sha256] += g.kept
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        mine = [g for g in got if g.text_sha256 == sha]
        assert len(mine) == len(ids) and seen[sha] == 1
        best = max((i for i in ids if i is not None), default=None)
        assert all((g.keep_id, g.group_size) == (best, len(ids)) for g in mine)
        assert next(g.doc_id for g in mine if g.kept) == best


def test_edge_rows(edge, none):
    check(edge.collect(), exact_dedup.exact_dedup(edge).collect())
    assert exact_dedup.exact_dedup(none).count() == 0


def test_shared_names_are_found_and_left(edge):
    weak = (lambda c: F.length(c).cast("long"), lambda c: F.substring(c, 1, 3), lambda c: c)
    assert exact_dedup.names_are_shared(edge.filter("text IS NOT NULL").select("text"), weak[0])
    check(edge.collect(), exact_dedup.exact_dedup(edge, weak).collect())


def test_only_shared_names_are_strengthened(spark, edge):
    texts = spark.createDataFrame([("aa 1",), ("bb 1",), ("unlike",)], "text string")
    weak = (lambda c: F.length(c).cast("long"), lambda c: F.substring(c, 1, 2), lambda c: c)
    naming = exact_dedup.verified(texts, weak)
    assert {r.text: r.n for r in texts.select("text", naming(F.col("text")).alias("n")).collect()} == {"aa 1": "1:aa", "bb 1": "1:bb", "unlike": "0:6"}
    assert exact_dedup.verified(texts) is exact_dedup.NAMINGS[0]


def test_many_shared_names_change_all(edge, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_SHARED", 0)
    check(edge.collect(), exact_dedup.exact_dedup(edge, (lambda c: F.length(c).cast("long"), lambda c: c)).collect())


def targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        out = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        over = {s for s in names if s not in capped and out[s] > 2 * sizes[s]}
        if not over:
            return out
        capped |= over


def check_mix(got):
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = targets(sizes)
    block = max(1, 1.5 * sum(sizes.values()) / 2**14)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 2 * block + 3


def test_mix_reaches_targets(spark, edge, none):
    check_mix(mixing.mix(edge).collect())
    assert mixing.mix(none).count() == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mix(docs)
    check_mix(got.collect())
    again = mixing.mix(docs.repartition(7))
    assert got.exceptAll(again).count() == 0


def test_slots_are_the_order_of_the_mix(spark):
    """A source's documents come up, by slot, in the order of their ids' hashes, once and then again; sources alternate."""
    rows = [(k, " ".join(["w"] * (200 + k)), "ab"[k % 2]) for k in range(60)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert {r.doc_id: len(r.slots) for r in got if r.taken == 2 * r.size} == {r.doc_id: 2 for r in got if r.taken == 2 * r.size}
    assert all(bool(r.slots) == bool(r.taken) for r in got)
    for source in "ab":
        mine = sorted((r for r in got if r.source == source and r.slots), key=lambda r: hashlib.md5(str(r.doc_id).encode()).hexdigest())
        line = [r.slots[0] for r in mine] + [r.slots[1] for r in mine if len(r.slots) > 1]
        assert line == sorted(line) and len(mine) > 10
    firsts = [r.source for r in sorted((r for r in got if r.slots), key=lambda r: r.slots[0])]
    assert {*firsts[:6]} == {"a", "b"}


def test_mix_of_many_sources_and_repeated_rows(spark):
    rows = [(None if k % 7 == 0 else k % 90, " ".join(["w"] * (k % 40)), f"host{k % 50}" if k % 50 else None) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs)
    check_mix(got.collect())
    pick = ["doc_id", "source", "size", "taken", "slots"]
    assert got.select(pick).exceptAll(mixing.mix(docs.repartition(6)).select(pick)).count() == 0


def test_mix_without_words(spark, edge):
    rows = mixing.mix(edge.filter("text IS NULL OR trim(text) = ''")).collect()
    assert rows and all(r.taken == 0 for r in rows)


def test_schedule_is_even(spark):
    t = spark.createDataFrame([("a", 50.0), ("b", 30.0), (None, 20.0)], "source string, target double")
    rows = mixing.schedule(t, 14).collect()
    n = defaultdict(list)
    for r in rows:
        n[r.source].append((r.slot, r["rank"]))
    assert len(rows) == 2**14
    for s, share in (("a", 0.5), ("b", 0.3), (None, 0.2)):
        assert abs(len(n[s]) - share * 2**14) <= 1
        assert [r for _, r in sorted(n[s])] == list(range(len(n[s])))
