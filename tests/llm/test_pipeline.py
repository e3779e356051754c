from collections import Counter, defaultdict

import corpus_pipeline
from helpers import DATA
from test_near_and_repeats import brute_components

from lodestone.llm import mixing, toxicity
from lodestone.llm.common import materialize


def test_stages_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, kept, DATA), f"test-{name}")
        if name != "packing":
            assert out.columns == docs.columns
        steps[name] = (kept, out)
        kept = out
    before, after = steps["toxicity"]
    chain = toxicity.train(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {r.doc_id: r.p_toxic for r in toxicity.score(before, chain).collect()}
    assert {r.doc_id for r in after.collect()} == {k for k, p in scores.items() if p < toxicity.THRESHOLD}
    before, after = (x.collect() for x in steps["exact_dedup"])
    largest = defaultdict(int)
    for r in before:
        largest[r.text or ""] = max(largest[r.text or ""], r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(largest.values())
    before, after = (x.collect() for x in steps["near_dedup"])
    component = brute_components([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(k for k, (_, c) in component.items() if k == c)
    mixed = mixing.mix(steps["mixing"][0]).collect()
    wanted = [(slot, r.doc_id) for r in mixed if r.size for slot in (r.slots + r.slots[-1:])[: int(r.taken / r.size + 0.5)]]
    wanted += [(2**62, r.doc_id) for r in mixed if not r.size]
    assert [r.doc_id for r in steps["mixing"][1].collect()] == [k for _, k in sorted(wanted)]
    mixed = Counter(r.doc_id for r in steps["mixing"][1].collect())
    assert max(mixed.values()) <= 2
    tokens = defaultdict(int)
    for r in steps["packing"][1].collect():
        tokens[r.doc_id] += r.length
    assert set(tokens) == set(mixed)


def test_edge_rows_go_through(spark, edge):
    """Rows that repeat an id, or have none, are dropped and kept one by one."""
    docs, rows = edge, Counter((r.doc_id, r.text) for r in edge.collect())
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, DATA), "test-edge")
        if name == "exact_dedup":
            rows = Counter((r.doc_id, r.text) for r in before.collect())
            best = {}
            for doc, text in rows:
                best[text or ""] = max(best.get(text or "", -1), -1 if doc is None else doc)
            assert Counter((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect()) == Counter((d, t) for t, d in best.items())
        if name == "near_dedup":
            texts = [(k, r.text) for k, r in enumerate(before.collect())]
            groups = brute_components(texts)
            got = Counter(r.text for r in docs.collect())
            assert sum(got.values()) == len({c for _, c in groups.values()})
            assert {groups[k][1] for k, t in texts if t in got} == {c for _, c in groups.values()}
    assert docs.count() > 0


def test_near_copies_go_row_by_row(spark):
    base, other = (" ".join(f"{w}{k}" for k in range(60)) for w in "ab")
    rows = [(1, base), (1, other), (2, base + " x"), (None, base + " y"), (None, "alone here"), (None, None)]
    docs = spark.createDataFrame([(*r, "s", 1.0) for r in rows], "doc_id long, text string, source string, p_toxic double")
    got = corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()
    assert sorted(len(r.text or "") for r in got if (r.text or "")[:2] != "a0") == sorted(map(len, (other, "alone here", "")))
    assert sum((r.text or "")[:2] == "a0" for r in got) == 1
    assert corpus_pipeline.drop_toxic(spark, docs, DATA).columns == docs.columns


def test_empty_table(spark, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, DATA), "test-none")
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)
        docs = out


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
