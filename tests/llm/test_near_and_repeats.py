import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA

from lodestone.llm import bwt, near_dedup, repeats
from lodestone.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(docs):
    sets = {k: shingles(t) for k, t in docs}
    near = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            near[x].append(k)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = Counter((a, b) for ids in near.values() for i, b in enumerate(ids) for a in ids[:i])
    for (a, b), both in pairs.items():
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_rows(rng, families=6, copies=40):
    """Families of edited copies, some on either side of the threshold."""
    docs = []
    for _ in range(families):
        base = ["w%d" % rng.randint(0, 10**6) for _ in range(150)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 6))):
                text[rng.randint(0, 149)] = "z%d" % rng.randint(0, 10**6)
            docs.append((len(docs), " ".join(text)))
    return docs


def compare(docs, got):
    want = brute_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_dedup_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    compare([tuple(r) for r in docs.collect()], near_dedup.near_dedup(docs).collect())


def test_near_dedup_on_families(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    docs = near_rows(random.Random(3))
    compare(docs, near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect())


def test_near_dedup_edges(edge, none):
    named = {r.doc_id: r for r in near_dedup.near_dedup(edge).collect() if r.doc_id is not None}
    want = brute_components([(r.doc_id, r.text) for r in edge.dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL").collect()])
    assert {k: (r.n_shingles, r.component_id) for k, r in named.items()} == want
    assert [named[k].n_shingles for k in (0, 1, 2, 3)] == [0, 0, 0, 1]
    assert near_dedup.near_dedup(none).count() == 0


def test_posterior_bounds():
    least = near_dedup.least_matches(85, 1e-6)
    assert list(least) == sorted(least) and all(0 < least[n] < 0.85 * n for n in least)
    same = np.zeros((1, near_dedup.HASHES), np.uint8)
    assert len(near_dedup.surviving(same, same, least)) == 1 and len(near_dedup.surviving(same, same + 1, least)) == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 2), (9, 8), (5, 5)] + [(100 + k, 101 + k) for k in range(40)] + [(1000, 1000 + k) for k in range(1, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert (got[2], got[3], got[9], got[140], got[1299]) == (1, 1, 8, 100, 1000)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts):
    length = repeats.LENGTH
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        removed = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                removed[i : i + length] = True
        kept = np.frombuffer(d, np.uint8)[~removed].tobytes()
        out.append((len(d), int(removed.sum()), int((np.diff(np.concatenate(([0], removed.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [64, 1])
def test_repeats(spark, edge, none, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    for docs in (spark.read.parquet(f"{DATA}/documents.parquet"), edge):
        rows = docs.collect()
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect())
        want = sorted((r.doc_id if r.doc_id is not None else -1, *w) for r, w in zip(rows, brute_repeats([r.text for r in rows]), strict=True))
        assert got == want
    assert repeats.remove_repeats(none).count() == 0


def test_transforms_merge_to_the_whole(monkeypatch):
    rng = np.random.default_rng(0)
    for _ in range(40):
        step, depth = int(rng.integers(1, 4)), int(rng.integers(1, 4))
        monkeypatch.setattr(bwt, "STEP", step)
        monkeypatch.setattr(bwt, "DEPTH", depth)
        strings = [bytes(rng.integers(97, 99, int(rng.integers(step * depth, 30))).astype(np.uint8)) for _ in range(int(rng.integers(1, 8)))]
        grams, first, last = [], [], []
        for s in strings:
            first.append(sum(map(len, grams)))
            grams.append(np.array([int.from_bytes(s[i : i + step].ljust(4, b"\0"), "big") if i + step <= len(s) else 0 for i in range(len(s) + 1)], np.uint64))
            last.append(sum(map(len, grams)))
        count = Counter(s[i : i + step * depth] for s in strings for i in range(len(s) - step * depth + 1))
        want = [f + i for f, s in zip(first, strings, strict=True) for i in range(len(s) - step * depth + 1) if count[s[i : i + step * depth]] > 1]
        for shards in (1, 2, 3):
            assert bwt.repeated(np.concatenate(grams), np.array(first), np.array(last), shards).tolist() == want


def test_word_hashes_ignore_case_and_blanks():
    from lodestone.llm.wordhash import shingles as hashed
    from lodestone.llm.wordhash import text_slices, words

    column = pa.array(["a b c d e f", " A\tB\nc  d e F ", None, "", "a b"])
    [(_, data, offsets)] = list(text_slices(column))
    made, ends = hashed(*words(data, offsets))
    rows = [made[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert rows[0] == rows[1] and len(rows[0]) == 2 and rows[2] == rows[3] == [] and len(rows[4]) == 1


def thue_morse(n):
    """Words over ab whose polynomial hashes modulo 2**64 agree with those of their complements."""
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


SWAPPED = str.maketrans("ab", "ba")


def test_words_with_equal_polynomial_hashes_stay_apart(spark):
    rng, docs = random.Random(8), []
    for n in (32, 64, 65, 1024, 2048):
        for word in (thue_morse(n), thue_morse(n).translate(SWAPPED)):
            docs += [word, f"{word} one two three four five six seven", " ".join(rng.choice("cdef") for _ in range(30)) + f" {word}"]
    docs = [(k, t) for k, t in enumerate(docs)] + [(100, docs[1].upper()), (101, f"\t{docs[3]}\n")]
    compare(docs, near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect())


def test_near_dedup_of_a_repeated_id(spark):
    """Rows that repeat a doc_id are one document: it has the links of each of its texts."""
    rng = random.Random(9)
    one, two = (" ".join("w%d" % rng.randint(0, 10**6) for _ in range(100)) for _ in range(2))
    docs = [(5, one), (5, two), (3, one + " x"), (7, two + " x"), (9, "something else")]
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {5: 3, 3: 3, 7: 3, 9: 9}


def test_repeats_with_equal_polynomial_hashes_stay(spark):
    texts = [thue_morse(4096), thue_morse(2048).translate(SWAPPED) + "c", "x" * 40 + thue_morse(1024) + "y" * 300, "ab" * 300]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute_repeats(texts)))


def test_gram_ranks_are_those_of_the_bytes(monkeypatch):
    data = np.frombuffer(("abcab" * 40 + thue_morse(200)).encode(), np.uint8)
    rows = [bytes(data[k : k + 25]) for k in range(len(data) - 24)]
    for hashes in (None, np.zeros(len(rows), np.uint64)):  # all collide
        ranks = repeats.gram_ranks(data, 25, hashes)
        assert len(set(zip(rows, ranks.tolist(), strict=True))) == len(set(rows)) == len(set(ranks.tolist())) and ranks.min() == 1


def test_copies_are_dealt_to_strangers_only(spark):
    """One large label and few strangers: rows grow with the copies, and every pair of different labels meets once or more."""
    from lodestone.llm import near_dedup

    rows = [(7, k, 0) for k in range(3000)] + [(7, 5000 + k, 5000 + k) for k in range(9)] + [(8, k, k % 2) for k in range(600)]
    dealt = near_dedup.dealt_rows(spark.createDataFrame(rows, "key long, node long, label long")).collect()
    of = lambda key: [r for r in dealt if r.key == key]
    assert sum(r.label == 0 for r in of(7)) == 3000 and len(of(7)) == 3000 + 9 * 13
    met = set()
    cells = {}
    for r in dealt:
        cells.setdefault((r.key, r.i, r.j), []).append(r)
    for (key, i, j), held in cells.items():
        pairs = ((a, b) for a in held for b in held) if key == 8 or i == j else ((a, b) for a in held if a.block == i for b in held if b.block == j)
        met |= {(key, min(a.node, b.node), max(a.node, b.node)) for a, b in pairs if a.label != b.label and {a.block, b.block} == {i, j}}
    want = {(7, a, b) for a in range(3000) for b in range(5000, 5009)} | {(7, a, b) for a in range(5000, 5009) for b in range(a + 1, 5009)}
    want |= {(8, a, b) for a in range(600) for b in range(a + 1, 600) if a % 2 != b % 2}
    assert met == want


def below_rows(rng, copies=200):
    """Copies of one text with 3 of 300 words changed: most pairs are 82 % alike, a few are links, all pass the pruning."""
    base = ["w%d" % rng.randint(0, 10**6) for _ in range(300)]
    docs = []
    for k in range(copies):
        text = list(base)
        for at in rng.sample(range(300), 3):
            text[at] = "z%d" % rng.randint(0, 10**6)
        docs.append((k, " ".join(text)))
    return docs


def test_near_copies_below_the_threshold_make_no_rows_by_pairs(spark, monkeypatch):
    made, plain = {}, near_dedup.materialize

    def counted(df, label):
        out = plain(df, label)
        made[label] = max(made.get(label, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    docs = below_rows(random.Random(11))
    compare(docs, near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())
    assert made["possible"] <= made["dealt"] and max(made.values()) <= 2 * near_dedup.BANDS * len(docs), made  # 11,104 rows when pairs were rows


@pytest.mark.parametrize("most", [1, 5000])
def test_near_dedup_in_parts_of_texts(spark, monkeypatch, most):
    """Block pairs whose texts are too many for a cell are dealt to pairs of parts; no link is lost."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "CELL_SHINGLES", most)
    docs = below_rows(random.Random(12), 60) + [(1000 + k, t) for k, t in near_rows(random.Random(4), 3, 30)]
    compare(docs, near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())


def test_links_of_a_cell_join_each_label_once():
    """All of 12 members are mates, the first four of one label: 8 links leave, not 60."""
    text = " ".join("w%d" % k for k in range(30))
    rows = [{"key": 1, "i": 0, "j": 0, "u": 0, "v": 0, "part": 0, "node": k, "label": max(k, 3), "place": k, "text": text + f" x{k}", "mates": np.packbits(np.arange(12) > k).tobytes()} for k in range(12)]
    found = near_dedup.link_cell(pa.Table.from_pylist(rows)).to_pylist()
    assert len(found) == 8 and {max(r[x], 3) for r in found for x in "ab"} == set(range(3, 12))
    assert near_dedup.link_cell(pa.Table.from_pylist(rows).slice(0, 0)).num_rows == 0


def test_a_repeated_id_in_the_last_round(spark):
    """The bands of an id's other text do not name the bucket; they must not stop the cell."""
    rng = random.Random(13)
    docs = below_rows(rng, 40)
    docs = [(k + 1, t) for k, t in docs] + [(0, docs[0][1] + " end"), (0, " ".join("v%d" % rng.randint(0, 10**6) for _ in range(296)))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_components(docs[:-1])
    assert got == {k: c for k, (_, c) in want.items()}
