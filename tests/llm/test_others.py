import io
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA

from lodestone.llm import exact_topk, language_id, license_scan, packing, toxicity, warc
from lodestone.llm.common import fresh_path


def test_topk_ties_and_edges(spark):
    vectors = [(0, [0.5, 0.25]), (50, [0.0, -1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    good = exact_topk.quantized(df)
    got = defaultdict(list)
    for r in exact_topk.top_k(good.filter("vec_id % 50 = 0"), good, 3).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got[0]) == [(1, 1, 128 * 256), (2, 2, 128 * 256), (3, 7, 0)]
    assert sorted(got[50])[:2] == [(1, 1, 0), (2, 2, 0)]
    assert exact_topk.top_k(good.limit(0), good).count() == 0


def test_topk_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (400, 8))
    df = spark.createDataFrame([(k, (v / 256).tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(exact_topk, "CANDIDATES_A_BLOCK", 50)
    monkeypatch.setattr(exact_topk, "QUERIES_A_BLOCK", 3)
    good = exact_topk.quantized(df)
    got = sorted(tuple(r) for r in exact_topk.top_k(good.filter("vec_id % 50 = 0"), good).collect())
    want = []
    for q in range(0, 400, 50):
        s = x @ x[q]
        best = sorted((-int(s[c]), c) for c in range(400) if c != q)[:5]
        want += [(q, n + 1, c, -v) for n, (v, c) in enumerate(best)]
    assert got == sorted(want)


def test_topk_rejects_what_64_bits_cannot_hold(spark):
    for x in (1e300, 2.0**40):  # the weight itself, and the product
        good = exact_topk.quantized(spark.createDataFrame([(0, [x]), (1, [x])], "vec_id long, embedding array<double>"))
        with pytest.raises(Exception, match="LARGEST_WEIGHT|64 bits"):
            exact_topk.top_k(good, good).collect()


def test_topk_ignores_other_columns(spark):
    rows = [(0, [1.0], 5, "x", 1, 2), (1, [0.5], 6, "y", 3, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, weights int, block string, score int, query_id int")
    good = exact_topk.quantized(df)
    assert [tuple(r) for r in exact_topk.top_k(good.filter("vec_id % 50 = 0"), good).collect()] == [(0, 1, 1, 256 * 128)]


def test_profiles_are_the_same_in_small_pieces(monkeypatch):
    texts = ["some words of a text", "", "others, wholly unlike", "ab " * 50] * 7
    whole = language_id.Profiles(64).vectors(texts)
    monkeypatch.setattr(language_id, "GRAMS", 5)
    monkeypatch.setattr(language_id, "COUNT_CELLS", 12)
    assert (language_id.Profiles(64).vectors(texts) == whole).all()


def test_predictions_equal_brute_force(spark):
    """Prototypes and cosines by plain sums over trigrams."""
    texts = {"en": ["the cat and the dog", "a house by the sea", "they went there"], "de": ["der hund und die katze", "ein haus am meer", "sie gingen dorthin"]}
    rows = [(k * 3 + n, t, lang) for k, (lang, ts) in enumerate(texts.items()) for n, t in enumerate(ts)]
    docs = spark.createDataFrame([*rows, (90, "the sea and the house", None), (91, "und der dorthin", None)], "doc_id long, text string, lang string")
    p = language_id.Profiles(language_id.DIMENSIONS)

    def vector(text):
        s, v = f" {text} ", np.zeros(language_id.DIMENSIONS)
        for a, b, c in zip(s, s[1:], s[2:]):
            v += np.roll(p.letter(ord(a)), 2).astype(int) * np.roll(p.letter(ord(b)), 1) * p.letter(ord(c))
        return v / np.linalg.norm(v)

    prototypes = {lang: sum(map(vector, ts)) for lang, ts in texts.items()}
    for r in language_id.identify(docs, language_id.train(docs)).collect():
        text = {k: t for k, t, _ in docs.collect()}[r.doc_id]
        cosines = {lang: vector(text) @ v / np.linalg.norm(v) for lang, v in prototypes.items()}
        assert r.lang_pred == max(cosines, key=cosines.get) and abs(r.score - (1 + max(cosines.values())) / 2) < 1e-4


def test_profiles_bind_and_bundle():
    p = language_id.Profiles(64)

    def brute(text):
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        v = np.zeros(64)
        for a, b, c in zip(s, s[1:], s[2:]):
            v += np.roll(p.letter(ord(a)), 2).astype(int) * np.roll(p.letter(ord(b)), 1) * p.letter(ord(c))
        return v

    texts = ["Hello World, and 12 more", "a", "ab c!", "éàü x", "日本 語", "a\0b"]
    for text, made in zip(texts, p.vectors(texts), strict=True):
        assert (made == brute(text)).all()
    assert not p.vectors(["", "12 3", " "]).any()


def test_language_accuracy_and_edges(spark, edge, none):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in language_id.op5_language_id(spark, DATA).collect()}
    rows = docs.select("doc_id", "lang").collect()
    held = [r for r in rows if got[r.doc_id].held_out and r.lang]
    assert len(got) == len(rows) and np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 for k, r in got.items())
    model = language_id.train(docs)
    found = language_id.identify(edge, model).collect()
    assert len(found) == edge.count()
    assert {r.lang_pred for r in found if r.doc_id in (0, 1, 2)} == {language_id.UNKNOWN}
    assert language_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(edge, language_id.train(none)).collect()} == {language_id.UNKNOWN}


def test_warc_round_trip(spark):
    big = "<p>" + "é" * 200_000
    rows = [(1, "http://a", "x" * 100), (2, "http://b", "x" * 100), (3, None, "x" * 99), (4, "u\r\nv", "x" * 99), (5, "c", None), (6, "d", ""), (7, "e", big), (8, "f", big), (None, "g", "x" * 100), (9, "h", "WARC/1.1\r\n\r\n\x1f"), (1, "http://a", "x" * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    files = warc.write_warc(pages, fresh_path(spark, "test-warc"))
    got = warc.resolved(warc.read_warc(files, range_bytes=64)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[2].record_type, by[2].refers_to, by[2].payload_bytes) == ("response", "revisit", 1, 100)
    assert (by[3].record_type, by[4].record_type, by[5].payload_bytes, by[8].refers_to) == ("response", "response", 0, 7)
    assert by[8].payload_bytes == len(big.encode()) and by[None].refers_to == 1
    texts = {r.page_id: r.payload for r in warc.read_warc(files).filter("record_type = 'response'").collect()}
    assert texts[7].decode() == big
    assert warc.write_warc(pages.limit(0), fresh_path(spark, "test-warc")).count() == 0


def test_warc_reader_skips_false_magic():
    member = warc.record(1, "u", "<p>" * 50, "d", None)
    data = warc.MAGIC + b"junk" + member + member
    found = list(warc.Members(io.BytesIO(data), len(data)).owned(0, len(data)))
    assert len(found) == 2 and found[0].startswith(b"WARC/1.1")
    assert len(list(warc.Members(io.BytesIO(data), len(data)).owned(8, len(data)))) == 1


def test_warc_damage_is_an_error(spark):
    members = [warc.record(k, "u", f"<p>{k}" * 50, "d", None) for k in range(5)]
    cut = b"".join(members)[:-9]
    hurt = bytearray(b"".join(members))
    middle = len(members[0]) + len(members[1])
    hurt[middle + 40 : middle + 60] = b"\xff" * 20
    headless = bytearray(b"".join(members))
    headless[middle : middle + 2] = b"\0\0"
    for data in (cut, bytes(hurt), bytes(headless), b"junk" + b"".join(members)):
        with pytest.raises(warc.Damaged):
            list(warc.Members(io.BytesIO(data), len(data)).owned(0, len(data), strict=True))
    for data, left in ((cut, 4), (bytes(hurt), 4)):
        assert len(list(warc.Members(io.BytesIO(data), len(data)).owned(0, len(data)))) == left
    whole = b"".join(members)
    assert len(list(warc.Members(io.BytesIO(whole), len(whole)).owned(0, len(whole), strict=True))) == 5


def test_warc_ignores_other_columns(spark):
    rows = [(1, "u", "x" * 120, "d", 7, "p", 1, 2), (2, "u", "x" * 120, "d", 7, "p", 1, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first int, path string, refers_to long, bytes long")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.resolved(warc.read_warc(warc.write_warc(pages, fresh_path(spark, "test-warc")))).collect()}
    assert got == {1: ("response", None), 2: ("revisit", 1)}


def test_license_windows(spark, edge, none):
    known = license_scan.template_table(spark)
    filler = "lorem ipsum dolor sit amet consectetur " * 10
    text = "This work is licensed under the GNU General Public License, version 3"
    rows = [(k, " ".join((filler.split()[:k] + text.split() + filler.split()))) for k in range(40)] + [(99, "licensed under nothing at all"), (98, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in license_scan.license_scan(docs, known).filter("license = 'GPL-3.0'").collect()}
    assert found == set(range(40))
    assert {(r.doc_id, r.license) for r in license_scan.license_scan(edge, known).collect()} == {(15, "MIT")}
    assert license_scan.license_scan(none, known).count() == 0


def test_toxicity_learns(spark, edge, none):
    rng = np.random.default_rng(2)
    vocabulary = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(300)]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        text = list(rng.choice(vocabulary, 60)) + (list(rng.choice(["vile", "foul", "nasty"], 3)) if toxic else [])
        rows.append((k, " ".join(rng.permutation(text))))
        labels.append((k, int(k % 4 != 0), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, known.filter("doc_id < 400"))
    got = {r.doc_id: r.p_toxic for r in toxicity.score(docs, chain).collect()}
    assert np.mean([(got[k] >= toxicity.THRESHOLD) == bool(t) for k, _, t in labels if k >= 400]) > 0.95
    assert toxicity.score(edge, chain, keep=edge.columns).count() == edge.count()
    assert toxicity.score(none, chain).count() == 0
    assert toxicity.score(edge, toxicity.train(docs, known.limit(0))).filter("p_toxic BETWEEN 0 AND 1").count() == edge.count()


def test_whole_license_texts(spark, tmp_path, monkeypatch):
    """Templates of thousands of words, found where at least 80 % of their shingles lie within a window; both ways to filter."""
    rng = np.random.default_rng(4)
    draw = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    texts = {"Long-1.0": draw(3000), "Short-2.0": draw(200)}
    for name, made in texts.items():
        (tmp_path / f"{name}.txt").write_text(" ".join(made))
    known = license_scan.templates_from(spark, str(tmp_path))
    filler = draw(700)
    rows = [(1, [*filler, *texts["Long-1.0"], *filler]), (2, [*filler[:33], *texts["Short-2.0"]]), (3, texts["Long-1.0"][:1500]), (4, filler), (5, [*texts["Long-1.0"][:2900], *filler])]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id long, text string")
    for most in (license_scan.MOST_LITERAL, 10):
        monkeypatch.setattr(license_scan, "MOST_LITERAL", most)
        found = license_scan.license_scan(docs, known)
        assert {(r.doc_id, r.license) for r in found.collect()} == {(1, "Long-1.0"), (2, "Short-2.0"), (5, "Long-1.0")}


def letters_of(text):
    """A text's distinct words by brute force: runs of a-z and bytes above 127 after lower-casing A-Z."""
    return set(re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower()))


def word_hash(word):
    [(_, found, _)] = list(toxicity.letter_words(pa.array([word.decode()])))
    return int(found[0])


def test_chain_equals_brute_force(spark, edge):
    """Probabilities by plain sums over words, and the optimum that Newton's steps should have found."""
    docs = edge.unionByName(spark.createDataFrame([(100 + k, " ".join(("vile" if k % 3 == 0 else "fine", "w" + "abcdefg"[k % 7], "über" * (k % 2)))) for k in range(60)], "doc_id long, text string"), allowMissingColumns=True)
    known = spark.createDataFrame([(100 + k, None if k % 11 == 5 else int(k % 2), int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, known)
    got = {(r.doc_id, r.text): (r.p_quality, r.p_toxic) for r in toxicity.score(docs, chain, keep=["text"]).collect()}
    for (_, text), found in got.items():
        held, logits = {word_hash(w) for w in letters_of(text) if len(w) < 4000 and b"\xff" not in w}, []
        for link in chain:
            z = link.bias + sum(w for f, w in zip(link.features.tolist(), link.weights, strict=True) if f in held) + sum(a * b for a, b in zip(link.earlier, logits, strict=True))
            logits.append(max(-30.0, min(30.0, z)))
        assert np.allclose(found, [1 / (1 + np.exp(-z)) for z in logits])
    sets = {r.doc_id: {word_hash(w) for w in letters_of(r.text)} for r in docs.filter("doc_id >= 100").collect()}
    rows = [(sets[r.doc_id], r.quality) for r in known.collect() if r.quality is not None]
    link, slope = chain[0], np.zeros(len(chain[0].features) + 1)
    for held, y in rows:
        x = np.array([f in held for f in link.features.tolist()] + [True], float)
        slope += x * (y - 1 / (1 + np.exp(-(x[:-1] @ link.weights + link.bias))))
    assert np.abs(slope[:-1] - toxicity.RIDGE * link.weights).max() < 1e-4


def test_training_sample_is_bounded_and_stable(spark):
    docs = spark.createDataFrame([(k % 5, f"word{'abc'[k % 3]} {'vile' if k % 5 == 0 else 'good'}") for k in range(300)], "doc_id long, text string")
    known = spark.createDataFrame([(k, 1, int(k == 0)) for k in range(5)], "doc_id long, quality int, toxic int")
    a, b = (toxicity.train(d, known, rows=40) for d in (docs, docs.repartition(5)))
    assert all((x.features == y.features).all() and np.allclose(x.weights, y.weights) for x, y in zip(a, b, strict=True))


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_file())


def check_packed(pieces, texts, tokenizer):
    """pieces of documents with distinct ids against the tokenizer."""
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(parts) == set(texts)
    for doc, text in texts.items():
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(parts[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert bytes(r.ids) == ids[at : at + r.length].tobytes()
            at += r.length
        assert at == len(ids)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == packing.WINDOW or at & (at - 1) == 0 and at < packing.WINDOW


def test_packing(spark, edge, none, tokenizer):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(3)
    check_packed(packing.pack(docs, packing.tokenizer_file()).collect(), {r.doc_id: r.text for r in docs.collect()}, tokenizer)
    once = edge.dropDuplicates(["doc_id"])
    check_packed(packing.pack(once, packing.tokenizer_file()).collect(), {r.doc_id: r.text for r in once.collect()}, tokenizer)
    twice = packing.pack(edge, packing.tokenizer_file()).filter("start = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in twice}[5] == 2
    assert packing.pack(none, packing.tokenizer_file()).count() == 0


def test_encoder_equals_tokenizer(tokenizer):
    texts = ["<|ENDOFTEXT|> x", "<|endoftext|>It's we'll don't.'s x.s'", "ÀÉ é ΣΑΣ. İI ß fi ﬁ", "a\x0bb c\x1cd\x85f g", "...!?a.!b, 12.5% a1b2 x#y*z|q", "日本語 テスト。 नमस्ते", "😀😀a", "\x00a\x00", "", "a‍b é ́x", "Ⅷ ² x²"]
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert packing.Encoder(packing.tokenizer_file()).encode(texts) == want


def test_pour_leaves_no_padding():
    done = []
    left = packing.pour([("d", 0, b"\0\0\0\0" * 3000, 3000), ("e", 0, b"\0\0\0\0" * 7, 7)], done, tuple(2**k for k in range(12, -1, -1)))
    assert not left and [sum(len(p[2]) for p in s) // 4 for s in done] == [2048, 512, 256, 128, 32, 16, 8, 4, 2, 1]


def test_prototypes_are_bounded(spark, edge):
    assert all(v.shape == (language_id.DIMENSIONS,) for v in language_id.train(edge).values())
