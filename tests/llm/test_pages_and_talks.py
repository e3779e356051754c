"""Conversation repair, whitening and HTML extraction: edges, brute force, and sites without any marks."""

import heapq
import html as htmllib
import random
import re

import duckdb
import numpy as np
import pytest
from helpers import DATA

from lodestone.llm import conversations, sitestyle, whitening

TALK = "conv_id long, turn long, role string, text string, edit string, position int, audit string, phase int"


def talk_rows():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "open end", "", " \t", "Same text.", "long " * 30_000 + ".", None]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts), "K", 1, "x", 2) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(90, None, "user", "Hi.", None, None, None, None), (90, None, "user", "Hi.", None, None, None, None), (90, 3, "user", "Hi.", None, None, None, None)]
    rows += [(None, 0, "user", "Hi.", None, None, None, None), (None, None, "assistant", "So.", None, None, None, None), (91, 1, "user", "a.", "", 0, "", 0), (91, 1, "assistant", "b.", "", 0, "", 0)]
    return rows


def test_cheapest_is_the_cheapest_path():
    """Against a search over whole edit strings."""
    rng = random.Random(11)
    for _ in range(150):
        n = rng.randint(0, 5)
        initials = "".join(rng.choice("suat") for _ in range(n))
        faults = bytes(rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        heap, best = [(0, "", 0, "")], None
        while heap:
            cost, audit, row, roles = heapq.heappop(heap)
            if row == n and re.fullmatch("(s?(ua)+)?", roles):
                best = (cost, audit)
                break
            if len(audit) > 2 * n + 2:
                continue
            steps = [(3, "I", 0, "u"), (3, "I", 0, "a")]
            if row < n:
                steps.append((4, "D", 1, ""))
                if faults[row] in (0, 3):
                    more = 3 * (faults[row] == 3)
                    steps += [(more, "K", 1, initials[row]), (3 + more, "R", 1, "u"), (3 + more, "R", 1, "a")]
            for price, edit, used, role in steps:
                if re.fullmatch("s?(ua)*u?", roles + role):
                    heapq.heappush(heap, (cost + price, audit + edit, row + used, roles + role))
        assert conversations.cheapest(initials, faults) == best


def test_repair_edges_equal_sql(spark):
    rows = talk_rows()
    given = spark.createDataFrame(rows, TALK).repartition(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    found = conversations.digests(conversations.repair(conversations.damaged(given), given))
    from helpers import assert_same

    assert_same(found, con, conversations.ORACLE_SQL["op11_conversation_repair"])


def test_repair_gives_the_rows_themselves(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why?"), (1, 3, "user", "Why?"), (1, 4, "assistant", "So.")]
    found = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).orderBy("position").collect()
    assert found[0].audit == "KIKKDK" and found[0].cost == 7 and found[0].duplicate == 1
    assert [(r.role, r.text) for r in found[1:] if r.role] == [("system", "Be kind."), ("user", ""), ("assistant", "Hello."), ("user", "Why?"), ("assistant", "So.")]
    assert [r.fault for r in found[1:]] == [0, None, 0, 0, 2, 0]


def test_repair_without_rows(spark):
    none = spark.createDataFrame([], TALK)
    assert conversations.digests(conversations.repair(conversations.damaged(none), none)).count() == 0
    only = spark.createDataFrame([(7,)], "conv_id long")
    head = conversations.digests(conversations.repair(none.select("conv_id", "turn", "role", "text"), only)).first()
    assert (head.conv_id, head.gaps, head.audit, head.cost) == (7, 0, "", 0)
    assert head.repaired_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_hot_conversation_streams(spark):
    """One conversation of a third of all rows, all of one text."""
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "Again.") for t in range(3000)] + [(c, 0, "user", "Hi.") for c in range(2, 5000)]
    found = conversations.digests(conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    head = found.filter("conv_id = 1").first()
    assert head.audit == "KK" + "D" * 2998 and head.duplicate == 2998 and found.count() == 4999


VECTORS = "vec_id long, embedding array<float>, n long, x string, component int"


def whitened_by_numpy(vectors, k=16):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    v = (fit - total / n).T @ (fit - total / n) / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, ((n * x - total) ** 2).sum(1), (x - total / n) @ axes / np.sqrt(values), values / np.trace(v)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))).astype(np.float32).tolist()
    rows = [(k, v, 1, "x", 2) for k, v in enumerate(good)]
    rows += [(900, good[3], None, None, None), (None, good[4], None, None, None), rows[7]]
    kept = good + [good[3], good[4], good[7]]
    rows += [(901, None, None, None, None), (902, [1.0, None], None, None, None), (903, [float("nan")] * 20, None, None, None), (904, [float("inf")] + [0.0] * 19, None, None, None)]
    found = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    n, deviations, expected, explained = whitened_by_numpy(kept)
    assert len(found) == 16 * len(kept) and {r.n for r in found} == {n} and n == 300
    ids = list(range(300)) + [900, None, 7]
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.component), []).append(r)
    signs = np.sign([got[0, c + 1][0].whitened * expected[0, c] for c in range(16)])
    for at, vec_id in enumerate(ids):
        for c in range(16):
            for r in got[vec_id, c + 1]:
                assert r.deviation == int(deviations[at]) and abs(r.whitened - signs[c] * expected[at, c]) < 1e-6
                assert abs(r.explained - explained[c]) < 1e-9 and r.identity_error < 1e-9


def test_whitening_query_equals_numpy(spark):
    found = whitening.op12_whitening(spark, DATA).toPandas()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' WHERE embedding IS NOT NULL").fetchall()
    n, deviations, expected, _ = whitened_by_numpy([v for _, v in rows])
    table = found.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    signs = np.sign((table * expected).sum(0))
    assert np.abs(table * signs - expected).max() < 1e-6 and set(found.n) == {n}
    assert found[found.component == 1].set_index("vec_id").deviation.loc[[i for i, _ in rows]].tolist() == [int(d) for d in deviations]


@pytest.mark.parametrize("rows", [[], [(1, None, 1, "", 1)], [(1, [0.5, 0.5], 1, "", 1)], [(k, [0.25], 1, "", 1) for k in range(4)], [(1, [], 1, "", 1)]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0


def test_whitening_drops_the_null_space_and_refuses_ragged(spark):
    line = [(k, [float(k), 2.0 * k, 0.0], 1, "", 1) for k in range(9)]
    assert {r.component for r in whitening.whiten(spark.createDataFrame(line, VECTORS)).collect()} == {1}
    with pytest.raises(Exception, match="differ in length"):
        whitening.whiten(spark.createDataFrame([*line, (10, [1.0], 1, "", 1)], VECTORS)).count()
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(spark.createDataFrame([*line, (10, [1e30, 0.0, 0.0], 1, "", 1)], VECTORS)).count()


def test_merged_moments_are_those_of_all_rows():
    rng = np.random.default_rng(2)
    y = rng.integers(-5000, 5000, (1000, 7))
    parts = [whitening.Moments.of(p) for p in np.split(y, [1, 40, 500])]
    merged = parts[0].merged(parts[1]).merged(parts[2].merged(parts[3]))
    assert merged.n == 1000 and merged.sums == y.sum(0).tolist()
    assert np.allclose(merged.scatter / 1000, np.cov(y.T, bias=True), rtol=1e-12)
    big = whitening.Whitening(1 << 40, [0, 0], np.zeros((2, 1)), np.zeros(1))
    with pytest.raises(OverflowError):
        big.deviations(big.gaps(np.array([[1 << 30, 1]])))


def plain_article(page):
    """What these pages hold between <article> and </article>."""
    inside = re.search("<article>(.*)</article>", page or "", re.S)
    blocks = re.split("</?(?:p|h1)>", inside.group(1)) if inside else []
    texts = [" ".join(htmllib.unescape(re.sub("</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_extraction_query_equals_brute_force(spark):
    found = {r.page_id: r for r in sitestyle.op13_html_extraction(spark, DATA).collect()}
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{DATA}/pages.parquet'").fetchall()
    assert len(found) == len(rows)
    for page_id, url, page in rows:
        assert (found[page_id].text, found[page_id].url, found[page_id].n_chars) == (plain_article(page), url, len(plain_article(page)))


def text_of(page):
    return sitestyle.main_text(page, None)[0]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("just text &amp; more &lt;b&gt;", "just text & more <b>"),
        ("<p>one<p>two<br>three</p>four", "one\n\ntwo three\n\nfour"),
        ("<article><h1> A\n title </h1><p><b>x &am y<br><p>z &copy;</article>", "A title\n\nx &am y\n\nz ©"),
        ("<body><nav>m</nav><header>h</header><article><header><h1>T</h1></header><p>a<aside>s</aside><footer>f</footer></article><p>out", "T\n\na"),
        ("<form><div class=content><article><p>kept<form><p>search</form></article></div></form>", "kept"),
        ("<div class='ad-box'>x</div><div id=comments><article>reader</article></div><p class=notice>n</p><p class=noticed>yes", "yes"),
        ("<script>var a='<p>no</p>'</script ><style>p{}</style><!-- <p>no --><p>yes<!--> <i>it</i> <!-- open", "yes it"),
        ("<p>a<span class='share'>tweet</span>b</p><ul><li>one<li>two</ul>", "ab\n\none\n\ntwo"),
        ("<select><option>x</select><button>go</button><textarea><p>x</textarea><svg><text>x</text></svg>ok", "ok"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
        ("<a title=it's href=x>ok</a> < 5 </ >!<?php x ?>", "ok < 5 !"),
        ("<title>t</title><p>x</p" , "x"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<p>&nbsp;a　b&#10;c</p>", "a b c"),
        ("<noscript><p>no</noscript><main><section><h2>s</h2><p>t</section></main><div role=banner>b</div>", "s\n\nt"),
    ],
)
def test_main_text_of_odd_pages(page, text):
    assert text_of(page) == text


PAGES = "page_id long, url string, html string, host string, page string, low int, text string, nodes int"


def unmarked_site(n, seed=4):
    """Pages of plain divs: an article that differs, a frame that does not."""
    rng = random.Random(seed)
    rows, texts = [], {}
    for k in range(n):
        parts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(12)) for _ in range(rng.randint(1, 6))]
        story = "".join(f"<div>{p}</div>" for p in parts)
        frame = "<div><span>Home</span> <span>News</span></div>", f"<div><div>Call us</div><div>Offer {k % 3}</div></div>"
        rows.append((k, f"http://plain.example/{k}", f"<html><body>{frame[0]}<div><div>{story}</div></div>{frame[1]}</body></html>", "h", "p", 1, "t", 2))
        texts[k] = "\n\n".join(parts)
    return rows, texts


@pytest.mark.parametrize("most_shipped", [sitestyle.MOST_SHIPPED, 0])
def test_style_tree_finds_articles_without_marks(spark, most_shipped):
    rows, texts = unmarked_site(80)
    rows += [(500, None, rows[0][2], None, None, None, None, None), (501, "http://plain.example/x", None, None, None, None, None, None), rows[3], (None, None, None, None, None, None, None, None)]
    found = sitestyle.extract(spark.createDataFrame(rows, PAGES).repartition(4), most_shipped).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.page_id is not None and r.page_id < 80:
            assert r.text == texts[r.page_id] and r.style_cut == 3 and r.name_cut == 0
    by_id = {r.page_id: r for r in found}
    assert by_id[501].text == "" == by_id[None].text and by_id[500].text.startswith("Home News")


def test_copies_of_an_article_stay(spark):
    """Half of a site's pages copy one article; the other half differ. Nothing of either goes."""
    rows, texts = unmarked_site(40)
    story = rows[0][2]
    rows += [(100 + k, f"http://plain.example/c{k}", story.replace("Offer 0", f"Offer {k % 3}").replace("</body>", f"<!--{k}--></body>"), "", "", 0, "", 0) for k in range(40)]
    found = {r.page_id: r.text for r in sitestyle.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(found[k] == texts[k] for k in range(40)) and all(found[100 + k] == texts[0] for k in range(40))


def test_extraction_without_rows(spark):
    assert sitestyle.extract(spark.createDataFrame([], PAGES)).count() == 0
    assert sitestyle.extract(spark.createDataFrame([(1, None, None, "", "", 0, "", 0)], PAGES)).first().text == ""


def test_few_pages_lose_nothing(spark):
    rows, texts = unmarked_site(3)
    found = sitestyle.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert all(texts[r.page_id] in r.text and r.style_cut == 0 for r in found)


def test_another_tokenizer_is_refused():
    """Runs are split as one tokenizer splits; any other would give wrong ids."""
    from pathlib import Path

    from lodestone.llm import packing

    own = Path(packing.tokenizer_file())
    packing.Encoder(str(own))
    with pytest.raises(ValueError, match="another way"):
        packing.Encoder(str(own.with_name("byte_bpe_50k.json")))
