"""Main text of web pages by site style trees: pages of a host merged, branches of low entropy removed from each page."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import e

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table
from lodestone.llm.dom import BLOCKS, Element, parse, run_text

GAMMA = 0.9  # how far a branch's importance comes from its parts rather than from its own layouts
LOW = 0.8  # importance below which a branch is removed
PRIOR_PAGES = 30  # pages' worth of belief that a branch matters: text that is the same everywhere is removed from eight pages on
FOLD = 32  # elements nested deeper are measured as one leaf of their ancestor at this depth
MOST_SHIPPED = 1_000_000  # low branches sent to every task, 16 bytes each; more are joined page by page
ROWS_A_BATCH = 256
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
TREES = "host long, page binary, nodes array<struct<node: long, parent: long, style: long, depth: int, styles: array<long>, features: array<struct<feature: long, times: int>>>>"

# Names by which pages mark parts that are not their article, and parts that are.
NOISE_TAGS = frozenset("nav aside footer form dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form status toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion respond share sharing sidebar social sponsor "
    "sponsored subscribe subscription toolbar widget".split()
)
HEADER_WORDS = frozenset("header site page top main global".split())
ARTICLE_ROLES = frozenset(("main", "article"))
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd blockquote pre listing address table caption colgroup thead tbody tfoot tr td th figure figcaption".split())
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"\d+")


def is_noise(tag: str, attributes: dict[str, str]) -> bool:
    """Whether an element names itself a menu, header, footer, sidebar, notice, advert, form or reader comments."""
    if tag in NOISE_TAGS or attributes.get("role") in NOISE_ROLES:
        return True
    for value in (attributes.get("class", ""), attributes.get("id", "")):
        for name in value.split():
            words = _WORD.findall(name)
            if not NOISE_WORDS.isdisjoint(words) or ("header" in words and HEADER_WORDS.issuperset(words)):
                return True
    return False


def is_article(element: Element) -> bool:
    return element.tag in ("article", "main") or element.attributes.get("role") in ARTICLE_ROLES or element.attributes.get("itemprop") == "articlebody"


def _id(*parts) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _key(child: Element | list) -> str:
    if isinstance(child, list):
        return "#text"
    if "class" not in child.attributes:
        return child.tag
    return ".".join([child.tag, *sorted({_NUMBER.sub("#", c) for c in child.attributes.get("class", "").split()})])


def shown(element: Element) -> list:
    """Children without runs of white space."""
    return [c for c in element.children if isinstance(c, Element) or not all(map(str.isspace, c))]


def styled(root: Element) -> Iterator[tuple]:
    """(child, node, parent node, style of the parent, depth, own style or None for text) of everything under root, parents first.

    A style is an element's sequence of children, repeats of neighbours counted once. A node is its parent's node, the
    style and the position in it, so equal paths of equal styles meet in one node over all pages.
    """
    waiting = [(root, _id("root"), None, 0, 0)]
    while waiting:
        element, node, parent, outer, depth = waiting.pop()
        children = shown(element)
        kinds, places = [], []
        for key in map(_key, children):
            if not kinds or kinds[-1] != key:
                kinds.append(key)
            places.append(len(kinds))
        style = _id(*kinds)
        yield element, node, parent, outer, depth, style
        for child, place in zip(children, places, strict=True):
            inner = node if depth >= FOLD else _id(node, style, place)
            if isinstance(child, list):
                leaf = _id(node, "#text") if depth >= FOLD else inner
                yield child, leaf, node, style if depth < FOLD else 0, min(depth, FOLD) + 1, None
            else:
                waiting.append((child, inner, node if depth < FOLD else parent, style if depth < FOLD else outer, min(depth + 1, FOLD)))


def page_nodes(page: str) -> list[dict]:
    """The page's part of its site's tree: each node once, with its styles or the digests of its texts."""
    nodes: dict[int, dict] = {}
    for child, node, parent, outer, depth, style in styled(parse(page, is_noise)):
        at = nodes.setdefault(node, {"node": node, "parent": parent, "style": outer, "depth": depth, "styles": set(), "features": {}})
        if style is not None:
            at["styles"].add(style)
        else:
            feature = _id(run_text(child))
            at["features"][feature] = at["features"].get(feature, 0) + 1
    return [n | {"styles": list(n["styles"]), "features": [{"feature": f, "times": t} for f, t in n["features"].items()]} for n in nodes.values()]


def prepared(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), host (a digest, null without one), page (a digest of html)."""
    html = F.coalesce("html", F.lit(""))
    name = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    host = F.when(name != "", F.xxhash64(name))
    return pages.select("page_id", "url", html.alias("html"), host.alias("host"), F.unhex(F.sha2(html, 256)).alias("page"))


def trees(pages: DataFrame) -> DataFrame:
    """Host, page and nodes of every different page of every host."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(pages.sparkSession.createDataFrame([], TREES).schema)

    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_A_BATCH):
                part = batch.slice(start, ROWS_A_BATCH)
                nodes = pa.array([page_nodes(h) for h in part.column(2).to_pylist()], schema.field("nodes").type)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), nodes], schema=schema)

    return pages.filter("host IS NOT NULL").select("host", "page", "html").mapInArrow(grow, TREES).dropDuplicates(["host", "page"])


def importances(grown: DataFrame) -> DataFrame:
    """host, node, parent, style, depth, m (pages), importance of the node alone.

    With m > 1 pages, the importance of a node with children is the entropy of its styles to base m; that of a text node is
    1 less the mean entropy, over its different texts, of a text's spread over the pages. Then PRIOR_PAGES pages of importance 1 are mixed in.
    """
    nodes = grown.select("host", F.explode("nodes").alias("n")).select("host", "n.*")
    met = nodes.groupBy("host", "node").agg(F.min("parent").alias("parent"), F.min("style").alias("style"), F.min("depth").alias("depth"), F.count("*").alias("m"))
    text = nodes.select("host", "node", F.explode("features").alias("f")).select("host", "node", "f.*")
    text = text.groupBy("host", "node", "feature").agg(F.sum("times").alias("all"), F.sum(F.col("times") * F.log("times")).alias("part"))
    text = text.groupBy("host", "node").agg(F.avg(F.log("all") - F.col("part") / F.col("all")).alias("spread"))
    styles = nodes.select("host", "node", F.explode("styles").alias("s")).groupBy("host", "node", "s").agg(F.count("*").alias("c"))
    styles = styles.groupBy("host", "node").agg((F.log(F.sum("c")) - F.sum(F.col("c") * F.log("c")) / F.sum("c")).alias("variety"))
    both = met.join(text, ["host", "node"], "left").join(styles, ["host", "node"], "left")
    base = F.log(F.greatest("m", F.lit(e)))
    alone = F.when(F.col("m") == 1, 1.0).when(F.col("spread").isNotNull(), 1 - F.col("spread") / base).otherwise(F.col("variety") / base)
    alone = F.least(F.greatest(alone, F.lit(0.0)), F.lit(1.0))
    return both.select("host", "node", "parent", "style", "depth", "m", ((alone * F.col("m") + PRIOR_PAGES) / (F.col("m") + PRIOR_PAGES)).alias("importance"))


def low_branches(grown: DataFrame) -> DataFrame:
    """host, node of the branches in which no node reaches LOW.

    From the leaves up, one level a step: a branch's composite importance is (1 - g) its own + g the mean, over its styles by
    pages, of its parts' mean, where g is GAMMA to the number of its styles. A level is one aggregation by parent.
    """
    nodes = materialize(importances(grown), "style-nodes")
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select("host", "node")
    done, below = [], None
    for depth in range(deepest, -1, -1):
        level = nodes.filter(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("composite", F.col("importance")).withColumn("highest", F.col("importance"))
        else:
            parts = below.groupBy("host", "parent", "style").agg(F.avg("composite").alias("mean"), F.max("highest").alias("top"), F.max("m").alias("pages"))
            parts = parts.groupBy("host", F.col("parent").alias("node")).agg(
                (F.sum(F.col("mean") * F.col("pages")) / F.sum("pages")).alias("inner"), F.max("top").alias("top"), F.count("*").alias("kinds")
            )
            share = F.pow(F.lit(GAMMA), "kinds")
            composite = F.coalesce((1 - share) * F.col("importance") + share * F.col("inner"), F.col("importance"))
            level = level.join(parts, ["host", "node"], "left").withColumn("composite", composite)
            level = level.withColumn("highest", F.greatest("composite", "top")).drop("inner", "top", "kinds")
        below = materialize(level, "style-level")
        done.append(below.filter(F.col("highest") < LOW).select("host", "node"))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def landmarks(root: Element) -> list[Element]:
    """The page's outermost article elements; a form around the whole page does not hide them."""
    free, within_form, waiting = [], [], [(root, False)]
    while waiting:
        element, formed = waiting.pop()
        noise = is_noise(element.tag, element.attributes)
        if noise and element.tag != "form":
            continue
        if is_article(element):
            (within_form if formed else free).append(element)
        else:
            waiting += [(c, formed or noise) for c in element.children if isinstance(c, Element)]
    return free or within_form


def main_text(page: str, low: np.ndarray | None) -> tuple[str, int, int]:
    """Text, blocks cut by the site's style, blocks cut by their names alone, given the site's low nodes, sorted."""
    root = parse(page, is_noise)
    cut_here = set()
    if low is not None:
        listed = [(id(child), node) for child, node, *_ in styled(root)]
        found = np.isin(np.array([n for _, n in listed], dtype=np.int64), low)
        cut_here = {listed[k][0] for k in np.flatnonzero(found)}
    marks, held = landmarks(root), set()
    for mark in marks:
        while mark is not None and id(mark) not in held:
            held.add(id(mark))
            mark = mark.parent
    marked = set(map(id, marks))
    blocks, style_cut, name_cut, last = [], 0, 0, None
    waiting = [(root, None, False, False, not marks, False)]  # child, run before, cut by style, by name, in the article, directly in it
    while waiting:
        child, before, cut, named, inside, plain = waiting.pop()
        if isinstance(child, list):
            if cut or (id(child) in cut_here and not plain):
                style_cut += 1
            elif named or not inside:
                name_cut += 1
            elif last is not None and last is before:  # a removed inline part stood between: still one block
                blocks[-1] += child
                last = child
            else:
                blocks.append(list(child))
                last = child
            continue
        plain = id(child) in marked or (plain and child.tag in TEXT_TAGS)
        inside = inside or id(child) in marked
        if id(child) not in held:
            cut = cut or (id(child) in cut_here and not plain)
            outer_header = child.tag == "header" and not (marks and inside)
            named = named or outer_header or child.tag == "head" or is_noise(child.tag, child.attributes)
        parts, run, following = shown(child), None, []
        for part in parts:
            following.append((part, run, cut, named, inside, plain))
            run = part if isinstance(part, list) else run if part.tag not in BLOCKS else None
        waiting += reversed(following)
    return "\n\n".join(map(run_text, blocks)), style_cut, name_cut


def extract(pages: DataFrame, most_shipped: int = MOST_SHIPPED) -> DataFrame:
    """page_id, url, text, n_chars, style_cut, name_cut for every row of pages (page_id, url, html).

    The pages of a host are merged into one style tree and its low branches removed from each of them. An exact check
    follows: parts that name themselves (is_noise) go, and where a page marks its article, so does the rest outside it. What
    stands as paragraphs, headings, lists or tables directly in a marked article is never cut by style. style_cut and
    name_cut count the blocks that either way removed.

    Null html and pages without text give an empty text; rows repeat where they do; a null url or one without a host
    belongs to no site, so only the check applies. Equal pages of a host count once in its tree. Other columns are ignored, no rows
    give none. Pages of any length are read whole, one at a time. A hot host is spread by its nodes and texts. Where low
    branches are more than most_shipped, they meet the pages in a join instead of going to every task.
    """
    spark = pages.sparkSession
    pages = prepared(pages)
    grown = materialize(trees(pages), "style-trees")
    low = materialize(low_branches(grown), "low-branches")
    ddl = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, style_cut int, name_cut int"
    if low.limit(most_shipped + 1).count() <= most_shipped:
        shipped: dict[int, list[int]] = {}
        for row in low.toLocalIterator():
            shipped.setdefault(row.host, []).append(row.node)
        sites = spark.sparkContext.broadcast({h: np.sort(np.array(n, dtype=np.int64)) for h, n in shipped.items()})
        ready = pages.select("page_id", "url", "html", "host")
    else:
        sites = None
        nodes = grown.select("host", "page", F.explode("nodes.node").alias("node")).join(low, ["host", "node"])
        nodes = nodes.groupBy("host", "page").agg(F.collect_set("node").alias("low"))
        ready = pages.join(nodes, ["host", "page"], "left").select("page_id", "url", "html", "low")

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_A_BATCH):
                part = batch.slice(start, ROWS_A_BATCH)
                found = []
                for page, site in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    known = sites.value.get(site) if sites else np.array(sorted(site), dtype=np.int64) if site else None
                    found.append(main_text(page, known))
                text, style, name = zip(*found, strict=True)
                columns = [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array(style, pa.int32()), pa.array(name, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "style_cut", "name_cut"])

    return ready.mapInArrow(texts, ddl)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op13_html_extraction": op13_html_extraction}
ORACLE_SQL: dict[str, str] = {}
