"""A small tree of an HTML page: block elements and the text runs between their borders."""

from __future__ import annotations

import html
import re

MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|\Z)
    |(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?)*+)(?:>|\Z))""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
ATTRIBUTES_USED = ("class", "id", "role", "itemprop")
# Element names and their parsing rules as the HTML standard gives them.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
UNREAD = frozenset("select button template object video audio canvas svg datalist map".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body caption center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form head header hgroup hr html legend "
    "li listing main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption colgroup head html tbody td tfoot th thead tr legend".split())
SCOPES = frozenset("html table td th caption object template".split())
TABLE_PARTS = frozenset("table tbody thead tfoot tr td th caption colgroup html body".split())
# Which open elements a start tag ends, and the elements that shield older ones.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",))),
}


class Element:
    """A block element, or an inline one that carries a label. Children are elements and runs (lists of strings)."""

    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None) -> None:
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        if parent is not None:
            parent.children.append(self)

    def add(self, text: str) -> None:
        if self.children and isinstance(self.children[-1], list):
            self.children[-1].append(text)
        else:
            self.children.append([text])


def run_text(run: list[str]) -> str:
    """A run's text with every stretch of white space as one space, trimmed."""
    return " ".join("".join(run).split())


def attributes_of(source: str) -> dict[str, str]:
    found = {}
    if "=" in source:
        for name, *values in ATTRIBUTE.findall(source):
            if (name := name.lower()) in ATTRIBUTES_USED:
                found.setdefault(name, html.unescape("".join(values)).lower())
    return found


def _open(now: Element, tags: tuple[str, ...], shields) -> Element | None:
    """The innermost open element among tags that no shield hides."""
    while now is not None:
        if now.tag in tags:
            return now
        if now.tag in shields:
            return None
        now = now.parent
    return None


def parse(page: str, is_labelled) -> Element:
    """The page's tree. Script, style and other unread elements leave no trace; an unclosed tag, comment or script runs
    to the end of the page. Inline elements only stay where is_labelled(tag, attributes) holds."""
    root = now = Element("html", {}, None)
    at, end, skipping = 0, len(page), None
    while at <= end:
        found = MARKUP.search(page, at)
        if at < end and skipping is None and (text := page[at : found.start() if found else end]):
            if now.tag == "head" and not text.isspace():
                now = now.parent
            now.add(html.unescape(text) if "&" in text else text)
        if found is None:
            break
        at = found.end()
        closing, tag, source = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if skipping:  # inside an unread element: only its own tags count
            name, depth = skipping
            if tag == name:
                depth += -1 if closing else 1
                skipping = (name, depth) if depth else None
            elif tag in RAW and not closing:
                at = _after_raw(page, at, tag)
        elif closing:
            now = _closed(now, tag)
        elif tag in RAW:
            at = _after_raw(page, at, tag)
        elif tag in UNREAD:
            skipping = (tag, 1)
        elif tag == "br":
            now.add(" ")
        elif tag in VOID and tag != "hr":
            continue
        elif tag in ("html", "body") and (tag == "html" or _open(now, ("body",), ()) is not None):
            continue
        else:
            now = _started(now, tag, source, is_labelled)
    return root


def _after_raw(page: str, at: int, tag: str) -> int:
    found = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
    return found.end() if found else len(page)


def _started(now: Element, tag: str, source: str, is_labelled) -> Element:
    if tag not in IN_HEAD and (head := _open(now, ("head",), ())) is not None:
        now = head.parent
    if tag not in BLOCKS:
        return Element(tag, found, now) if source and is_labelled(tag, found := attributes_of(source)) else now
    if tag in ENDS_PARAGRAPH and (paragraph := _open(now, ("p",), SCOPES)) is not None:
        now = paragraph.parent
    if tag in HEADINGS and now.tag in HEADINGS:
        now = now.parent
    if tag in IMPLIED_ENDS and (ended := _open(now, *IMPLIED_ENDS[tag])) is not None:
        now = ended.parent
    new = Element(tag, attributes_of(source), now)
    return now if tag == "hr" else new


def _closed(now: Element, tag: str) -> Element:
    if tag == "br":
        now.add(" ")
        return now
    if tag in BLOCKS:
        ended = _open(now, tuple(HEADINGS) if tag in HEADINGS else (tag,), SCOPES - {tag} if tag not in TABLE_PARTS else ("table",) if tag != "table" else ())
        if ended is None:
            if tag == "p":
                Element("p", {}, now)
            return now
        return ended.parent or ended
    ended = _open(now, (tag,), BLOCKS)
    return ended.parent if ended is not None and ended.parent is not None else now
