"""Main text of HTML pages by tag-path ratios.

Each text node has a root-to-leaf path of structural tags. Per path the page gives the text length
and the punctuation for each of its nodes; both ratios are smoothed along the page, fused into one
score and cut at a threshold that follows their spread. The nodes on the paths above it are content;
the smallest element that holds most of that content is the article, and its remaining blocks (short
paragraphs too) are the text. Elements that HTML says are something else (menus, asides ...) take no
part. A class, id or role with a word for page furniture makes an element suspect, and so does a form:
its nodes wait unless it holds most of the content. If other words stand in the name too (related-work)
and it lies in the article, the suspect comes back where its own ratios are not low beside the content's.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from math import exp, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.workers import giving_back, slices
from assaylake.session import ship_package

# Element names of HTML by their role here, and words that name page furniture.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"html", "body", "head", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
FURNITURE = {"head", "nav", "menu", "footer", "aside", "dialog", "button", "select", "option", "svg", "math", "object", "canvas", "audio", "video", "map", "datalist", "dir"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "sponsor", "sponsored", "promo", "promoted", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead", "header", "footer", "sidebar", "widget", "widgets", "related", "recommended", "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "share", "sharing", "social", "comment", "comments", "disqus", "respond", "reply", "replies", "form", "search", "login", "pager", "pagination", "skip", "hidden", "complementary", "contentinfo", "copyright", "disclaimer", "toolbar"}
# Words that leave the sense of a furniture word as it is, and elements whose id names their text.
NEUTRAL = {"area", "article", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "content", "count", "entry", "global", "group", "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "media", "outer", "page", "panel", "post", "posts", "right", "row", "section", "site", "thread", "title", "top", "wrap", "wrapper"}
TITLED = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
FORMS = {"form", "fieldset"}
ENDS_OF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "menu", "dir"}
PUNCTUATION = re.compile("[.,;:!?…。，、；：！？]")
MARKUP = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|<[!?][^>]*(?:>|$)", re.S)
NAMES = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
SPLIT_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
BATCH_BYTES = 1 << 23  # of pages in a slice of a batch
#: Share of the content's text that the article's element must hold.
MOST = 0.7
#: A suspect's ratios are low under this share of the content's.
LOW = 0.75
#: A path of links in an article is no text under this share of the threshold.
DIM = 0.1
PLAIN, MIXED, SURE, FORM = range(4)


class Page:
    """Elements of a page, parents before children, its blocks of text, and its paths as numbers.

    A path is the number of a (parent path, tag) pair, so a page costs time and memory by its length,
    however deep its tags are nested.
    """

    def __init__(self):
        self.elements: list[Element] = []
        self.nodes: list[Node] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.open: dict[str, int] = {}  # how often each tag is open where the parser stands
        self.root = Element(self, "#", None, False)

    def leave(self, at: Element, to: Element | None) -> Element:
        """The element to, an ancestor of at, or the root; what lies between is closed."""
        to = to or self.root
        while at is not to and at.parent is not None:
            self.open[at.tag] -= 1
            at = at.parent
        return at


class Element:
    __slots__ = ("depth", "furniture", "in_article", "kind", "number", "parent", "path", "tag")

    def __init__(self, page: Page, tag: str, parent: Element | None, furniture: bool, kind: int = PLAIN):
        self.tag, self.parent, self.furniture, self.kind = tag, parent, furniture, kind
        self.depth = parent.depth + 1 if parent else 0
        self.in_article = bool(parent) and (parent.in_article or parent.tag in ("article", "main"))
        self.path = page.paths.setdefault((parent.path if parent else -1, tag), len(page.paths))
        self.number = len(page.elements)
        page.elements.append(self)
        page.open[tag] = page.open.get(tag, 0) + 1

    def nearest(self, tags: set[str]) -> Element | None:
        at: Element | None = self
        while at is not None and at.tag not in tags:
            at = at.parent
        return at


class Node:
    """One block's text inside its element."""

    __slots__ = ("element", "linked", "marks", "text")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked
        self.marks = len(PUNCTUATION.findall(text))


def suspicion(tag: str, attributes: str) -> int:
    """SURE if a name has furniture words and neutral ones alone, MIXED if others stand beside them."""
    kind = FORM if tag in FORMS else PLAIN
    if "=" not in attributes:
        return kind
    for found in NAMES.finditer(attributes):
        if found[1].lower() == "id" and tag in TITLED:
            continue
        for name in (found[2] or found[3] or found[4] or "").split():
            words = {w.lower() for w in SPLIT_NAMES.findall(name) if not w.isdigit()}
            if words & WORDS:
                kind = max(kind, SURE if words <= WORDS | NEUTRAL else MIXED)
    return kind


def read_page(html_text: str) -> Page:
    """Blocks of text in page order with the element that holds them; scripts, styles and comments left out."""
    page = Page()
    at, here, pieces, linked, anchors = 0, page.root, [], 0, 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces and (text := " ".join(html.unescape("".join(pieces)).split())):
            page.nodes.append(Node(here, text, linked))
        pieces, linked = [], 0

    while (found := MARKUP.search(html_text, at)) is not None:
        if found.start() > at:
            pieces.append(piece := html_text[at : found.start()])
            linked += len(piece.strip()) if anchors else 0
        at = found.end()
        if not (name := found[2]):
            continue
        tag, closing = name.lower(), bool(found[1])
        if tag in RAW:
            if not closing and not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html_text, at)
                close = html_text.find(">", end.start()) if end else -1
                at = close + 1 if close >= 0 else len(html_text)
            continue
        if tag == "a":
            anchors = 0 if closing else 1
        if tag == "br" or tag in VOID:
            pieces.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag not in BLOCK and tag not in FURNITURE:
            continue
        flush()
        if closing:
            if page.open.get(tag):
                here = page.leave(here, here.nearest({tag}).parent)
            continue
        anchors = 0 if tag == "p" else anchors
        if tag in ("html", "body") and page.open.get(tag):
            continue
        if tag in BLOCK:  # a block ends an open paragraph or heading, an item its predecessor
            stop = {"p"} | (HEADINGS if tag in HEADINGS else set())
            while here.tag in stop:
                here = page.leave(here, here.parent)
            ends = ENDS_OF.get(tag, ())
            if any(page.open.get(e) for e in ends):
                item = here.nearest(SCOPES | ends)
                if item.tag not in SCOPES:
                    here = page.leave(here, item.parent)
        if here.tag == "head" and tag != "head":
            here = page.leave(here, here.parent)
        in_article = here.in_article or here.tag in ("article", "main")
        furniture = here.furniture or tag in FURNITURE or (tag == "header" and not in_article)
        kind = PLAIN
        if tag not in ("html", "body", "main") and not (tag == "article" and not in_article):
            furniture = furniture or bool(HIDDEN.search(found[3]))
            kind = suspicion(tag, found[3])
        here = Element(page, tag, here, furniture, kind)
    pieces.append(html_text[at:])
    flush()
    return page


def path_scores(nodes: list[Node]) -> dict[int, float]:
    """The fused ratio of each path: text length and punctuation a node, smoothed along the page."""
    totals: dict[int, list[int]] = {}
    for n in nodes:
        t = totals.setdefault(n.element.path, [0, 0, 0])
        t[0] += max(0, len(n.text) - n.linked)
        t[1] += n.marks
        t[2] += 1
    ratio = {p: (length / k, marks / k) for p, (length, marks, k) in totals.items()}
    series = [ratio[n.element.path] for n in nodes]
    kernel = [exp(-(d * d) / 2) for d in (-1, 0, 1)]
    fused: dict[int, list[float]] = {}
    for i, n in enumerate(nodes):
        near = [(w, series[i + d]) for w, d in zip(kernel, (-1, 0, 1), strict=True) if 0 <= i + d < len(nodes)]
        weight = sum(w for w, _ in near)
        length, marks = (sum(w * v[k] for w, v in near) / weight for k in (0, 1))
        own = series[i]
        fused.setdefault(n.element.path, []).append(sqrt(max(own[0], 0) * length) * (1 + sqrt(own[1] * marks)))
    return {p: sum(v) / len(v) for p, v in fused.items()}


def threshold(nodes: list[Node], scores: dict[int, float]) -> float:
    """The least fused ratio of content: it follows the mean and the spread of the nodes' ratios."""
    values = [scores[n.element.path] for n in nodes]
    mean = sum(values) / len(values)
    spread = sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return min(max(mean - spread, spread / 2), max(values))


def content_nodes(nodes: list[Node], scores: dict[int, float]) -> list[Node]:
    """The nodes on paths whose fused ratio reaches the threshold."""
    cut = threshold(nodes, scores)
    return [n for n in nodes if scores[n.element.path] >= cut]


def summed(page: Page, nodes: list[Node], values: list[tuple[int, ...]]) -> list[list[int]]:
    """Per element the sums of the values of the nodes in it and below it: children are added to parents, last ones first."""
    out = [[0] * len(values[0]) for _ in page.elements]
    for n, value in zip(nodes, values, strict=True):
        own = out[n.element.number]
        for i, v in enumerate(value):
            own[i] += v
    for e in reversed(page.elements[1:]):
        above, own = out[e.parent.number], out[e.number]
        for i, v in enumerate(own):
            above[i] += v
    return out


def ratios(nodes: list[Node]) -> tuple[float, float]:
    """Text length out of links and punctuation, a node."""
    return sum(max(0, len(n.text) - n.linked) for n in nodes) / len(nodes), sum(n.marks for n in nodes) / len(nodes)


def inherited(page: Page, own) -> list[bool]:
    """Per element whether own holds for it or for one that it lies in."""
    out: list[bool] = []
    for e in page.elements:
        out.append(own(e) or (e.parent is not None and out[e.parent.number]))
    return out


def cleared(page: Page, nodes: list[Node], score: Callable) -> set[Element]:
    """Suspects round most of the content; a surely named one only if all text of the page is in suspects."""
    if not any(e.kind for e in page.elements):
        return set()
    content = content_nodes(nodes, score(nodes))
    weight, total = summed(page, content, [(len(n.text),) for n in content]), sum(len(n.text) for n in content)
    sure = inherited(page, lambda e: e.kind == SURE)
    free = any(not sure[n.element.number] for n in nodes)
    return {e for e in page.elements if e.kind and weight[e.number][0] >= MOST * total and not (free and e.kind == SURE)}


def main_text(html_text: str | None, score: Callable[[list[Node]], dict[int, float]] = path_scores) -> str:
    """Blocks of the article joined by two newlines; empty where there is none."""
    if not html_text:
        return ""
    page = read_page(html_text)
    nodes = [n for n in page.nodes if not n.element.furniture]
    if not nodes:
        return ""
    clear = cleared(page, nodes, score)
    suspect = inherited(page, lambda e: bool(e.kind) and e not in clear)
    free = [n for n in nodes if not suspect[n.element.number]]
    if not free:
        return ""
    scores = score(free)
    content, cut = content_nodes(free, scores), threshold(free, scores)
    weight = [w for (w,) in summed(page, content, [(len(n.text),) for n in content])]
    total = sum(len(n.text) for n in content)
    named = [e for e in page.elements if e.tag in ("article", "main") and weight[e.number] and 2 * weight[e.number] >= total]
    if named:
        article = min(named, key=lambda e: (weight[e.number], -e.depth))
    else:
        article = max((e for e in page.elements if weight[e.number] >= MOST * total), key=lambda e: (e.depth, weight[e.number]))
        if article.tag in BLOCK and article.parent is not None and article.tag in ("p", "li", "blockquote", "pre", *HEADINGS):
            article = article.parent
    length, marks = ratios(content)
    if article.tag not in ("#", "html", "body") and any(suspect):
        held = summed(page, nodes, [(max(0, len(n.text) - n.linked), n.marks, 1) for n in nodes])
        back = {e for e in page.elements if e.kind == MIXED and (h := held[e.number])[2] and h[0] >= LOW * length * h[2] and h[1] >= LOW * marks * h[2]}
        clear = clear | back
        suspect = inherited(page, lambda e: bool(e.kind) and e not in clear)
    inside, header, heading = [False] * len(page.elements), [False] * len(page.elements), [False] * len(page.elements)
    for e in page.elements:
        up = e.parent.number if e.parent else None
        inside[e.number] = e is article or (up is not None and inside[up])
        if inside[e.number] and e is not article:
            header[e.number] = e.tag == "header" or header[up]
            heading[e.number] = e.tag in HEADINGS or heading[up]
    blocks = []
    for n in nodes:
        i = n.element.number
        if not inside[i] or suspect[i] or (header[i] and not heading[i]):
            continue
        # Outside of headings, links count as text where their path's ratio or their own length and marks say so.
        dim = 2 * n.linked > len(n.text) and (not named or scores.get(n.element.path, cut) < DIM * cut)
        if dim and n.element.tag not in HEADINGS and not (2 * len(n.text) >= length and n.marks):
            continue
        blocks.append(n.text)
    return "\n\n".join(blocks)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of pages but the html, with text and n_chars (its code points).

    A null or empty html gives an empty text, as does a page without an article; a page of any length
    is read whole; repeated rows each get their own result; an empty table gives an empty one.
    Columns of pages named text or n_chars are replaced.
    """
    ship_package(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, BATCH_BYTES):
            texts = [main_text(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1) for i in range(len(kept))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*kept, "text", "n_chars"])

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "text string", "n_chars long"])
    return pages.select(F.col(html_col).alias("html"), *kept).mapInArrow(giving_back(extract), schema)
