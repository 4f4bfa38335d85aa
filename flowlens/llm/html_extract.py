"""Main text of web pages by a tree-structured graphical model.

Every block element of a page, and every run of text between block tags, is a node that is content or not. A node has a
potential from its tag, its names and its text; each child is tied to its parent by a potential over their two labels.
Messages are passed from the leaves up to the root and back down, which gives each run of text its exact marginal.
The potentials are trained on labelled pages; the text of runs that are more likely content than not is kept.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import small_batches
from flowlens.llm.html_pages import PAGES
from flowlens.llm.linear import fit_logistic

# Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template svg iframe select button".split())
# Raw elements that reach to the end of the page if nothing closes them.
ENDLESS = frozenset("script style textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
# A start tag of these ends an open element of those, if it is nearer than the stop.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Elements that may hold parts of both kinds, unless their names speak against it.
WRAPPERS = frozenset("#root html body div section table tbody tr center".split())
# Parts of class, id and role names.
OUTSIDE = frozenset(
    "#top aside ad ads advert advertisement banner sidebar side nav navbar navigation menu footer foot header masthead comment comments reply replies discussion respond cookie cookies consent "
    "notice alert share sharing social related recommended promo sponsor sponsored subscribe subscription newsletter signup breadcrumb breadcrumbs popup modal "
    "overlay login search pagination pager widget toolbar tags meta copyright legal form".split())
INSIDE = frozenset("article content post entry story main body text blog page".split())
TAGS = ("article", "main", "p", "div", "section", "ul", "ol", "li", "nav", "header", "footer", "aside", "form", "table", "td", "body", "blockquote", "pre", "figure", "h1", "h2", "h3", "#text")
FEATURES = (*TAGS, "other_tag", "outside", "inside", "linked", "all_linked", "long", "length", "stops", "sign", "bias")

# Comments, declarations and tags. Attribute values may hold anything but their own quote, unquoted ones quotes too; what the page's end cuts off is
# a tag or comment up to there. Nothing is tried twice, so that the time follows the length of the page.
_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"""
    r"""((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)?+)?+)*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_LABEL = re.compile(r'\by="([01])"')
_PARTS = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Nodes in page order, parents before children; a run of text has the tag #text."""

    tags: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    # Whether what stands in the node is mostly of one kind.
    single: list[bool] = field(default_factory=list)

    def add(self, tag: str, names: str, parent: int, text: str = "", links: int = 0) -> int:
        self.tags.append(tag)
        self.names.append(names)
        self.parents.append(parent)
        self.texts.append(text)
        self.links.append(links)
        self.single.append(tag not in WRAPPERS or bool(names and OUTSIDE & set(_PARTS.findall(names))))
        return len(self.tags) - 1


def parse(source: str) -> Page:
    """The block tree of a page; tags may be left open or closed twice, raw elements and comments are left out."""
    page = Page()
    root = page.add("#root", "", -1)
    # Open elements: tag and node; an inline element has the node of the block around it.
    stack: list[tuple[str, int]] = [("#root", root)]
    # Depths of the open elements by tag, the innermost last; 0, the root, where there is none.
    opened: dict[str, list[int]] = {}
    # Raw elements that nothing closes any more.
    missing: set[str] = set()
    run: list[str] = []
    anchors = linked = 0

    def end_run():
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                page.add("#text", "", stack[-1][1], text, linked)
            run.clear()
        linked = 0

    def depth_of(*tags: str) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    def push(tag: str, node: int):
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, node))

    def close(depth: int):
        nonlocal anchors
        while len(stack) > depth:
            tag, _ = stack.pop()
            opened[tag].pop()
            anchors -= tag == "a"

    at = 0
    for found in _TAG.finditer(source):
        if found.start() < at:
            continue
        if found.start() > at:
            piece = source[at:found.start()]
            run.append(piece)
            if anchors:
                linked += len(piece.strip())
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            if depth := depth_of(tag):
                if tag not in INLINE:
                    end_run()
                close(depth)
            elif tag not in INLINE:
                end_run()
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "input", "wbr"):
                if tag == "hr":
                    end_run()
                elif tag != "wbr":
                    run.append(" ")
            continue
        if found[3].endswith("/") and tag in ("svg", "path"):
            continue
        if tag in RAW:
            if tag in ("textarea", "iframe", "noscript", "template"):
                end_run()
            if tag in missing:
                continue
            # A control that the next one of its kind follows was left open; its tag alone is left out.
            over = re.compile(rf"<(/?){re.escape(tag)}\b[^>]*>" if tag in ("select", "button") else rf"<(/){re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            if over and over[1]:
                at = over.end()
            elif tag in ENDLESS:
                at = len(source)
            elif not over:
                missing.add(tag)
            continue
        if tag == "option":
            # Its end tag may be left out: it holds text up to the next tag that is not inline.
            over = next((t for t in _TAG.finditer(source, at) if t[2] and t[2].lower() not in INLINE), None)
            at = over.start() if over else len(source)
            continue
        if tag in INLINE:
            push(tag, stack[-1][1])
            anchors += tag == "a"
            continue
        end_run()
        # A block ends an open paragraph, and an entry its neighbour.
        if depth := depth_of("p"):
            close(depth)
        if tag in ENDS:
            ended, stop = ENDS[tag]
            if (depth := depth_of(*ended)) > depth_of(*stop):
                close(depth)
        # An inline element that was left open does not reach into the block.
        while stack[-1][0] in INLINE:
            close(len(stack) - 1)
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(found[3])).lower() if found[3] else ""
        if found[3] and (label := _LABEL.search(found[3])):
            names += f" y{label[1]}"
        # The head of a page is another thing than that of an article.
        top = tag == "header" and not page.single[stack[-1][1]]
        push(tag, page.add("#top" if top else tag, names, stack[-1][1]))
    if at < len(source):
        run.append(source[at:])
    end_run()
    return page


def _edge(page: Page, k: int) -> int:
    """Kind of the edge above a node: an element in a wrapper, in another element, or a run of text."""
    return 2 if page.tags[k] == "#text" else int(page.single[page.parents[k]])


_PLACE = {name: i for i, name in enumerate(FEATURES)}


def _evidence(tag: str, names: str, text: str, links: int) -> list[tuple[int, float]]:
    """The features of a node that are not 0."""
    out = [(_PLACE.get(tag, _PLACE["other_tag"]), 1.0), (_PLACE["bias"], 1.0)]
    if names or tag in OUTSIDE:
        # Elements like nav and aside say what such names say.
        parts = {tag, *_PARTS.findall(names)} - {"header", "body", "main", "article"} | set(_PARTS.findall(names))
        if parts & OUTSIDE:
            out.append((_PLACE["outside"], 1.0))
        elif parts & INSIDE:
            out.append((_PLACE["inside"], 1.0))
    if text:
        size = len(text)
        share = min(1.0, links / size)
        out += [(_PLACE["linked"], share), (_PLACE["length"], min(1.0, log1p(size) / 7))]
        if share > 0.8:
            out.append((_PLACE["all_linked"], 1.0))
        if size > 120:
            out.append((_PLACE["long"], 1.0))
        if text[-1] in ".!?:":
            out.append((_PLACE["stops"], 1.0))
        if "©" in text:
            out.append((_PLACE["sign"], 1.0))
    return out


@dataclass(frozen=True)
class ContentModel:
    """Log odds of a node's features; edges[kind][parent][child]: log potentials of two labels."""

    weights: list[float]
    edges: tuple

    def marginals(self, page: Page) -> list[float]:
        """Probability of content for every node, by one pass up and one down."""
        n = len(page.tags)
        weights, parents = self.weights, page.parents
        odds = [sum(weights[i] * x for i, x in _evidence(page.tags[k], page.names[k], page.texts[k], page.links[k])) for k in range(n)]
        # below: log odds of what a node and all under it say; up: what it tells its parent.
        below, up = odds, [0.0] * n
        for k in range(n - 1, 0, -1):
            e = self.edges[_edge(page, k)]
            up[k] = _told(below[k], e[0][0], e[0][1], e[1][0], e[1][1])
            below[parents[k]] += up[k]
        # A node's belief without its own message goes down to it.
        belief = below[:]
        for k in range(1, n):
            e = self.edges[_edge(page, k)]
            belief[k] = below[k] + _told(belief[parents[k]] - up[k], e[0][0], e[1][0], e[0][1], e[1][1])
        return [1 / (1 + exp(-max(-500.0, min(500.0, b)))) for b in belief]


def _told(odds: float, a0: float, a1: float, b0: float, b1: float) -> float:
    """Log odds that a neighbour with `odds` sends over an edge: a0, a1 for label 0 of the receiver, b0, b1 for label 1."""
    if odds > 0:
        return log((exp(b0 - odds) + exp(b1)) / (exp(a0 - odds) + exp(a1))) if odds < 500 else b1 - a1
    return log((exp(b0) + exp(b1 + odds)) / (exp(a0) + exp(a1 + odds))) if odds > -500 else b0 - a0


def labels_of(page: Page) -> list[int]:
    """Labels of a labelled page's nodes: of runs, the nearest labelled element's; of elements, that of most of their text, of wrappers, content if any is."""
    n = len(page.tags)
    near, weight = [-1] * n, [[0, 0] for _ in range(n)]
    for k in range(n):
        own = 1 if " y1" in f" {page.names[k]}" else 0 if " y0" in f" {page.names[k]}" else -1
        near[k] = own if own >= 0 else near[page.parents[k]] if k else -1
    for k in range(n - 1, 0, -1):
        if page.tags[k] == "#text":
            weight[k][max(0, near[k])] += len(page.texts[k])
        for y in (0, 1):
            weight[page.parents[k]][y] += weight[k][y]
    return [near[k] if near[k] >= 0 else int(weight[k][1] > (weight[k][0] if page.single[k] else 0)) for k in range(n)]


def train(pages: tuple[str, ...] = PAGES, steps: int = 150, ridge: float = 0.02) -> ContentModel:
    """Potentials from labelled pages.

    Edge potentials are the shares of a child's labels given its parent's. Node potentials start at what each node
    says alone and then climb the likelihood of the labels: the slope is each feature's sum over the nodes of the label
    less the marginal that message passing gives, so evidence that edges explain already is not counted again.
    """
    known, counts, rows, y = [], np.full((3, 2, 2), 0.2), [], []
    for source in pages:
        page = parse(source)
        labels = labels_of(page)
        # The label is no name.
        page.names = [re.sub(r"\by[01]\b", "", names) for names in page.names]
        known.append(page)
        for k, tag in enumerate(page.tags):
            x = np.zeros(len(FEATURES))
            for i, value in _evidence(tag, page.names[k], page.texts[k], page.links[k]):
                x[i] = value
            rows.append(x)
            y.append(labels[k])
            if k:
                counts[_edge(page, k), labels[page.parents[k]], labels[k]] += 1
    x, truth = np.array(rows), np.array(y, float)
    edges = tuple(tuple(map(tuple, e)) for e in np.log(counts / counts.sum(2, keepdims=True)).tolist())
    weights = fit_logistic(x, truth, ridge=1.0) * 0.5
    fast, slow = np.zeros(len(weights)), np.zeros(len(weights))
    for step in range(1, steps + 1):
        model = ContentModel(weights.tolist(), edges)
        beliefs = np.array([p for page in known for p in model.marginals(page)])
        slope = x.T @ (truth - beliefs) - ridge * len(known) * weights
        fast, slow = 0.9 * fast + 0.1 * slope, 0.99 * slow + 0.01 * slope ** 2
        weights = weights + 0.1 * (fast / (1 - 0.9 ** step)) / (np.sqrt(slow / (1 - 0.99 ** step)) + 1e-8)
    return ContentModel(weights.tolist(), edges)


def main_text(source: str, model: ContentModel) -> str:
    """The content runs of a page in page order, one a line."""
    page = parse(source)
    return "\n".join(t for t, p in zip(page.texts, model.marginals(page)) if t and p >= 0.5)


def extract(pages: DataFrame, model: ContentModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of `pages`.

    Character references are decoded after parsing; white space within a block becomes one blank. Null and empty
    pages, and pages without content, give an empty text; null ids and urls and repeated rows are kept.
    """
    small_batches(pages.sparkSession)
    model = model or train()

    def run(batches):
        for batch in batches:
            texts = [main_text(x or "", model) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(
        pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html")
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
