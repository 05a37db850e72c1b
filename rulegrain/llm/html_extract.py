"""Main text of HTML pages by composite text density.

A page is parsed into elements, and what is never content is left out (scripts, styles, what is
hidden).  So are menus, forms, adverts, comments and other parts that tags, roles or class names
declare; but where no <main> or <article> says what the content is, a declaration may be that of a
wrapper ('has-sidebar', a form around the page).  There an element that holds the core of the page
as measured with all declared parts in it, or most of the text outside links, stays; one named
after comments only if it holds `INNER_SHARE` of that text.  For every
element of the rest: composite density = characters per tag, times a logarithm that falls with the
share of link text; density sum = the sum of its children's densities.  The element of the largest
sum is the core of the content.  The smallest density on the path from it to the body is the
threshold: every element that reaches it, and whose parents do, adds its own maximum-sum subtree.
A core inside <article> or <main> stands for that whole element.

Defined cases: null or empty pages and pages without text give an empty text; unclosed and
misnested tags are closed as browsers do for paragraphs, items, cells and formatting; repeated rows
each get a row; null ids and urls are passed through."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: elements and words of class names ----------------------------------------------
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head title script style noscript template iframe object svg canvas audio video map math".split())
PARTS = set("nav footer aside form button select textarea input dialog menu".split())
PART_ROLES = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
PART_WORDS = set("""ad ads advert adverts advertisement adverts banner sponsor sponsored promo promotion nav navbar
 navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead cookie cookies consent gdpr
 notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related recommended
 comment comments reply replies disqus respond widget widgets toolbar login signup search pagination pager skip
 form""".split())
BLOCKS = set("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
 figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol optgroup option p pre section summary
 table tbody td tfoot th thead tr ul""".split())
#: A start tag ends the open elements of its group, up to the nearest of the bounds.
CLOSES = {
    **dict.fromkeys(BLOCKS - {"br"}, (frozenset({"p"}), frozenset({"td", "th", "table", "body", "button", "article",
                                                                     "section", "div", "blockquote", "li", "main"}))),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
COMMENT_WORDS = set("comment comments reply replies disqus respond".split())
INNER_SHARE = 0.8
HEADINGS = set("h1 h2".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Element:
    __slots__ = ("tag", "attrs", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total",
                 "best", "tight", "holds_main", "holds_heading", "part", "declared")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []
        self.holds_main = self.holds_heading = self.part = self.declared = False
        self.density = self.total = 0.0
        self.best = self.tight = self


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {}, None)
        self.at = self.root
        self.depth = Counter({"html": 1})  # of open elements by tag, so that nothing unopened is looked for

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.depth[tag]:
            return
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            self._close(ends, bounds - ends)
        if tag == "body" or self.at.tag == "head" and tag not in UNSEEN and tag not in VOID:
            self._leave(self.root)
        node = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.depth[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag not in BLOCKS:
            self._leave(self.at.parent or self.root)

    def handle_endtag(self, tag):
        if tag in ("body", "html") or tag in VOID:
            return  # what follows still belongs to the page
        self._close(frozenset({tag}), frozenset({"body", "article", "main", "td", "th", "table"}) - {tag}
                    if tag not in BLOCKS else frozenset({"body"}))

    def handle_data(self, data):
        self.at.children.append(data)

    def _close(self, ends, bounds) -> None:
        if not any(self.depth[tag] for tag in ends):
            return
        node: Element | None = self.at
        while node is not None and node.tag not in bounds:
            if node.tag in ends:
                self._leave(node.parent or self.root)
                return
            node = node.parent

    def _leave(self, to: Element) -> None:
        """Close what is open inside `to`."""
        while self.at is not to and self.at.parent is not None:
            self.depth[self.at.tag] -= 1
            self.at = self.at.parent


def _names_part(node: Element, words: set[str] = PART_WORDS) -> bool:
    found = _WORD.findall(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}")
    return any(w.lower() in words for w in found)


def _order(root: Element) -> list[Element]:
    """Elements, parents first; without recursion, as pages may be nested deeply."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Element))
    return out


def _mark_parts(order: list[Element]) -> None:
    for node in reversed(order):
        node.holds_main |= node.tag in ("main", "article") or node.attrs.get("role") == "main"
        node.holds_heading |= node.tag in HEADINGS
        if node.parent is not None and node.tag not in UNSEEN:
            node.parent.holds_main |= node.holds_main and not _names_part(node)
            node.parent.holds_heading |= node.holds_heading
    inside: set[int] = set()
    for node in order:
        if node.parent is not None and id(node.parent) in inside or node.tag in ("article", "main"):
            inside.add(id(node))
        attrs = node.attrs
        if node.tag in UNSEEN:
            node.part = True
        elif node.tag in ("html", "body"):
            continue
        elif ("hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", ""))):
            node.part = True
        elif node.tag == "article":
            node.declared = _names_part(node) and not any(
                isinstance(c, Element) and c.holds_main for c in node.children) and bool(
                {"comment", "comments", "reply", "ad", "ads", "related", "promo", "sponsored"}
                & {w.lower() for w in _WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")})
        elif not node.holds_main:
            titled = id(node) in inside and node.holds_heading
            node.declared = node.tag in PARTS or (not titled and (
                node.tag == "header" or attrs.get("role") in PART_ROLES or _names_part(node)))


def _cut_declared(order: list[Element]) -> None:
    """Leave declared parts out, but not the wrappers of a page that declares no content, nor a wrapper
    of nearly all the text of the content it stands in."""
    declared, body = [n for n in order if n.declared], order[0]
    wrappers: set[int] = set()
    if declared:
        _measure(order)
    if declared and not body.holds_main:
        node: Element | None = _best_below(body)
        while node is not None and node is not body:
            wrappers.add(id(node))
            node = node.parent
        whole = body.chars - body.link_chars
        for n in declared:
            own = n.chars - n.link_chars
            if _names_part(n, COMMENT_WORDS):
                if own >= INNER_SHARE * whole > 0:
                    wrappers.add(id(n))
                else:
                    wrappers.discard(id(n))
            elif 2 * own > whole:
                wrappers.add(id(n))
    elif declared:
        scope: dict[int, Element] = {}  # the content that an element stands in, if no other content stands beside it
        for node in order:
            if node.tag == "article" or node.tag == "main" and not any(
                    isinstance(c, Element) and c.holds_main for c in node.children):
                scope[id(node)] = node
            elif node.parent is not None and id(node.parent) in scope:
                scope[id(node)] = scope[id(node.parent)]
        for n in declared:
            around = scope.get(id(n))
            if around is not None and around is not n and not around.declared:
                whole = around.chars - around.link_chars
                if n.chars - n.link_chars >= INNER_SHARE * whole > 0:
                    wrappers.add(id(n))
    for n in declared:
        n.part = id(n) not in wrappers


def _measure(order: list[Element]) -> None:
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
        for child in node.children:
            if isinstance(child, str):
                node.chars += len("".join(child.split()))
            elif not child.part:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    body = order[0]
    share = body.link_chars / max(1, body.chars)
    for node in reversed(order):
        if node.part or not node.chars:
            continue
        plain, tags = node.chars / max(1, node.tags), max(1, node.tags)
        base = math.log(node.chars / max(1, node.chars - node.link_chars) * node.link_chars
                        + share * node.chars + math.e)
        top = node.chars / max(1, node.link_chars) * tags / max(1, node.link_tags)
        node.density = plain * math.log(max(top, 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else \
            plain * math.log(max(top, 1.0) + 1)
    for node in reversed(order):  # children first: each subtree is looked at once
        seen = [c for c in node.children if isinstance(c, Element) and not c.part]
        node.total = sum(c.density for c in seen)
        node.best = node.tight = node
        for c in seen:
            if c.best.total > node.best.total:
                node.best = c.best
        inner = max(seen, key=lambda c: c.total, default=None)
        if inner is not None and inner.total and inner.total >= INNER_SHARE * node.total:
            node.tight = inner.tight  # a child with nearly all of the sum is the tighter choice


def _best_below(node: Element) -> Element:
    """The first element with the largest density sum at or below; of nested ones with nearly all of it, the inner."""
    return node.best.tight


def _content(body: Element) -> set[int]:
    """Elements whose subtrees are content."""
    core = _best_below(body)
    low, node = core.density, core
    while node is not body and node.parent is not None:
        node = node.parent
        low = min(low, node.density)
    # a core inside <article> or <main> stands for the outermost article, else the main element
    holder, node = None, core
    while node is not None and node is not body:
        if node.tag == "article" or node.tag == "main" and (holder is None or holder.tag != "article"):
            holder = node
        node = node.parent
    if holder is not None:
        return {id(holder)}
    chosen, stack = {id(core)}, [body]
    while stack:
        at = stack.pop()
        for child in at.children:
            if isinstance(child, Element) and not child.part and child.density >= low and id(child) not in chosen:
                chosen.add(id(_best_below(child)) if child.total else id(child))
                stack.append(child)
    return chosen


def _blocks(body: Element, chosen: set[int]) -> list[str]:
    out, held = [], []

    def flush():
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    stack: list[tuple[Element | str | None, bool]] = [(body, False)]
    while stack:
        node, inside = stack.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            if inside:
                held.append(node)
        elif not node.part:
            inside = inside or id(node) in chosen
            if node.tag in BLOCKS:
                flush()
                stack.append((None, inside))
            stack.extend((c, inside) for c in reversed(node.children))
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    body = next((n for n in tree.root.children if isinstance(n, Element) and n.tag == "body"), tree.root)
    order = _order(body)
    _mark_parts(order)
    _cut_declared(order)
    _measure(order)
    return " ".join(_blocks(body, _content(body)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [main_text(h) for h in part.column("page_html").to_pylist()]
            kept = [c for c in part.schema.names if c != "page_html"]
            yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(texts, pa.string())],
                                             names=[*kept, "page_text"])


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns (all but the html, if left out) with `text` and `n_chars`, its code points."""
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    plain = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                         F.col(f"`{html}`").alias("page_html"))
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("page_text", T.StringType())])
    return plain.mapInArrow(_extract, schema).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("page_text").alias("text"),
        F.char_length("page_text").cast("bigint").alias("n_chars"))
