"""Main text of web pages by tree scoring.

A page is read into a tree. Subtrees that cannot hold the article (menus, headers, footers, sidebars, notices,
adverts, comments, forms, scripts, styles, hidden parts; by tag, role or class) are cut off. A class or id alone
cuts off no part that holds a main element, an article, or a paragraph and most of the page's text; what names
comments, adverts or dialogs needs a main element, or most of the text under a first heading. Every paragraph gives
points for itself, its commas and its length to its ancestors, halved from the second ancestor on; a container's
sum is discounted by its share of text in links. An article or main element around the best container takes its
place. Without one, everything around the best container is kept up to the root of the page but link lists: parts
of which links make up half of the text or more, headings excepted.

The text holds the blocks in page order, joined by one line feed; references are decoded, white space inside a
block becomes one blank. A null, empty or textless page has the empty text. A tag that the end of the page cuts
off is dropped. Repeated rows give repeated results. Nothing is limited in length.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id bigint, url string, text string, n_chars bigint"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CUT = frozenset("script style noscript template head title nav footer aside form button select textarea iframe svg "
                 "canvas menu dialog object audio video map fieldset datalist".split())
_BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
                   "hr html li main ol p pre section summary table tbody tfoot thead tr ul caption header hgroup".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_PARAGRAPHS = frozenset("p pre td li dd blockquote figcaption".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts of class and id values that name what surrounds an article.
_AROUND = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side|menu\w*|nav|navbar|navigation|breadcrumbs?|"
    r"comments?|disqus|respond|replies|header|masthead|footer|foot|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscri\w*|shar(?:e|ing)|social|related|recommend\w*|widget|pag(?:er|ination)|login|signup|toolbar|skip)(?:$|[\s_-])", re.I)
#: Names of parts that may hold many paragraphs, even articles, of their own.
_FOREIGN = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|comments?|disqus|respond|replies|cookies?|consent|gdpr|popup|modal|"
    r"overlay|newsletter|subscri\w*|related|recommend\w*|login|signup)(?:$|[\s_-])", re.I)
_HEADER = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?=$|[\s_-])", re.I)
#: What a layout has or lacks is no name of the part itself.
_LAYOUT = re.compile(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[_-]\S*", re.I)
_KEEP = frozenset("html body article main".split())
#: An open element of the key is closed by the start of one of the values.
_CLOSES = {"p": _BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
           "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}}
_SCOPES = frozenset("table ul ol dl div section article body html".split())
_BONUS = {"article": 10.0, "main": 8.0, "section": 3.0, "div": 3.0, "td": 2.0, "blockquote": 2.0}
_TORN = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?\Z")


class Node:
    __slots__ = ("tag", "attrs", "parts", "parent", "points", "text", "linked", "holds")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.parent = tag, dict(attrs), parent
        self.parts, self.points, self.text, self.linked = [], 0.0, 0, 0
        self.holds = frozenset()


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")

    def handle_starttag(self, tag, attrs):
        open_ = self.at
        while open_.parent is not None:
            if tag in _CLOSES.get(open_.tag, ()):
                self.at = open_.parent
                break
            if open_.tag in _SCOPES:
                break
            open_ = open_.parent
        node = Node(tag, attrs, self.at)
        self.at.parts.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def _cut_off(node: Node, inside: bool) -> bool:
    tag, a = node.tag, node.attrs
    if tag in _CUT or (tag == "header" and not inside):
        return True
    if tag in _KEEP:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or (a.get("role") or "").lower() in _ROLES:
        return True
    if "style" in a and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a["style"] or "", re.I):
        return True
    return False


def _names(node: Node, inside: bool) -> list[str]:
    """Values of class and id that name a part around articles."""
    values = [_LAYOUT.sub("", node.attrs[k] or "") for k in ("class", "id") if k in node.attrs]
    if inside:
        values = [_HEADER.sub("", v) for v in values]
    return [v for v in values if _AROUND.search(v)]


def _named_off(node: Node, inside: bool, total: int) -> bool:
    """True if class or id name the node as a part around articles and its content does not speak against it."""
    names = [] if node.tag in _KEEP else _names(node, inside)
    if not names or "main" in node.holds:
        return False
    most = 2 * node.text > total and 2 * node.linked < node.text
    if any(_FOREIGN.search(v) for v in names):
        return not (most and "h1" in node.holds)
    return not ("article" in node.holds or most and "p" in node.holds)


def parse(html: str) -> Node:
    reader = _Reader()
    torn = _TORN.search(html, max(len(html) - 4096, 0))
    reader.feed(html[:torn.start()] if torn else html)
    reader.close()
    return reader.root


def prune(root: Node) -> list[Node]:
    """Cut off what surrounds articles; the remaining nodes, parents first."""
    order = _walk(root, _cut_off)
    _measure(order)
    for node in reversed(order):
        own = [p for p in node.parts if isinstance(p, Node)]
        node.holds = frozenset().union(*(p.holds for p in own), (
            p.tag for p in own if p.tag in ("main", "h1", "p") and p.text or p.tag == "article" and 2 * p.linked < p.text and not _names(p, True)))
    total = root.text
    return _walk(root, lambda node, inside: _named_off(node, inside, total))


def _walk(root: Node, off) -> list[Node]:
    """Drop the nodes that ``off(node, inside an article)`` names; the remaining ones, parents first."""
    order, waiting = [], [(root, False)]
    while waiting:
        node, inside = waiting.pop()
        order.append(node)
        inside = inside or node.tag in ("article", "main")
        node.parts = [p for p in node.parts if isinstance(p, str) or not off(p, inside)]
        waiting += [(p, inside) for p in reversed(node.parts) if isinstance(p, Node)]
    return order


def _measure(order: list[Node]) -> None:
    """Characters of text, and of text in links, of every node."""
    for node in reversed(order):
        own = [p for p in node.parts if isinstance(p, str)]
        node.text = sum(len(p.strip()) for p in own) + sum(p.text for p in node.parts if isinstance(p, Node))
        node.linked = node.text if node.tag == "a" else sum(p.linked for p in node.parts if isinstance(p, Node))


def score(order: list[Node]) -> Node | None:
    """Pass the points of paragraphs upwards; the best container, None without any text."""
    _measure(order)
    commas: dict[int, int] = {}
    for node in reversed(order):
        commas[id(node)] = sum(p.count(",") if isinstance(p, str) else commas[id(p)] for p in node.parts)
    holders = []
    for node in order:
        loose = node.tag in ("div", "section", "article", "main", "body", "html") and sum(
            len(p.strip()) for p in node.parts if isinstance(p, str)) > 0
        if not node.text or not (node.tag in _PARAGRAPHS or loose):
            continue
        density = node.linked / node.text
        gain = (1 + commas[id(node)] + min(node.text / 100, 3)) * (1 - density)
        share, up = 1.0, node if loose else node.parent
        while up is not None:
            if not up.points:
                up.points = _BONUS.get(up.tag, 0.1)
                holders.append(up)
            up.points += gain * share
            share, up = share / 2, up.parent
    if not holders:
        return order[0] if order[0].text else None
    return max(holders, key=lambda n: n.points * (1 - n.linked / max(n.text, 1)))


def chosen(best: Node) -> list[Node]:
    """The best container, widened to its article, with the siblings that belong to it."""
    up, around = best, None
    while up is not None:
        if up.tag in ("article", "main") and (around is None or around.tag == "main"):
            around = up
            if up.tag == "article":
                break
        up = up.parent
    if around is not None:
        return [around]
    up = best
    while up.parent is not None:
        up.parent.parts = _without_link_lists(up.parent.parts, up)
        up = up.parent
    return [up]


def _without_link_lists(parts: list, best: Node) -> list:
    """The parts without those blocks, and runs of text and inline elements, that are mostly links."""
    out, run = [], []

    def close():
        text = sum(len(p.strip()) if isinstance(p, str) else p.text for p in run)
        if 2 * sum(p.linked for p in run if isinstance(p, Node)) < text:
            out.extend(run)
        run.clear()

    for p in parts:
        if p is not best and (isinstance(p, str) or p.tag not in _BLOCK):
            run.append(p)
            continue
        close()
        if p is best or p.tag in _HEADINGS or 2 * p.linked < p.text:
            out.append(p)
    close()
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below the nodes in page order."""
    out, line = [], []

    def flush():
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    waiting = list(reversed(nodes))
    while waiting:
        part = waiting.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            line.append(part)
        elif part.tag in _BLOCK:
            flush()
            waiting.append(None)
            waiting += reversed(part.parts)
        else:
            if part.tag in ("br", "td", "th", "wbr"):
                line.append("" if part.tag == "wbr" else " ")
            waiting += reversed(part.parts)
    flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    best = score(prune(parse(html)))
    return "" if best is None else "\n".join(blocks(chosen(best)))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages(page_id, url, html)``."""
    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, SCHEMA)
