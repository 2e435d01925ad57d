"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: Up to the end of a tag, or to a quote without its other end; what was matched is never given back, so a tag is read once.
INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)

#: Fixed values of HTML: elements without content, elements whose content is text only, and elements that start a line of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
#: An opening tag ends an open element of its group, unless one of the stops was opened since: the group's bit, what ends it, and the stops.
GROUPS = (
    (1, {"p"}, CLOSES_P, {"table", "caption", "td", "th", "button", "object", "template", "html", "body"}),
    (2, {"li"}, {"li"}, {"ul", "ol", "menu"}),
    (4, {"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    (8, {"tr"}, {"tr"}, {"table"}),
    (16, {"td", "th"}, {"td", "th"}, {"tr", "table"}),
    (32, {"option"}, {"option", "optgroup"}, {"select"}),
)
OWN = {t: bit for bit, own, _, _ in GROUPS for t in own}
CLOSED = {t: [bit for bit, _, ends, _ in GROUPS if t in ends] for _, _, ends, _ in GROUPS for t in ends}
STOPPED = {t: sum(bit for bit, _, _, stops in GROUPS if t in stops) for _, _, _, stops in GROUPS for t in stops}
#: Elements whose content isn't shown as text.
UNSHOWN = frozenset("script style noscript template iframe head title svg object embed canvas input textarea select button datalist option noembed noframes".split())
#: Elements that are page parts, and names in class, id or role of such parts: a name as a whole, what it may begin with, and what may stand before it.
DROPPED = frozenset("nav footer aside form menu dialog label".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus disclaimer footer login menu "
    "modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion related replies reply respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe toolbar widget".split()
)
HEADER_WORDS = frozenset(("header", "masthead"))
BEGINS = re.compile(
    r"(?:ads?|adverts?|advertisement|adsense|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|login|menu|modal|nav|navbar|navigation|newsletter|pagination|popup|promo|"
    r"share|sharing|sidebar|signup|skip|social|sponsor|sponsored|subscribe|toolbar)[-_]|related[-_]+(?:articles|content|items|links|news|pages|posts|products|stories|topics)$"
)
BEFORE = re.compile(r"(?:site|page|main|global|top|bottom|left|right|primary|secondary|mobile)[-_]+")
OF_TEXT = re.compile(r"(?:article|blog|entry|post)[-_]+")
#: What an element has or how it is, as in `has-sidebar` or `comments-enabled`, isn't what it is.
LAYOUT = re.compile(r"(?:has|with|without|no|is|js)[-_]|.*[-_](?:enabled|disabled|open|closed|on|off|none|layout)$")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p".split())
KEPT = frozenset("html body main article".split())
#: What continues a text beside it in one box, as its headings and paragraphs do.
FLOW = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre ul ol dl table figure".split())
#: A box beside the chosen subtree belongs to it if its densities sum to at least this share of that subtree's.
SHARE = 0.2


class Node:
    """An element. shown: whether its content is text on the page; named: whether a list has its tag or name; own: whether it is a page part by that; part: whether it, or what it lies in, is one; closed: whether
    its own closing tag ended it. chars, tags, link_chars and
    link_tags are those of its subtree, density is its composite text density, total the sum of its children's and most the largest such sum in its subtree. scope has the bits of GROUPS that are open in it."""

    __slots__ = ("tag", "parent", "children", "shown", "part", "own", "named", "closed", "inside", "scope", "chars", "tags", "link_chars", "link_tags", "density", "total", "most")

    def __init__(self, tag: str, parent: Node | None, shown: bool = True):
        self.tag, self.parent, self.shown = tag, parent, shown
        self.part = self.own = self.named = self.closed = False
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.scope = (parent.scope & ~STOPPED.get(tag, 0) if parent else 0) | OWN.get(tag, 0)
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = self.most = 0.0


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by name in lower case; the first of a name counts."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or bool(NO_DISPLAY.search(attributes.get("style", "")))


def is_named(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element's name is that of a page part. inside: whether it lies in an article."""
    if tag in KEPT:
        return False
    # the id of a heading or paragraph is made from its words
    names = [n for a in ("class", "role", *(() if tag in HEADINGS else ("id",))) for n in attributes.get(a, "").lower().split()]
    bare = [n[m.end() :] if (m := BEFORE.match(n)) else n for n in names]
    parts = [n[m.end() :] if (m := OF_TEXT.match(n)) else n for n in bare]
    if any(n in DROPPED_WORDS or (BEGINS.match(n) and not LAYOUT.match(n)) for n in parts):
        return True
    return (tag == "header" or any(n in HEADER_WORDS for n in bare)) and not inside  # a page's header goes, that of an article holds its title


def parse(html: str) -> Node:
    """A forgiving tree in one pass: closing tags without a match are ignored, open elements end with their parent, an unfinished tag at the end says nothing.

    Every look up the tree ends what it passes, so the time is that of the page's length, whatever is left open in it.
    """
    root = top = Node("#root", None)
    opened: dict[str, int] = {}
    at, end = 0, len(html)

    def close(x: Node) -> None:
        """Ends the open elements down from top to x."""
        nonlocal top
        while True:
            opened[top.tag] -= 1
            done, top = top is x, top.parent
            if done:
                return

    while at < end:
        begin = html.find("<", at)
        if begin < 0:
            top.children.append(html[at:])
            break
        m = NAME.match(html, begin + 1)
        if m is None and html[begin + 1 : begin + 2] not in ("!", "?", "/"):
            # a sign of its own
            top.children.append(html[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            top.children.append(html[at:begin])
        if m is None:
            ends = "-->" if html.startswith("<!--", begin) else ">"
            at = html.find(ends, begin + 2)
            at = end if at < 0 else at + len(ends)
            continue
        stop = INSIDE.match(html, m.end()).end()
        if stop >= end or html[stop] != ">":
            # a quote without its other end is a sign like others
            stop = html.find(">", m.end())
            if stop < 0:
                break
        inner, at = html[m.end() : stop], stop + 1
        tag = m[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            if opened.get(tag):
                x = top
                while x.tag != tag:
                    x = x.parent
                x.closed = True
                close(x)
            continue
        for bit in CLOSED.get(tag, ()):
            if top.scope & bit:
                x = top
                while OWN.get(x.tag) != bit:
                    x = x.parent
                close(x)
        attributes = attributes_of(inner) if inner else {}
        node = Node(tag, top, top.shown and tag not in UNSHOWN and not (attributes and tag not in KEPT and is_hidden(attributes)))
        node.named = tag in DROPPED or (bool(attributes or tag == "header") and is_named(tag, attributes, top.inside))
        top.children.append(node)
        if tag in RAW:
            ended = re.compile(rf"</{tag}(?![^\s/>])", re.I).search(html, at)
            stop = html.find(">", ended.end()) if ended else -1
            if node.shown:
                node.children.append(html[at : ended.start() if ended else end])
            at = stop + 1 if stop >= 0 else end
        elif tag not in VOID and not inner.endswith("/"):
            top = node
            opened[tag] = opened.get(tag, 0) + 1
    return root


def nodes_of(root: Node) -> list[Node]:
    """Parents before their children."""
    found = [root]
    for x in found:
        found.extend(c for c in x.children if isinstance(c, Node))
    return found


def mark_parts(root: Node) -> None:
    """Marks elements that the lists have as page parts, but not where such a name is that of the page's layout: on what holds most of the page's words that aren't links, and an
    article, its title or main part as well, if the page has such.

    The same holds for tags, so a page inside a form, or behind the opening of a menu that is never closed, isn't lost. Where nothing says what the article is, a tag is believed unless it is a form or wasn't closed.
    """
    nodes = nodes_of(root)
    if not any(x.named for x in nodes):
        return
    own: dict[Node, int] = {}
    titles: dict[Node, int] = {}
    for x in reversed(nodes):
        if x.shown:
            titles[x] = titles.get(x, 0) + (x.tag in ("h1", "article", "main"))
            own[x] = own.get(x, 0) + (0 if x.tag == "a" else sum(len(c.strip()) for c in x.children if isinstance(c, str)))
            if x.parent is not None:
                own[x.parent] = own.get(x.parent, 0) + (0 if x.tag == "a" else own[x])
                titles[x.parent] = titles.get(x.parent, 0) + titles[x]
    most, titled = own.get(root, 0) / 2, titles.get(root, 0) > 0
    for x in nodes:
        layout = own.get(x, 0) > most and (titles[x] > 0 or (not titled and (x.tag not in DROPPED or x.tag == "form" or not x.closed)))
        x.own = x.named and not layout
        x.part = x.own or (x.parent is not None and x.parent.part)


def unmark(node: Node, body: Node) -> None:
    """The element and what it lies in are no page parts; parts inside it stay."""
    x = node
    while x is not None:
        x.own, x = False, x.parent
    for x in nodes_of(body):
        x.part = x.own or (x is not body and x.parent.part)


def composite(c: int, t: int, lc: int, lt: int, share: float) -> float:
    """Composite text density: characters for each tag, less the more of both are links. share: that of links in the body's characters."""
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    return c / max(t, 1) * max(math.log(c / max(lc, 1) * max(t, 1) / max(lt, 1)), 0.0) / base


def measure(root: Node) -> Node:
    """Composite densities of all elements, and the sums of their children's; returns the body, or the root where there is none. Page parts are measured like the rest."""
    nodes = nodes_of(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    for x in reversed(nodes):
        if not x.shown:
            continue
        x.chars += sum(len(c.strip()) for c in x.children if isinstance(c, str))
        if x.tag == "a":
            x.link_chars = x.chars
        if (p := x.parent) is not None:
            p.chars += x.chars
            p.tags += x.tags + 1
            p.link_chars += x.link_chars
            p.link_tags += x.link_tags + (x.tag == "a")
    share = body.link_chars / max(body.chars, 1)
    for x in nodes:
        if x.shown and x.chars:
            x.density = composite(x.chars, x.tags, x.link_chars, x.link_tags, share)
    for x in nodes:
        inner = [c.density for c in x.children if isinstance(c, Node) and c.chars and c.tag in BLOCK]
        # a box without boxes is its own child
        x.total = x.most = sum(inner) if inner else x.density
    for x in reversed(nodes):
        if x.parent is not None and x.shown:
            x.parent.most = max(x.parent.most, x.most)
    return body


def main_node(body: Node) -> tuple[Node, float]:
    """The subtree whose densities sum to most of all that are shown (the outermost of equals), and the threshold: the least density on the path from the body to it.

    If lists have it as a page part, the best of the others that is as dense as the body takes its place; without such a one it stays, and is no part.
    """
    boxes = [x for x in nodes_of(body) if x.shown and x.chars and (x.tag in BLOCK or x is body)]
    best = max(boxes, key=lambda x: x.total, default=body)
    if best.part:
        other = max((x for x in boxes if not x.part and x.density >= body.density and (x is not body or spoken(body))), key=lambda x: x.total, default=None)
        if other is None:
            unmark(best, body)
        else:
            best = other
    least, x = best.density, best
    while x is not body:
        x = x.parent
        least = min(least, x.density)
    return best, least


def spoken(node: Node) -> bool:
    """Whether anything shown is left of an element without its page parts."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                return True
        elif x.shown and not x.part:
            todo.extend(x.children)
    return False


def chosen(node: Node, body: Node, least: float) -> list[Node | str]:
    """The subtree and what lies beside its path to the body and belongs to it, in page order: boxes at least as dense as the threshold with densities in them that sum to
    SHARE of the subtree's, and, in its own box, words, headings and the like at least as dense."""
    before: list[Node | str] = []
    after: list[Node | str] = []
    x = node
    while x is not body:
        up = x.parent
        at = next(k for k, c in enumerate(up.children) if c is x)
        belongs = [c for c in up.children if c is x or (bool(c.strip()) and x is node if isinstance(c, str) else is_beside(c, node, least, x is node))]
        split = next(k for k, c in enumerate(belongs) if c is x)
        before[:0] = belongs[:split]
        after.extend(belongs[split + 1 :])
        x = up
    return [*before, node, *after]


def is_beside(c: Node, node: Node, least: float, near: bool) -> bool:
    if not c.shown or c.part or not c.chars or c.density < least:
        return False
    return c.most >= SHARE * node.total or (near and c.tag in FLOW)


def blocks(found: list[Node | str], least: float) -> list[str]:
    """Text by blocks in page order, without page parts and the boxes of links that are sparser than the threshold."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        if run:
            if line := " ".join("".join(run).split()):
                out.append(line)
            run.clear()

    todo: list = found[::-1]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(unescape(x) if "&" in x else x)
        elif x.shown and not x.part and not (x.density < least and x.link_tags > 1 and 2 * x.link_chars > x.chars and x.tag in BLOCK and x.tag not in HEADINGS):
            block = x.tag in BLOCK
            if block:
                end()
                todo.append(None)
            # the links that a menu which was never closed begins with are its own
            inner = [c for c in x.children if isinstance(c, str) or c.tag != "a"] if x.tag in ("nav", "menu") else x.children
            todo.extend(reversed(inner))
    end()
    return out


def extract(html: str | None, lists: bool = True, density: bool = True) -> str:
    """The main text: blocks joined by a line feed, white space inside a block made one space. Null, empty or markup-only input gives the empty string.

    Density chooses, over all elements that are shown: the subtree with the largest sum, and the boxes beside it that are as dense as the path to it. The lists of page parts (menus, notices,
    comments) pass over a choice that they name where another is as dense as the body, and cut parts out of what was chosen. A part that holds most of a page (a form around it, a menu that is
    never closed) is none. lists and density turn either off, to see what it does.
    """
    if not html:
        return ""
    root = parse(html)
    if lists:
        mark_parts(root)
    else:
        for x in nodes_of(root):
            x.part = x.own = False
    body = measure(root)
    if not density:
        return "\n".join(blocks([body], -1.0))
    node, least = main_node(body)
    return "\n".join(blocks(chosen(node, body, least), least))


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and n_chars in place of html; every row is kept, repeated rows alike. Columns named text or n_chars are replaced."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([extract(x) for x in b], dtype=object)

    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    return pages.select(*[F.col(f"`{c}`") for c in kept], run(F.col(html)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
