"""Operator 6: main text of web pages by tree scoring.

The page becomes a tree. Blocks of text (paragraphs and the like) earn points for
their length and commas; they pass all of them to their parent, half to its
parent, and falling shares further up. A container's points are discounted by its
link density (characters in links over all characters). The best container is
kept. On the way up from it, what stands beside it is part of the same article as long
as no element is reached that is an article or named as one, nor the page's body:
sections, lists, tables and bare text are kept there unless a quarter of their characters are in links.
From there on only headings are kept, and beside the best container itself what scores a fifth of
its points (ten at least), paragraphs that read like prose, and elements of its own tag and class.

Elements that never hold the article (scripts, menus, headers, footers, asides,
what is hidden) are left out beforehand by their tag. Forms, and elements whose
class, id or role names a menu, sidebar, notice, advert or the like, are doubtful:
a form is left out unless most of the page's points lie in it, a named element
unless nearly nothing, or no sentence, would be left, so that a layout's name or a form around the
whole page costs no article. What is named only as comments of readers, adverts or consent boxes stays out; with
other names beside (newsletter issue-12) it is kept where it has most of the points and no
sentence would be left without it. A list named a menu, without any link, is a list as any other.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never part of the article.
NEVER = frozenset("head script style noscript template nav header footer aside button select option textarea input iframe object embed svg canvas audio video dialog menu title noframes xmp".split())
#: Elements that make a block of their own.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Blocks whose text earns points.
PARAGRAPH = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption div section article main body center".split())
#: What a start tag ends when it is open in the same parent: the tags that HTML closes by themselves.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tfoot", "tr", "td", "th"),
}
#: Where the search for an element to close ends.
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",)}
#: What a start tag's element ends, and what bounds that, by the element that is open.
ENDED_BY = {x: [t for t, own in CLOSES.items() if x in own] for own in CLOSES.values() for x in own}
BOUNDED_BY = {x: [t for t, own in SCOPE.items() if x in own] for own in SCOPE.values() for x in own}
#: Where the search for an open paragraph ends.
BOUNDARY = frozenset("table td th li div article section main blockquote body button".split())
#: Roles, and words in class or id, of what is not the article.
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
UNLIKELY = re.compile(r"(?:^|[\s_-])(?:banners?|breadcrumbs?|header|login|masthead|modal|notices?|overlay|pagination|pager|promo\w*|related|replies|respond|share|sharing|signup|social|toolbar|widgets?)(?:$|[\s_-])", re.I)
#: The same, whatever other words stand with them.
NEVER_NAMED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|menu|nav|navbar|navigation|newsletter|popup|shoutbox|sidebar|sidenav|sponsor\w*|subscribe)(?:$|[\s_-])", re.I)
#: Of these, what is never the article even where nothing else is left.
FOREIGN = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|commentlist|consent|cookies?|disqus|gdpr|newsletter|popup|sponsor\w*|subscribe)(?:$|[\s_-])", re.I)
#: A name of several parts that tells how a page is laid out, not what an element is: no-sidebar, with-nav, comments-open.
LAYOUT = re.compile(r"(?:^|\s)(?:(?:no|without|with|has|hide|show)[_-]\S+|\S+[_-](?:open|closed|on|off|enabled|disabled|visible|hidden))(?=$|\s)", re.I)
#: What a navigation may be called, and a list of dishes too, if it is one of these.
LISTS = frozenset("ul ol dl table".split())
MENU = re.compile(r"(?:^|[\s_-])menu(?:$|[\s_-])", re.I)
#: How doubtful an element is: a form, a menu, a name that a layout may have too, a name of what doesn't belong to the article among other names or alone.
FORM, MENUS, NAMED, MIXED, OTHERS = 1, 2, 3, 4, 5
#: The link density below which what stands beside the best container is kept; points of a container further out, and their share of the best one's.
LINKED, LEAST_POINTS, LEAST_SHARE = 0.25, 10.0, 0.2
#: The share of the page's points that keeps a form or, where the rest has less than the second share, a named element.
MOST, NEXT_TO_NOTHING = 0.5, 0.1
#: What looks unlikely by a word but may hold the article all the same.
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("chars", "closable", "doubt", "kids", "links", "names", "out", "own", "paragraph", "parent", "points", "size", "tag", "worth")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, doubt: int = 0, names: str = ""):
        self.tag, self.parent, self.out, self.doubt, self.names = tag, parent, out, doubt, names
        self.kids: list[Node | str] = []
        self.points = self.worth = 0.0
        self.size = self.links = 0
        #: Characters of its own strings, and commas and characters of _own_text(), once they are known.
        self.chars: int | None = None
        self.own: tuple[int, int] | None = None
        #: The open paragraph that a block here would end.
        self.paragraph: Node | None = self if tag == "p" else None if parent is None or tag in BOUNDARY else parent.paragraph
        #: By tag, the outermost open element that its start tag would end; shared with the parent while nothing changes.
        self.closable: dict[str, Node] = {} if parent is None else parent.closable
        ends = [t for t in ENDED_BY.get(tag, ()) if t not in self.closable]
        bounds = [t for t in BOUNDED_BY.get(tag, ()) if t in self.closable]
        if ends or bounds:
            self.closable = {t: n for t, n in self.closable.items() if t not in bounds} | dict.fromkeys((t for t in ends if t not in BOUNDED_BY.get(tag, ())), self)


def _judged(tag: str, attributes: str) -> tuple[bool, int, str]:
    """Whether an element is left out, how doubtful it is, and its class and id."""
    if tag in NEVER:
        return True, 0, ""
    doubt = FORM if tag == "form" else 0
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return False, doubt, ""
    names = []
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = html.unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "")
        if key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and _HIDDEN.search(value)):
            return True, 0, ""
        if key == "role" and value.strip().lower() in ROLES:
            doubt = max(doubt, FORM if value.strip().lower() == "form" else NAMED)
        if key in ("class", "id"):
            names.append(value)
    whole = " ".join(names)
    own = LAYOUT.sub(" ", whole)
    if own and (NEVER_NAMED.search(own) or (UNLIKELY.search(own) and not LIKELY.search(own))):
        if FOREIGN.search(own):
            doubt = OTHERS if all(FOREIGN.search(LAYOUT.sub(" ", x)) for x in whole.split()) else MIXED
        else:
            doubt = NAMED if doubt == NAMED or NEVER_NAMED.search(rest := MENU.sub(" ", own)) or UNLIKELY.search(rest) or tag not in LISTS else MENUS
    return False, doubt, whole


def parse(page: str) -> Node:
    """The tree of a page, with the ends of elements that HTML leaves out put in. Linear in the page: an end tag without an open element is passed over by a count, what a start tag ends is kept at each node."""
    root = node = Node("#root", None)
    at, lower = 0, None
    inside: Counter[str] = Counter()  # open elements by tag
    in_article = 0

    def text(s: str) -> None:
        if s and not node.out:
            node.kids.append(html.unescape(s) if "&" in s else s)

    def close(last: Node) -> Node:
        """Closes all open elements up to and with `last`."""
        up = node
        while True:
            inside[up.tag] -= 1
            if up is last:
                return up.parent
            up = up.parent

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if inside[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = close(up)
            elif tag == "p":
                node.kids.append(Node("p", node, node.out))
            continue
        if tag in BLOCK and node.paragraph is not None:  # an open paragraph ends where a block begins
            node = close(node.paragraph)
        if tag in CLOSES and tag in node.closable:
            node = close(node.closable[tag])
        in_article = inside["article"]
        out, doubt, names = _judged(tag, m[3] or "")
        new = Node(tag, node, node.out or (out and not (tag == "header" and in_article)), doubt, names)
        node.kids.append(new)
        if tag in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find(f"</{tag}", at) if len(lower) == len(page) else -1
            if len(lower) != len(page):
                found = re.compile(f"</{tag}", re.I).search(page, at)
                end = found.start() if found else -1
            end = len(page) if end < 0 else end
            stop = page.find(">", end)
            at = len(page) if stop < 0 else stop + 1
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            node = new
            inside[tag] += 1
    return root


def _measured(root: Node) -> list[Node]:
    """All kept elements, children first, with their sizes and characters in links."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.size = node.links = 0
        node.points = 0.0
        order.append(node)
        stack += [k for k in node.kids if isinstance(k, Node) and not k.out]
    order.reverse()
    for node in order:
        if node.chars is None:
            node.chars = sum(len(" ".join(k.split())) for k in node.kids if isinstance(k, str))
        node.size = node.chars
        for k in node.kids:
            if not isinstance(k, str) and not k.out:
                node.size += k.size
                node.links += k.links
        if node.tag == "a":
            node.links = node.size
    return order


def _points(node: Node) -> float:
    """What a node's own text is worth: for its length and commas, less what is in links."""
    if node.tag not in PARAGRAPH or not node.size:
        return 0.0
    if node.own is None:
        text = _own_text(node)
        node.own = text.count(","), len(text)
    commas, length = node.own
    return (1 + commas + min(length / 100, 30)) * (1 - _density(node)) if length else 0.0


def settle(root: Node) -> None:
    """Decides which doubtful elements are left out."""
    order = _measured(root)
    if not any(n.doubt for n in order):
        return
    for node in order:
        node.out = node.doubt == OTHERS
    order = _measured(root)
    for node in order:
        node.worth = _points(node) + sum(k.worth for k in node.kids if isinstance(k, Node) and not k.out)
    total = root.worth
    doubtful = [n for n in order if n.doubt]
    for node in doubtful:
        node.out = node.worth <= MOST * total if node.doubt == FORM else node.links > 0 if node.doubt == MENUS else True
    lost, stack = 0.0, [root]
    while stack:
        node = stack.pop()
        if node.out:
            lost += node.worth
        else:
            stack += [k for k in node.kids if isinstance(k, Node) and (k.doubt or not k.out)]
    large = [n for n in doubtful if n.doubt in (MENUS, NAMED, MIXED) and n.out and n.worth > MOST * total]
    if large:
        silent = not _speaks(root)
        for node in large:
            node.out = not (silent or (node.doubt != MIXED and total - lost < NEXT_TO_NOTHING * total))
    changed: set[Node] = set()
    for node in doubtful:  # what is left out within a line is no part of its block's text
        up = node.parent if node.out and node.tag not in BLOCK else None
        while up is not None and up not in changed:
            up.own = None
            changed.add(up)
            up = None if up.tag in BLOCK else up.parent


def _speaks(root: Node) -> bool:
    """Whether a sentence is left of what is kept."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in PARAGRAPH and node.tag not in ("h1", "h2", "h3", "h4", "h5", "h6") and _density(node) < MOST and _own_text(node).endswith((".", "!", "?", "…")):
            return True
        stack += [k for k in node.kids if isinstance(k, Node) and not k.out]
    return False


def _own_text(node: Node) -> str:
    """Text of a node that is in no block below it."""
    parts, stack = [], list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            parts.append(k)
        elif not k.out and k.tag not in BLOCK:
            stack += reversed(k.kids)
    return " ".join("".join(parts).split())


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def choose(root: Node) -> list:
    """The best container and what is kept with it, in page order; none for a page without text."""
    settle(root)
    order = _measured(root)
    scored = set()
    for node in order:
        if not (points := _points(node)):
            continue
        up, share = node.parent, 1.0
        for level in range(4):
            if up is None:
                break
            up.points += points * share
            scored.add(up)
            up, share = up.parent, 0.5 / (level + 1)
    best, most = None, -1.0
    for node in reversed(order):  # outer ones first among equals
        if node in scored and node.tag not in ("#root", "html", "p", "b", "i", "em", "strong", "span", "a") and (value := node.points * (1 - _density(node))) > most:
            best, most = node, value
    if best is None:
        whole = [n for n in order if n.tag in ("body", "#root") and n.size]
        return whole[:1]
    up = best
    while up is not None and up.tag != "article":
        up = up.parent
    if up is not None:  # an article is kept whole
        best = up
    while best.parent is not None and best.parent.tag in ("article", "main"):
        best = best.parent
    return _around(best, most)


def _around(best: Node, most: float) -> list:
    """The best container and what is kept beside it and its ancestors, in page order: elements, strings, and None where something between is left out."""
    whole = best.tag in ("article", "main")
    settled = whole or _likely(best)
    before: list = []  # last ones first
    after: list = []
    node = best
    while node.parent is not None and node.tag != "body":
        up = node.parent
        near = not settled and up.tag not in ("body", "html", "#root") and node.tag not in ("td", "th", "tr", "tbody")
        at = next(i for i, k in enumerate(up.kids) if k is node)
        sieve = lambda kids: [k if _belongs(k, best, most, near, whole, node is best) else None for k in kids]  # noqa: B023, E731
        before += reversed(sieve(up.kids[:at]))
        after += sieve(up.kids[at + 1 :])
        settled = settled or _likely(up)
        node = up
    return [*reversed(before), best, *after]


def _likely(node: Node) -> bool:
    return bool(node.names) and LIKELY.search(node.names) is not None


def _belongs(k: Node | str, best: Node, most: float, near: bool, whole: bool, first: bool) -> bool:
    """Whether what stands beside the best container (first), or an ancestor of it, is part of the article."""
    if isinstance(k, str):
        return near
    if k.out or not k.size:
        return False
    dense = _density(k)
    if near and dense < LINKED:
        return True
    if first and k.points * (1 - dense) >= max(LEAST_POINTS, most * LEAST_SHARE):
        return True
    if whole:
        return False
    if first and k.tag == "p":
        own = _own_text(k)
        return (len(own) > 80 and dense < LINKED) or (own.endswith((".", "!", "?")) and not k.links)
    if first and k.tag == best.tag and k.names == best.names and dense < LINKED:
        return True
    return dense < LINKED and _heading(k)


def _heading(node: Node) -> bool:
    """Whether all text of an element is in headings of the two upper levels."""
    stack, found = [node], False
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            if k.strip():
                return False
        elif k.tag in ("h1", "h2"):
            found = found or k.size > 0
        elif not k.out:
            stack += k.kids
    return found


def blocks(nodes: list) -> list[str]:
    """The text blocks of some elements and strings, in page order; a None ends one."""
    out, parts = [], []

    def end() -> None:
        if parts and (s := " ".join("".join(parts).split())):
            out.append(s)
        parts.clear()

    for top in nodes:
        if top is None:
            end()
            continue
        stack: list = [(top, False)]
        while stack:
            k, done = stack.pop()
            if isinstance(k, str):
                parts.append(k)
            elif done:
                end()
            elif k.tag == "br":
                parts.append(" ")
            elif not k.out:
                if k.tag in BLOCK:
                    end()
                    stack.append((k, True))
                stack += [(x, False) for x in reversed(k.kids)]
    end()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page; empty for none, or where a page has no text of its own."""
    return "\n".join(blocks(choose(parse(page)))) if page else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for each row of pages(page_id, url, html).

    A null html is empty and gives an empty text. References are decoded, white
    space within a block is one space, blocks are joined by a line break; nothing
    else is dropped or cut. Pages are handled one by one, so repeated rows come
    out alike; extra columns are left out; an empty table gives no rows. Unclosed
    and misnested tags are closed as HTML does; time and memory follow a page's
    length, however deep or broken it is. What is kept beside the best container
    is told by LINKED, LEAST_POINTS and LEAST_SHARE, what doubtful elements need by MOST and NEXT_TO_NOTHING.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")
