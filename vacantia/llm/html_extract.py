"""Main text of HTML pages by tree scoring.

A page is read into a tree with HTML's implied end tags. Elements that are never article text
(menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments)
are left out by tag, role or class and id. Of these, a name counts if it is one of the marking words
or put together of such words and words of position and form (``cookie-notice``, ``ad-slot``), so
``notice-board`` or ``survey-responses`` leaves nothing out. A name doesn't leave out what holds
every article or main element of the page, or all its text, unless it is of reader comments. Each paragraph gives points for its
length and commas to its container, and each container gives half of its points to the next one
around it; the points of a container are discounted by its link density. The best container and
those siblings that score like it, or are plain paragraphs, are kept, without boxes that are mostly
links. An article element around the best container is kept as a whole, with its lists of links, and
with those sibling articles that score like it.

Defined results: a null or empty page, or one without text outside the parts left out, gives an
empty text. Pages cut off inside a tag lose that tag. Pages are independent, so ties, repeated rows
and extra columns need nothing special; nothing is dropped or capped by length. Parsing and scoring
take time in proportion to the page, also for unclosed or deeply nested tags.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm.memory import small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=[/a-zA-Z])[^>]*(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript textarea title iframe xmp".split()}
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption html".split()
)
#: Elements beyond which a start tag ends no open paragraph, list item or table cell.
_SCOPE = frozenset("table td th ul ol dl html body article section div button".split())
_ITEMS, _CELLS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}, ("td", "th")
_NEVER = frozenset("head nav aside footer form button select input label iframe object embed dialog menu fieldset canvas audio video svg template".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of a class or id that mark reader comments, and those that mark other parts that are left
#: out wherever they stand.
_COMMENTS = frozenset("comment comments commenter commenters discussion disqus respond responses replies".split())
_BAD = _COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense dfp "
    "sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer "
    "newsletter popup modal banner notice notices notification notifications alert paywall outbrain taboola".split()
)
#: Words that do so outside an article element.
_BAD_OUTSIDE = frozenset(
    "header topbar masthead aside rail related recommended recommendations teaser teasers widget widgets share sharing social skip tags meta byline search "
    "subscribe subscription signup login pagination pager toolbar cta".split()
)
#: Words that may stand beside them in a name.
_BESIDE = frozenset(
    "site page main global primary secondary top bottom left right inner outer upper lower before after box block wrapper wrap container area section list item items bar panel slot "
    "unit mobile desktop sticky fixed floating overlay message messages text link links form thread count row col column inline reader readers user google html js id the and of for".split()
)
_GOOD = re.compile(r"\b(?:article|body|content|entry|main|page|post|story|text|blog|prose)", re.I)
_SAFE = frozenset("html body main".split())
#: Pages that are worked on at once.
ROWS = 200


class Node:
    __slots__ = ("tag", "words", "parent", "items", "left_out", "named", "score", "chars", "linked", "candidate", "depth", "inside", "before", "p", "item", "cell", "row")

    def __init__(self, tag: str, words: str, parent: Node | None, left_out: bool, before: Node | None = None):
        self.tag, self.words, self.parent, self.left_out, self.before = tag, words, parent, left_out, before
        self.named: str | None = None  # what its name marks it as, if only that leaves it out
        self.items: list = []  # texts and nodes in order
        self.score, self.chars, self.linked, self.candidate = 0.0, 0, 0, False
        self.depth = parent.depth + 1 if parent else 0
        self.inside = bool(parent and parent.inside) or (tag == "article" and not left_out)
        # open paragraph, list item, cell and row that a start tag in here may end
        open_ = parent if parent and tag not in _SCOPE else None
        rows = parent if parent and (tag not in _SCOPE or tag in _CELLS) else None
        self.p = self if tag == "p" else open_.p if open_ else None
        self.item = self if tag in _ITEMS else open_.item if open_ else None
        self.cell = self if tag in _CELLS else rows.cell if rows else None
        self.row = self if tag == "tr" else rows.row if rows else None


def _left_out(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Whether tag, role or style leave an element out."""
    if tag in _NEVER or (tag == "header" and not inside_article):
        return True
    if not attributes or tag in _SAFE:
        return False
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    return attributes.get("role", "").lower() in _ROLES


def _named(tag: str, attributes: dict[str, str], inside_article: bool) -> str | None:
    """What class and id mark an element as: ``comments``, ``other`` or nothing."""
    if not attributes or tag in _SAFE:
        return None
    found = None
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if w]
        bad = [w for w in words if w in _BAD or (w in _BAD_OUTSIDE and not inside_article)]
        if bad and all(w in bad or w in _BESIDE or w in _BAD_OUTSIDE for w in words):
            if any(w in _COMMENTS for w in bad):
                return "comments"
            found = "other"
    return found


def parse(page: str) -> Node:
    """Tree of a page; parts that are left out are marked."""
    root = Node("html", "", None, False)
    stack, last = [root], {"html": root}  # open elements, and of each tag the one opened last
    at, n = 0, len(page)
    find = _TOKEN.search

    def end(node: Node | None) -> None:
        if node is not None:
            del stack[node.depth :]

    while at < n:
        m = find(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].items.append(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        before = last.get(tag)
        while before is not None and (before.depth >= len(stack) or stack[before.depth] is not before):
            before = before.before
        last[tag] = before
        if m[1]:
            if before is not None and before is not root:
                end(before)
            continue
        if tag in ("html", "body"):
            continue
        if tag in _BLOCK:
            end(stack[-1].p)
        node = stack[-1]
        if tag in _ITEMS and node.item is not None and node.item.tag in _ITEMS[tag]:
            end(node.item)
        elif tag in _CELLS:
            end(node.cell)
        elif tag == "tr":
            end(node.row or node.cell)
        raw, node = m[3], stack[-1]
        attributes = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}
        if tag in _RAW:
            stop = _RAW[tag].search(page, at)
            at = stop.end() if stop else n
            continue
        if tag == "svg" and m[0].endswith("/>"):
            continue  # foreign elements can close themselves
        if tag in _VOID:
            if tag in ("br", "hr", "wbr"):
                node.items.append(Node(tag, "", node, False))
            continue
        words = f"{attributes.get('class', '')} {attributes.get('id', '')} {attributes.get('itemprop', '')} {attributes.get('role', '')}"
        if (got := last.get(tag)) is not None and (got.depth >= len(stack) or stack[got.depth] is not got):
            got = got.before  # a start tag may have ended the one before it
        marked = None if (out := _left_out(tag, attributes, node.inside)) else _named(tag, attributes, node.inside)
        child = Node(tag, words, node, out or marked is not None, got)
        child.named = marked
        node.items.append(child)
        stack.append(child)
        last[tag] = child
    return root


def _walk(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """Nodes on entry (True) and exit (False), and texts, in page order, without parts left out."""
    stack: list = [(root, True)]
    while stack:
        item, enter = stack.pop()
        yield item, enter
        if enter and isinstance(item, Node) and not item.left_out:
            stack.append((item, False))
            for x in reversed(item.items):
                if not (isinstance(x, Node) and x.left_out):
                    stack.append((x, True))


def _unmark(root: Node) -> None:
    """Takes back marks by name that would leave out every article or main element, or all text."""
    articles, texts, nodes = [], False, [(root, False)]
    marked: list[Node] = []
    while nodes:
        node, hidden = nodes.pop()
        for x in node.items:
            if isinstance(x, str):
                texts = texts or not (hidden or x.isspace())
                continue
            if x.left_out and x.named is None:
                continue
            if x.named:
                marked.append(x)
            if x.tag in ("article", "main"):
                articles.append((x, hidden or x.left_out))
            nodes.append((x, hidden or x.left_out))
    if articles and all(out for _, out in articles):
        for x, _ in articles:
            above, chain = x, []
            while above is not None:
                chain.append(above)
                above = above.parent
            if not any(y.named == "comments" for y in chain):
                for y in chain:
                    y.left_out = False if y.named else y.left_out
    elif not texts:
        for x in marked:
            x.left_out = x.named == "comments"


def _text(raw: str) -> str:
    return html.unescape(raw) if "&" in raw else raw


def blocks(root: Node) -> Iterator[tuple[str, Node]]:
    """Blocks of text with the element that each is in, whose links are counted on the way."""
    parts: list[str] = []
    within = [root]
    links = 0
    for item, enter in _walk(root):
        if isinstance(item, str):
            text = _text(item)
            parts.append(text)
            if links:
                within[-1].linked += len(" ".join(text.split()))
            continue
        if item.tag in _BLOCK or item is root:
            if (whole := " ".join("".join(parts).split())):
                yield whole, within[-1]
            parts = []
            if item.tag != "hr":
                if enter and item is not root:
                    within.append(item)
                elif not enter and item is not root:
                    within.pop()
        elif item.tag in ("br", "td", "th"):
            parts.append(" ")
        elif item.tag == "a":
            links += 1 if enter else -1


#: Blocks that hold text but no other blocks of the article.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li pre tr dd dt".split())


def _score(root: Node) -> list[tuple[Node, float]]:
    """Containers that paragraphs gave points to, with their discounted score."""
    for text, node in blocks(root):
        node.chars += len(text)
        node.score += 1.0 + text.count(",") + text.count("，") + min(len(text) / 100.0, 3.0)
    out = []
    for node, enter in _walk(root):
        if enter or isinstance(node, str) or not (node.chars or node.score):
            continue
        holds = node.tag in _BLOCK and node.tag not in _TEXTUAL
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.linked += node.linked
            up.score += node.score / 2 if holds else node.score
        if holds:
            weight = {"article": 30, "main": 20, "section": 3, "div": 5, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "address": -3}.get(node.tag, 0)
            weight += 25 if _GOOD.search(node.words) else 0
            density = min(1.0, node.linked / node.chars) if node.chars else 0.0
            out.append((node, (node.score + weight) * (1.0 - density)))
    return out


def _dense(node: Node) -> bool:
    """A list or box that is mostly links."""
    return node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.chars > 0 and node.linked > 0.5 * node.chars


def extract(page: str | None) -> str:
    """Main text of a page: blocks joined by an empty line."""
    if not page:
        return ""
    root = parse(page)
    _unmark(root)
    scored = _score(root)
    if not scored:
        return ""
    best, top = max(scored, key=lambda x: x[1])
    scores = {id(n): s for n, s in scored}
    kept, up = [best], best
    while up is not None and up.tag != "article":
        up = up.parent
    while up is not None and up.parent is not None and up.parent.inside:
        up = up.parent
    if up is not None:
        top = scores.get(id(up), 0.0)
        kept = [x for x in up.parent.items if x is up or (isinstance(x, Node) and x.tag == "article" and not x.left_out and scores.get(id(x), 0.0) >= 0.2 * top)]
    elif best.parent is not None:
        kept = []
        for x in best.parent.items:
            if not isinstance(x, Node) or x.left_out:
                continue
            likeness = scores.get(id(x), 0.0) + (0.2 * top if x.words and x.words == best.words else 0.0)
            plain = x.tag in ("p", "h1", "h2", "blockquote", "pre") and x.linked <= 0.25 * x.chars
            if x is best or plain or likeness >= max(10.0, 0.2 * top):
                kept.append(x)
    out: list[str] = []
    for node in kept:
        if up is None:
            for item, enter in list(_walk(node)):
                if enter and isinstance(item, Node) and item is not node and not item.inside and _dense(item):
                    item.left_out = True
        out += [text for text, _ in blocks(node)]
    return "\n\n".join(out)


def extract_column(page: Column) -> Column:
    """Main text of an HTML column."""

    @F.arrow_udf(T.StringType())
    def main_text(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p) for at in range(0, len(pages), ROWS) for p in pages.slice(at, ROWS).to_pylist()], pa.string())

    return main_text(page)


def report(pages: DataFrame) -> DataFrame:
    """Per page: its main text and its length in code points."""
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", extract_column(F.col("html")).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
