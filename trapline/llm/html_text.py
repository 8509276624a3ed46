"""Main text of web pages by composite text density.

The density of a node is its characters per tag, lowered by the share of characters and tags in links. The node whose children
have the largest sum of densities holds the article; the smallest density on the path from it to the body is the threshold
that text elsewhere must reach to belong to it. Nodes that say themselves that they are no article are taken out first, unless
they hold the page's only article, main element or title, or most of its text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RIGHTS = re.compile(r"^(?:©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)  # a line of a page's foot
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
# Elements that hold no article text.
OUTSIDE = frozenset(
    "head nav footer aside button select option dialog menu object svg canvas audio video map annotation annotation-xml".split()
) | RAW
# Words in a class, id or role that mark such parts.
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar nav navbar "
    "navigation menu breadcrumb breadcrumbs footer comment comments disqus replies reply respond cookie cookies consent gdpr "
    "notice notices alert newsletter subscribe subscription signup login popup modal overlay social share sharing related "
    "recommended recommendations widget pagination pager toolbar search contentinfo complementary".split()
)
# After one of these, a name tells of the layout around the text ("has-sidebar").
LAYOUT_NAMES = frozenset("has no not with without".split())
_COMMENTS = re.compile(r"[a-z]*comments|comment(?:list|area|box|form|section|thread|body|wrap|wrapper|container)?")
# Inside an article these carry an id as an anchor, not as a role.
ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd a span figure figcaption blockquote pre table tr td th".split())
RIGHTS_CHARS = 300  # a notice of rights is no longer than this
# Only outside an article do these mark such parts.
TOP_NAMES = frozenset(["header", "masthead", "topbar"])
_CLOSED_BY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}


class Node:
    """An element: its tag, its parts (elements and texts) and the counts of its subtree."""

    __slots__ = ("tag", "parts", "parent", "outside", "named", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, outside: bool = False) -> None:
        self.tag, self.parent, self.outside, self.parts = tag, parent, outside, []
        self.named = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _attributes(rest: str) -> dict[str, str]:
    """Attributes of a start tag by lower-case name; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value)
    return found


def _words(value: str) -> set[str]:
    found: set[str] = set()
    for token in value.split():
        for word in map(str.lower, _WORD.findall(token)):
            if word in LAYOUT_NAMES:
                break
            found.add(word)
    return found


def _names(tag: str, attributes: dict[str, str], inside: bool) -> set[str]:
    """Words of class, role and id. Inside an article an id of several words, or of a heading or paragraph, is an anchor."""
    found = _words(attributes.get("class", "")) | _words(attributes.get("role", ""))
    own = attributes.get("id", "")
    if own and not (inside and (tag in ANCHORED or len(_WORD.findall(own)) > 1)):
        found |= _words(own)
    return found


def _roles(tag: str, rest: str, node: Node) -> tuple[bool, bool]:
    """Whether an element is outside the article for certain, and whether its names say that it is."""
    if tag in OUTSIDE:
        return True, False
    attributes = _attributes(rest) if rest and not rest.isspace() else {}
    named = any(a in attributes for a in ("class", "role", "id"))
    if named or tag == "header":
        while node is not None and node.tag not in ("article", "main"):
            node = node.parent
    names = _names(tag, attributes, node is not None) if named else frozenset()
    comment = any(map(_COMMENTS.fullmatch, names))
    unseen = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or _UNSEEN.search(attributes.get("style", ""))
    if unseen:
        return tag not in ("html", "body", "article", "main") or comment, False
    if comment or names & OUTSIDE_NAMES:
        return comment, not comment and tag not in ("html", "body", "article", "main")
    if tag == "header" or names & TOP_NAMES:
        return node is None and tag == "header", node is None and tag != "header"
    return False, tag == "form"  # controls are left out by themselves


def _settle_names(root: Node) -> None:
    """Take out the named nodes, but for those that hold the article: its element, its title or most of the text outside links.

    The text decides only where no article or main element is elsewhere.
    """
    order, pending = [], [(root, False, False)]
    marks = {"article": 2, "main": 2, "h1": 1}
    elsewhere = 0  # best mark that no named node holds
    while pending:
        node, inside, link = pending.pop()
        if node.outside:
            continue
        inside, link = inside or node.named, link or node.tag == "a"
        if not inside:
            elsewhere = max(elsewhere, marks.get(node.tag, 0))
        order.append((node, link))
        pending.extend((p, inside, link) for p in node.parts if not isinstance(p, str))
    texts, best = {}, {}
    for node, link in reversed(order):
        inner = [p for p in node.parts if not isinstance(p, str) and not p.outside]
        own = 0 if link else sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        texts[node] = own + sum(texts[p] for p in inner)
        best[node] = max(marks.get(node.tag, 0), *(best[p] for p in inner), 0)
    for node, _ in order:
        most = 2 * texts[node] > texts[root] and (best[node] == 2 or best[root] < 2)
        if node.named and best[node] <= elsewhere and not most:
            node.outside = True


def _open_within(node: Node, tags: tuple[str, ...], stops: frozenset | tuple) -> Node | None:
    while node.parent is not None and node.tag not in tags:
        if node.tag in stops:
            return None
        node = node.parent
    return node if node.tag in tags else None


_P_STOPS = BLOCK - {"p"} | {"td", "th"}
_INLINE_STOPS = _P_STOPS | {"p"}


def tree(html: str) -> Node:
    """Element tree of a page. Missing end tags close as browsers close them; what is cut off at the end is dropped."""
    node = root = Node("html", None)
    opened: Counter[str] = Counter()
    at, last, named = 0, html.rfind(">"), False

    def close(down_to: Node) -> Node:
        inner = node
        while inner is not down_to:
            opened[inner.tag] -= 1
            inner = inner.parent
        return inner

    while (start := html.find("<", at)) >= 0:
        cut = start > last and html[start + 1 : start + 2].isalpha()
        token = None if cut else _TOKEN.match(html, start)
        if token is None and not cut:
            node.parts.append(html[at : start + 1])
            at = start + 1
            continue
        if start > at:
            node.parts.append(html[at:start])
        at = len(html) if cut else token.end()
        if cut or not (tag := (token["tag"] or token["tag2"] or "").lower()):
            continue
        rest = token["rest"] or token["rest2"] or ""
        if token["end"] or token["end2"]:
            found = opened[tag] and _open_within(node, (tag,), () if tag in BLOCK or tag in _CLOSED_BY else _INLINE_STOPS)
            node = close(found.parent) if found else node
            continue
        if tag in ("html", "body") and node.parent is None:
            root.outside |= _roles("html", rest, root)[0] or "hidden" in _attributes(rest)
            continue
        if tag in BLOCK and opened["p"] and (p := _open_within(node, ("p",), _P_STOPS)) is not None:
            node = close(p.parent)
        same = _SAME.get(tag, (tag,))
        if tag in _CLOSED_BY and any(opened[t] for t in same) and (old := _open_within(node, same, _CLOSED_BY[tag])):
            node = close(old.parent)
        child = Node(tag, node, tag == "hr")
        if tag not in VOID:
            child.outside, child.named = _roles(tag, rest, node)
            named |= child.named
        node.parts.append(child)
        if tag in RAW:
            stop = re.compile(f"</{tag}", re.I).search(html, at)
            at = stop.start() if stop else len(html)
        if tag not in VOID:
            opened[tag] += 1
            node = child
    if at < len(html):
        node.parts.append(html[at:])
    if named:
        _settle_names(root)
    return root


def _measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of every node that may be in the article; children come before parents."""
    order, pending = [], [root]
    while pending:
        node = pending.pop()
        node.parts = [p for p in node.parts if isinstance(p, str) or not p.outside or p.tag == "hr"]
        order.append(node)
        pending.extend(p for p in node.parts if not isinstance(p, str))
    order.reverse()
    for node in order:
        for part in node.parts:
            if isinstance(part, str):
                size = len(" ".join(unescape(part).split()))
                node.chars += size
                node.total += size
                continue
            node.chars += part.chars
            node.tags += part.tags + 1
            node.link_chars += part.link_chars
            node.link_tags += part.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        chars, tags, links = node.chars, max(node.tags, 1), max(node.link_chars, 1)
        if chars:
            base = math.log(chars / max(chars - node.link_chars, 1) * node.link_chars + share * chars + math.e)
            value = max(chars / links * tags / max(node.link_tags, 1), 1.0)
            node.density = chars / tags * math.log(value) / max(math.log(base), 1e-9) if base > 1 + 1e-9 else chars / tags * math.log(value)
        if node.parent is not None:
            node.parent.total += node.density
    return order


def _text(node: Node) -> str:
    """Text of a subtree on one line."""
    found, pending = [], [node]
    while pending:
        part = pending.pop()
        if isinstance(part, str):
            found.append(unescape(part))
        else:
            pending.extend(reversed(part.parts))
    return " ".join(" ".join(found).split())


def _content(root: Node) -> list[Node]:
    """Nodes that make up the article, in page order, none inside another."""
    order = _measure(root)
    best = max(reversed(order), key=lambda n: n.total)
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    threshold = min(n.density for n in path)
    holder = next((n for n in path if n.tag == "article"), None) or next((n for n in path if n.tag == "main"), best)
    marked, pending = [], [root]
    while pending:
        node = pending.pop()
        heading = node.tag == "h1" or node.density >= threshold > 0 and node not in path and node.tag in BLOCK
        if heading and node is not holder and node.chars <= RIGHTS_CHARS and _RIGHTS.search(_text(node)):
            continue
        if node is holder or heading and node.chars:
            marked.append(node)
            continue
        pending.extend(p for p in reversed(node.parts) if not isinstance(p, str))
    return marked


def main_text(html: str | None) -> str:
    """Blocks of the article, white space as single spaces, joined by blank lines; "" if there are none."""
    if not html:
        return ""
    root = tree(html)
    if root.outside:
        return ""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    for node in _content(root):
        pending: list = [node]
        while pending:
            part = pending.pop()
            if part is None:
                flush()
            elif isinstance(part, str):
                run.append(unescape(part))
            elif part.tag in BLOCK:
                flush()
                pending.append(None)
                pending.extend(reversed(part.parts))
            else:
                if part.tag in ("br", "td", "th", "wbr"):
                    run.append(" " if part.tag != "wbr" else "")
                pending.extend(reversed(part.parts))
        flush()
    return "\n\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points) of every row of ``pages(page_id, url, html)``.

    A missing html is an empty page; a page without article has the text "". Rows are independent of each other, repeated rows
    stay. Other columns are left out.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")
