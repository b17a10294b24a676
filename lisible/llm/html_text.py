"""Main text of web pages by tag-path ratios.

Every root-to-leaf tag path of a page (tags with their classes) gathers the length of its text outside links and its
punctuation. Both, for each node of the path, are smoothed over the paths of the same parent in page order and fused
into one score; paths over a threshold hold content. A node weighs what the scores of its content add up to, and the
article is where the way down from the root stops finding one child that has most of the weight. What lies in it is
kept block by block, short blocks too.

Markup is a prior: scores count less in parts that declare themselves to be menus, headers, footers, sidebars, notices
or adverts and more in article elements, and inside the article they go if their ratio is below that of the rest. Only what no ratio can tell
goes by markup alone: what is never shown, forms, and reader comments.

Time and memory are linear in the page: paths are numbers, open elements are found by their tag, and all sums go up
and all decisions down the tree once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_fields

#: Start tags, end tags, comments, declarations. A quoted value may hold ">"; an unclosed quote falls back to the next ">".
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：«»\"“”()]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr nobr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p ul ol dl table blockquote pre li figure".split())
#: Elements that are never shown as text of a page.
UNSHOWN = frozenset("head script style noscript template svg math iframe object embed canvas audio video button select datalist dialog menu map title textarea".split())
#: Elements, roles, and words of class names and ids that declare a part to be something else than an article.
DECLARING = frozenset("nav footer aside header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tooltip".split())
WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored sponsors promo promos promotion promoted
    nav navbar navigation navi menu menus breadcrumb breadcrumbs crumbs topbar masthead header footer sidebar sidenav aside rail
    cookie cookies consent gdpr notice notices alert alerts popup modal overlay
    newsletter subscribe subscription signup signin login register paywall share sharing social sharebar follow related recommended recommendations outbrain taboola
    pagination pager toolbar widget widgets search searchbox form copyright legal disclaimer skip hidden""".split()
)
REMARKS = frozenset("comment comments commentlist disqus respond replies discussion reviews".split())
#: An open element on the right is closed by a start tag on the left; what the search for it passes besides.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
PASSED = frozenset(("p", "div"))
#: Smoothing of neighbouring paths; threshold in standard deviations; what the markup makes of a score, for parts declared
#: to be something else and for article elements; share of the weight that a child needs to be entered.
SMOOTH, LAMBDA, PRIOR, BOOST, DESCEND = (0.25, 0.5, 0.25), 0.5, 0.2, 100.0, 0.75


class Node:
    __slots__ = ("tag", "up", "path", "hard", "declared", "remark", "article", "length", "weight", "heads", "holds", "inside", "part", "prior")

    def __init__(self, tag: str, up: Node | None, path: int):
        self.tag, self.up, self.path = tag, up, path
        self.hard = self.declared = self.remark = self.article = self.heads = self.holds = self.inside = False
        self.length, self.weight = 0, 0.0
        self.part: Node | None = None
        self.prior = 1.0


class Page:
    """Nodes in page order, so that a parent comes before its children; blocks; paths as (parent path, label)."""

    def __init__(self) -> None:
        self.nodes = [Node("", None, 0)]
        self.blocks: list[tuple[Node, str, int]] = []  # element, text with single spaces, characters in links
        self.paths: dict[tuple[int, str], int] = {}

    def node(self, tag: str, up: Node, label: str) -> Node:
        node = Node(tag, up, self.paths.setdefault((up.path, label), len(self.paths) + 1))
        self.nodes.append(node)
        return node


def _declare(node: Node, attributes: str) -> None:
    """What the markup says of an element."""
    tag, found = node.tag, {}
    for m in ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    words = {w.lower() for w in WORD.findall(found.get("class", "") + " " + found.get("id", ""))}
    unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    node.hard = tag in UNSHOWN or unseen and tag not in ("main", "body", "html") or "hidden" in found
    node.remark = bool(words & REMARKS) and tag not in ("main", "body", "html")
    node.article = tag in ("article", "main") and not node.remark
    if not node.article and tag not in ("body", "html"):
        node.declared = tag in DECLARING or found.get("role", "").lower() in ROLES or bool(words & WORDS)


def _label(tag: str, attributes: str) -> str:
    m = re.search(r"""(?i)(?<![^\s"'])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", attributes) if attributes else None
    names = (m[1] or m[2] or m[3] or "").split()[:3] if m else ()
    return ".".join((tag, *names))


def parse(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, Node]] = [("", page.nodes[0])]
    open_at: dict[str, list[int]] = {}  # places in the stack, by tag
    block_at = [0]  # places of elements that are no inline ones
    buffer: list[str] = []
    links = in_link = 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                page.blocks.append((stack[-1][1], text, links))
            buffer.clear()
        links = 0

    def text(data: str) -> None:
        nonlocal links
        if data:
            data = unescape(data) if "&" in data else data
            buffer.append(data)
            if in_link:
                links += len(data)

    def push(tag: str, node: Node) -> None:
        nonlocal in_link
        in_link += tag == "a"
        open_at.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            block_at.append(len(stack))
        stack.append((tag, node))

    def close(at: int) -> None:
        """Closes the elements from stack[at] on."""
        nonlocal in_link
        if block_at[-1] >= at or stack[at][1] is not stack[at - 1][1]:
            flush()
        while len(stack) > at:
            tag, _ = stack.pop()
            open_at[tag].pop()
            in_link -= tag == "a"
        while block_at[-1] >= at:
            block_at.pop()

    pos, n = 0, len(html)
    while pos < n:
        m = TOKEN.search(html, pos)
        if not m:
            text(html[pos:])
            break
        text(html[pos : m.start()])
        pos = m.end()
        if m[1]:
            tag = m[1].lower()
            where = open_at.get(tag)
            if where and (tag not in INLINE or where[-1] > block_at[-1]):
                close(where[-1])
            continue
        tag, attributes = (m[2] or m[4] or "").lower(), m[3] or m[5] or ""
        if not tag:
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}(?![a-zA-Z0-9])[^>]*>?", re.I).search(html, pos)
            pos = end.end() if end else n
            continue
        if tag not in INLINE:  # a block closes an open paragraph, an item its forerunner
            closes = CLOSES.get(tag, ())
            if closes:
                for at in reversed(block_at):
                    if stack[at][0] in closes:
                        close(at)
                        break
                    if stack[at][0] not in PASSED:
                        break
            if stack[block_at[-1]][0] == "p":
                close(block_at[-1])
        if attributes.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        shown = attributes and not attributes.isspace()
        node = Node(tag, stack[-1][1], 0)
        if shown:
            _declare(node, attributes)
        elif tag not in INLINE:
            node.hard, node.declared, node.article = tag in UNSHOWN, tag in DECLARING, tag in ("article", "main")
        if tag in INLINE and not (node.hard or node.declared or node.remark):
            push(tag, stack[-1][1])
            continue
        flush()
        own = page.node(tag, stack[-1][1], _label(tag, attributes) if shown else tag)
        own.hard, own.declared, own.remark, own.article = node.hard, node.declared, node.remark, node.article
        push(tag, own)
    flush()
    return page


def _scores(blocks: list[tuple[Node, str, int]], parents: dict[int, int]) -> dict[int, float]:
    """Smoothed and fused ratio of every path: text outside links and punctuation, for each node of the path.

    Neighbours are the paths of the same parent, in page order; declared parts and others are no neighbours.
    """
    sums: dict[int, list[int]] = {}
    families: dict[tuple[int, bool], list[int]] = {}
    for node, text, links in blocks:
        got = sums.get(node.path)
        if got is None:
            got = sums[node.path] = [0, 0, 0]
            families.setdefault((parents.get(node.path, -1), node.part is None), []).append(node.path)
        got[0] += max(0, len(text) - links)
        got[1] += len(PUNCTUATION.findall(text))
        got[2] += 1
    out = {}
    for paths in families.values():
        ratios = [(sums[p][0] / sums[p][2], sums[p][1] / sums[p][2]) for p in paths]
        for i, p in enumerate(paths):
            near = [(w, ratios[i + d]) for d, w in zip((-1, 0, 1), SMOOTH, strict=True) if 0 <= i + d < len(paths)]
            whole = sum(w for w, _ in near)
            length, marks = (sum(w * r[k] for w, r in near) / whole for k in (0, 1))
            out[p] = length * (1 + marks) if sums[p][0] else 0.0
    return out


def _settle(page: Page) -> list[tuple[Node, str, int]]:
    """Wrappers lose their declarations; the blocks that are not out by markup alone."""
    for node, text, _ in page.blocks:
        node.length += len(text)
        node.heads |= node.tag in ("h1", "h2")
    for node in reversed(page.nodes[1:]):
        up = node.up
        up.length += node.length
        up.heads |= node.heads
        up.holds |= node.holds or node.article
    whole = page.nodes[0].length - sum(x.length for x in page.nodes if x.declared and x.tag in DECLARING and not x.holds)
    for node in page.nodes[1:]:
        if node.remark:
            node.hard |= not node.holds
        elif node.tag == "form":
            node.hard |= not (node.holds or node.heads)
        elif node.declared:  # one that holds the article, or most of the text with a heading, is a wrapper
            node.declared = not (node.holds if node.tag in DECLARING else node.holds or node.heads and node.length > 0.5 * whole)
        node.hard |= node.up.hard
        node.part = node.up.part or (node if node.declared else None)
        node.prior = PRIOR if node.part else BOOST if node.article else node.up.prior
    return [b for b in page.blocks if not b[0].hard]


def extract(html: str) -> str:
    page = parse(html)
    blocks = _settle(page)
    if all(node.part for node, _, _ in blocks):  # nothing but menus and the like, or nothing
        return ""
    parents = {own: up for (up, _), own in page.paths.items()}
    scores = _scores(blocks, parents)
    weights: dict[int, list[float]] = {}  # of a path: score and prior together, block by block
    for node, _, _ in blocks:
        weights.setdefault(node.path, []).append(scores[node.path] * node.prior)
    weighed = {p: sum(own) / len(own) for p, own in weights.items()}
    mean = sum(weighed.values()) / len(weighed)
    limit = LAMBDA * (sum((x - mean) ** 2 for x in weighed.values()) / len(weighed)) ** 0.5
    good_paths = {p for p, x in weighed.items() if x >= limit and x > 0}
    content = [b for b in blocks if b[0].path in good_paths]
    for node, _, _ in content:
        node.weight += scores[node.path] * node.prior
    for node in reversed(page.nodes[1:]):
        node.up.weight += node.weight
    region = _region(page)
    region.inside = True
    for node in page.nodes[1:]:
        node.inside |= node.up.inside
    near = [b for b in blocks if b[0].inside]

    # declared parts of the article: those whose ratio, less by the prior, is below that of the rest
    parts: dict[int, list[tuple[float, int]]] = {}
    for node, text, _ in near:
        parts.setdefault(id(node.part) if node.part and node.part.up.inside else 0, []).append((scores[node.path], len(text)))
    ratio = {p: sum(x * n for x, n in own) / sum(n for _, n in own) for p, own in parts.items()}
    gone = {p for p, x in ratio.items() if p and x * PRIOR < ratio.get(0, 0.0)}
    titles = lambda b: b[0].part.tag == "header" and _in_heading(b[0]) and (region.article or b[0].part.up.article)
    kept = [b for b in near if not (b[0].part and id(b[0].part) in gone) or titles(b)]
    if region.article or not content:
        return "\n".join(text for _, text, _ in kept)

    # no element says that it is the article: what stands among content, or beside it, unless it is all links
    good = [i for i, b in enumerate(kept) if b[0].path in good_paths]
    first, last = (good[0], good[-1]) if good else (0, -1)
    beside = {parents.get(kept[i][0].path) for i in good} | {id(kept[i][0].up) for i in good}
    chosen = [
        text
        for i, (node, text, links) in enumerate(kept)
        if node.path in good_paths or (first < i < last or parents.get(node.path) in beside or id(node.up) in beside) and links < 0.8 * len(text)
    ]
    return "\n".join(chosen)


def _in_heading(node: Node) -> bool:
    """At or right under a heading, without leaving the declared part."""
    part = node.part
    while node is not part:
        if node.tag in HEADINGS:
            return True
        node = node.up
    return False


def _region(page: Page) -> Node:
    """Down from the root, into the article or child that has most of the weight."""
    down: dict[int, Node] = {}
    article_below: set[int] = set()
    for node in reversed(page.nodes[1:]):
        if node.hard or not node.weight:
            continue
        up = id(node.up)
        if up not in down or node.weight >= down[up].weight:
            down[up] = node
        if node.article or id(node) in article_below:
            article_below.add(up)
    node = page.nodes[0]
    while node.tag != "article":
        best = down.get(id(node))
        if best is None or best.tag in LEAVES or best.weight < DESCEND * node.weight or node.article and id(best) not in article_below and not best.article:
            break
        node = best
    return node


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every row; no shuffle, one Arrow batch at a time.

    Null, empty and textless pages give an empty text and 0; null ids and urls stay null; repeated rows give repeated
    rows; an empty table gives an empty one; further columns are not read. The whole page counts, however long.
    """
    schema = with_fields(df.select(id_col, url_col), ("text", T.StringType()), ("n_chars", T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [extract((x or b"").decode("utf-8", "replace")) for x in part.column(2).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], schema.names)

    return df.select(id_col, url_col, html_col).mapInArrow(run, schema)
