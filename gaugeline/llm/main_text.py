"""Main text of HTML pages by composite text density (operator 3).

A page is parsed to a tree. Elements that are furniture by their tag, role, class or id (menus,
page headers and footers, side bars, notices, adverts, forms, comments, scripts, styles) are left
out; a name in a class or id, or a form, is no reason to leave out what holds most of the page's text.
A class or id that says furniture only in part ("social-history") is left out if nothing in it reaches half
the threshold, too.
Every other node gets its composite text density: characters per tag, adjusted by the share
of characters and tags that are links. A node's density sum is the sum over its children. The
node of the largest sum leads to the article; the smallest density on its path to the body is
the threshold for other parts of the page. An article or main element is a hint: if it holds that
node or its sum reaches the largest, it is the main text, with others above the threshold and
what else is as dense as the article; if not, parts are chosen by density alone.

Blocks are joined by one line feed in page order; white space inside a block becomes one
space. Null pages are empty; a page without any text gives an empty text. Nothing is cut off, so
memory follows the longest page. Repeated rows give a row each; an empty table no rows.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import only

SCHEMA = "page_id long, url string, text string, n_chars long"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
_MATH = frozenset("annotation annotation-xml math mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
_INLINE = _MATH | frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_FURNITURE = frozenset(
    "script style noscript template iframe object embed applet svg annotation annotation-xml canvas audio video map head title form input select textarea button fieldset "
    "nav aside footer header menu dialog noembed noframes xmp".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that name furniture.
_NAMES = frozenset(
    "nav navbar navigation navi menu menus breadcrumb breadcrumbs header masthead topbar banner footer bottombar sidebar sidebars aside rail "
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted teaser "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register "
    "comment comments commentlist commentary disqus replies respond reactions share sharing sharebar social related recommended recommendations "
    "pagination pager toolbar widget widgets copyright disclaimer skip form search".split()
)
#: Share of the threshold that something in a part must reach if its name says furniture in part.
PART_SHARE = 0.5
#: Words that say nothing about a part, so that a name of these and the ones above is furniture.
_NEUTRAL = frozenset(
    "site page post posts article articles entry blog body main content global primary secondary top bottom left right center sub js wp author "
    "banner bar block box button buttons card column container group icon icons inner item items link links list more news outer panel row section "
    "slot space story stories text title unit view wrap wrapper area".split()
)
#: Words in a class of a paragraph of an article's header that is about the article.
_BYLINE = frozenset("byline author date time meta published posted updated credit credits tags category".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of the named kinds, up to a container.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "a": ({"a"}, {"p", "div", "li", "td", "article", "body"}),
    "body": ({"head"}, {"html"}),
}
_TOKEN = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|/?[a-zA-Z][^<>]*(?:>|\Z))""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_CLOSE = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in _RAW}


class Node:
    __slots__ = ("tag", "names", "named", "part_named", "cut", "role", "hidden", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "best")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.names: list[str] = []
        self.role, self.hidden = "", False
        #: Whether a class or id says furniture and nothing else, or in part; whether it is cut for that and its density.
        self.named = self.part_named = self.cut = False
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), html.unescape(value.strip("\"'"))
                if name in ("class", "id"):
                    for token in value.split():
                        words = [w.lower() for w in _WORD.findall(token)]
                        self.names += words
                        if not _NAMES.isdisjoint(words):
                            whole = all(w in _NAMES or w in _NEUTRAL or len(w) == 1 or w.isdigit() for w in words)
                            self.named, self.part_named = self.named or whole, self.part_named or not whole
                elif name == "role":
                    self.role = value.strip().lower()
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                    self.hidden = True
                elif name == "style" and "display:none" in value.replace(" ", "").lower():
                    self.hidden = True
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.best: Node = self


def parse(page: str) -> Node:
    """The tree of a page; elements left open end where their parent or a sibling of their kind begins or ends."""
    root = Node("#root", None)
    stack, at = [root], 0

    def text(part: str) -> None:
        if part:
            stack[-1].children.append(html.unescape(part))

    def close(index: int) -> None:
        del stack[index:]

    while True:
        match = _TOKEN.search(page, at)
        if match is None:
            text(page[at:])
            return root
        text(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break
            continue
        if tag not in _INLINE and tag not in _VOID:
            # A block ends an open paragraph.
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in _INLINE:
                    break
        kinds, stops = _ENDS.get(tag, ((), ()))
        if kinds:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in stops:
                    break
                if stack[k].tag in kinds:
                    close(k)
                    break
        node = Node(tag, stack[-1], match[3])
        stack[-1].children.append(node)
        if tag in _RAW:
            end = _CLOSE[tag].search(page, at)
            if tag == "textarea" or tag == "title":
                node.children.append(html.unescape(page[at : end.start() if end else len(page)]))
            at = end.end() if end else len(page)
        elif tag not in _VOID and not match[3].rstrip().endswith("/"):
            stack.append(node)


def in_order(root: Node) -> list[Node]:
    """All nodes, parents before children, in page order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.role in ("main", "article")


def is_furniture(node: Node) -> bool:
    if node.tag == "header":
        return True
    return node.tag in _FURNITURE or node.hidden or node.role in _ROLES or node.named


def named_only(node: Node) -> bool:
    """Furniture by no more than a class, an id, or being a form."""
    return node.tag not in _FURNITURE - {"form"} and not node.hidden and node.role not in _ROLES and not is_comment(node)


def wrappers(nodes: list[Node]) -> set[int]:
    """Nodes (parents first) that hold more than half of the page's text outside links and other furniture.

    On a page with an article a longer advert is none: there they must hold two paragraphs at least.
    """
    own: dict[int, int] = {}
    paragraphs: dict[int, int] = {}
    for node in reversed(nodes):
        n = 0
        if node.tag not in ("a", "label") and (not is_furniture(node) or named_only(node)):
            n = sum(len("".join(c.split())) if isinstance(c, str) else own[id(c)] for c in node.children)
        own[id(node)] = n
        paragraphs[id(node)] = sum(paragraphs[id(c)] + (c.tag == "p") for c in node.children if isinstance(c, Node))
    whole = own[id(nodes[0])]
    least = 2 if any(is_article(n) and not is_comment(n) and own[id(n)] for n in nodes) else 0
    return {id(n) for n in nodes if 2 * own[id(n)] > whole and paragraphs[id(n)] >= least}


def header_text(header: Node) -> list[Node]:
    """Headings and paragraphs of an article's own header, without lines about the article."""
    found, stack = [], [header]
    while stack:
        node = stack.pop()
        if node.tag in _HEADINGS or node.tag == "p":
            if node.tag != "p" or _BYLINE.isdisjoint(node.names):
                found.append(node)
        else:
            stack += [c for c in reversed(node.children) if isinstance(c, Node) and not is_furniture(c)]
    return found


def prune(root: Node) -> None:
    """Take furniture out of the tree. Elements that hold the article, or most of the text, stay whatever their name; a form's controls go.

    Headings and paragraphs of an article's own header stay.
    """
    nodes = in_order(root)
    holders = set()
    for node in nodes:
        if is_article(node) and not is_comment(node):
            up = node
            while up is not None and id(up) not in holders:
                holders.add(id(up))
                up = up.parent
    most = wrappers(nodes)
    for node in nodes:
        kept = []
        for child in node.children:
            spared = not isinstance(child, str) and (
                (id(child) in holders and (child.tag not in _FURNITURE or child.tag == "form") and not is_comment(child)) or (id(child) in most and named_only(child))
            )
            if isinstance(child, str) or child.tag in ("html", "body") or not is_furniture(child) or spared:
                kept.append(child)
            elif child.tag == "header":
                up = node
                while up is not None and not is_article(up):
                    up = up.parent
                if up is not None:
                    kept += header_text(child)
        node.children = kept
        for child in kept:
            if isinstance(child, Node):
                child.parent = node


def is_comment(node: Node) -> bool:
    """An article element that is a reader's comment."""
    return any(n in ("comment", "comments", "reply", "replies") for n in node.names)


def measure(root: Node) -> list[Node]:
    """Densities and density sums of all nodes."""
    nodes = in_order(root)
    for node in reversed(nodes):
        for child in node.children:
            if isinstance(child, str):
                node.chars += len("".join(child.split()))
            else:
                node.chars += child.chars
                node.tags += child.tags + (child.tag not in _MATH)
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = root.link_chars / max(1, root.chars)
    for node in reversed(nodes):
        if node.chars:
            tags = max(1, node.tags)
            base = math.log(node.chars / max(1, node.chars - node.link_chars) * node.link_chars + share * node.chars + math.e)
            ratio = node.chars / max(1, node.link_chars) * tags / max(1, node.link_tags)
            node.density = max(0.0, node.chars / tags * math.log(ratio) / math.log(base)) if base > 1 else node.chars / tags * math.log(max(ratio, 1.0))
        node.total = sum(c.density for c in node.children if isinstance(c, Node))
        if not any(isinstance(c, Node) for c in node.children):
            node.total = node.density if node.tag not in _INLINE else 0.0
        # The node of the largest density sum in the subtree, the first of equals.
        node.best = node
        for child in node.children:
            if isinstance(child, Node) and child.best.total > node.best.total:
                node.best = child.best
    return nodes


def below(nodes: list[Node], tops: set[int]) -> set[int]:
    """Which of ``nodes`` (parents first) have one of ``tops`` above them."""
    found: set[int] = set()
    for node in nodes:
        if node.parent is not None and (id(node.parent) in tops or id(node.parent) in found):
            found.add(id(node))
    return found


def select(root: Node) -> list[Node]:
    """Roots of the main text, in page order."""
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    if not body.chars:
        body = root
    best = body.best
    path, up = [best], best
    while up is not body and up.parent is not None:
        up = up.parent
        path.append(up)
    threshold = min(n.density for n in path)
    up, above = best, set()
    while up is not None:
        above.add(id(up))
        up = up.parent
    inner = in_order(body)
    peaks: dict[int, float] = {}
    for node in reversed(inner):
        peaks[id(node)] = max([node.density, *(peaks[id(c)] for c in node.children if isinstance(c, Node))])
        node.cut = node.part_named and id(node) not in above and peaks[id(node)] < PART_SHARE * threshold
    articles = [n for n in inner if is_article(n) and n.chars]
    nested = below(inner, {id(n) for n in articles})
    outer = [n for n in articles if id(n) not in nested]
    chiefs = [n for n in outer if id(n) in above or n.best.total >= best.total or (len(outer) == 1 and n.chars - n.link_chars > (body.chars - body.link_chars) / 2)]
    if not chiefs:
        if best is body:
            return [body]
        # Without such a hint: from the body down, what is as dense as the path to the best node.
        return dense_parts(body, inner, {id(best)}, set(), threshold)
    kept = {id(n) for n in chiefs}
    marked = {id(n) for n in outer if id(n) in kept or n.density >= threshold}
    # Beside articles: what is as dense as the least dense chief one.
    holders, barred = set(), {id(n) for n in outer}
    for node in outer:
        up = node.parent
        while up is not None and id(up) not in holders:
            holders.add(id(up))
            up = up.parent
    return dense_parts(body, inner, marked, holders, max(threshold, min(n.density for n in chiefs)), barred)


def dense_parts(body: Node, inner: list[Node], marked: set[int], holders: set[int], threshold: float, barred: frozenset[int] | set[int] = frozenset()) -> list[Node]:
    """``marked`` nodes and what else is as dense as ``threshold``, in page order; ``holders`` are entered whatever their density, ``barred`` ones not."""
    marked, stack = set(marked), [body]
    while stack:
        node = stack.pop()
        if id(node) in barred:
            continue
        if id(node) in holders:
            stack += [c for c in node.children if isinstance(c, Node)]
            continue
        if node.density < threshold or not node.chars:
            continue
        if node.best is node:
            marked.add(id(node))
        else:
            stack += [c for c in node.children if isinstance(c, Node)]
    nested = below(inner, marked)
    return [n for n in inner if id(n) in marked and id(n) not in nested]


def blocks(root: Node) -> list[str]:
    """The texts between block boundaries of a subtree, white space as one space, empty ones left out."""
    found: list[str] = []
    parts: list[str] = []

    def end() -> None:
        text = " ".join("".join(parts).split())
        if text:
            found.append(text)
        parts.clear()

    # A node is met twice: before and after its children.
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        node, done = stack.pop()
        if isinstance(node, str):
            parts.append(node)
            continue
        if node.cut:
            continue
        if node.tag not in _INLINE:
            end()
        if done:
            continue
        if node.tag not in _INLINE:
            stack.append((node, True))
        stack += [(c, False) for c in reversed(node.children)]
    end()
    return found


def main_text(page: str) -> str:
    root = parse(page)
    prune(root)
    return "\n".join(text for node in select(root) for text in blocks(node))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its number of code points, one row per row of ``pages``."""

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = only(pages, "page_id", "url", "html")
    return rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)
