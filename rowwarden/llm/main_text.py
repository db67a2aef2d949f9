"""Main text of web pages by composite text density.

A page is read once into a tree.  Every node gets the characters per tag of its subtree, adjusted for links: text that
stands in links lowers it.  The densities of a node's child elements sum up to its density sum.  The subtree with the
largest sum is the article's core; the threshold is the least density on the path from it up to the body.  Where the page
marks articles, those that hold the text are taken whole.  Elsewhere the core is taken with what surrounds it below the body,
and so is every other block of the body that reaches the threshold, has the page's title, or is made of paragraphs and not
mostly of links.

Menus, headers, footers, sidebars, notices, adverts, forms and comments are left out by element, role and whole names of
class and id.  None of these is believed where it would leave out most of the page's text and no article stands elsewhere.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rowwarden.llm.batches import tidied

SCHEMA = "page_id long, url string, text string, n_chars long"

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes template noscript svg math".split())
SKIP = RAW | frozenset("head nav header footer aside form button select datalist dialog menu object canvas audio video label fieldset".split())
ALWAYS_SKIP = SKIP - {"form", "fieldset"}
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table caption thead tbody tfoot tr "
    "td th figure figcaption address hgroup details summary center hr search".split()) | SKIP
CLOSES_P = BLOCK - {"html", "body"}
#: An opening tag of the key ends an open element of the value.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "body": {"head"}}
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
SKIP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar aside comment comments "
    "disqus respond replies reply discussion related recommended share sharing social breadcrumb breadcrumbs pagination pager menu "
    "nav navbar navigation footer masthead topbar header widget widgets toolbar skip".split())
KEEP_TAGS = frozenset(("html", "body", "article", "main"))
#: Last parts of a name that say nothing: "ad-slot" names an advert, "comment-list" comments.
CONTAINER_WORDS = frozenset(
    "area bar block box btn button buttons card cards col column container content form group holder icons inner item items "
    "left link links list module outer pane panel posts right row section slot tab tabs thread toggle top unit wrap wrapper zone".split())
#: First parts that turn a name into a statement about the page, and those of an article's own header.
STATING_WORDS = frozenset("has no with without is not hide show hides shows".split())
OWN_WORDS = frozenset("article entry post story content".split())
PARAGRAPHS = frozenset("p blockquote pre dd h1".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "furniture", "skip", "chars", "tags", "link_chars", "link_tags", "density", "sum", "told")

    def __init__(self, tag: str, parent: Node | None, furniture: bool) -> None:
        self.tag, self.parent, self.furniture, self.skip, self.told = tag, parent, furniture, False, False
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def names_furniture(name: str) -> bool:
    """Whether one name of a class or id, taken whole, is that of something beside the article."""
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts or parts[0] in STATING_WORDS:
        return False
    while len(parts) > 1 and (parts[-1] in CONTAINER_WORDS or parts[-1].isdigit()):
        parts.pop()
    return parts[-1] in SKIP_WORDS and not (parts[-1] == "header" and parts[0] in OWN_WORDS)


def _is_furniture(tag: str, rest: str) -> bool:
    if tag in SKIP:
        return True
    if not rest or rest == "/":
        return False
    for name, *values in ATTRIBUTE.findall(rest):
        name, value = name.lower(), html.unescape(next((v for v in values if v), ""))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.strip().lower() in SKIP_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and tag not in KEEP_TAGS and any(map(names_furniture, value.split())):
            return True
    return False


def parse(page: str) -> Node:
    """The tree of a page; unclosed and crossing tags are mended, raw elements keep no content."""
    root = here = Node("html", None, False)
    at, end = 0, len(page)
    while at < end:
        match = TAG.search(page, at)
        if match is None:
            here.children.append(page[at:])
            break
        if match.start() > at:
            here.children.append(page[at:match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            node = here
            while node is not None and node.tag != tag:
                node = node.parent if node.tag not in ("body", "td", "th") or tag not in ("p", "li") else None
            if node is not None and node is not root:
                here = node.parent
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            node = here
            while node.tag not in BLOCK and node.parent is not None:
                node = node.parent
            if node.tag == "p":
                here = node.parent
        if tag in SIBLINGS:
            node = here
            while node.parent is not None and node.tag not in ("ul", "ol", "dl", "table", "body", "div", "article", "section", "select"):
                if node.tag in SIBLINGS[tag]:
                    here = node.parent
                node = node.parent
        child = Node(tag, here, _is_furniture(tag, match[3]))
        here.children.append(child)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if not match[3].endswith("/") or tag not in ("svg", "math"):
                at = close.end() if close else end
        elif tag not in VOID:
            here = child
    return root


def _in_order(root: Node) -> list[Node]:
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting += reversed([c for c in node.children if type(c) is Node])
    return order


def _letters(text: str) -> int:
    return len("".join(text.split()))


def leave_out(root: Node) -> list[Node]:
    """Marks what is left out, and returns the other nodes in page order.

    Raw elements, and those that are furniture by their kind, always go.  A form, or what a role, a style or a name makes
    furniture, stays if it holds over half of the page's text, paragraphs among it, and no article or main element stands
    outside of it: then it is round the page, not beside it.
    """
    order = _in_order(root)
    chars, marked, told = {}, {}, {}
    for node in reversed(order):
        inner = [c for c in node.children if type(c) is Node and c.tag not in RAW]
        chars[id(node)] = sum(chars[id(c)] for c in inner) + sum(_letters(c) for c in node.children if type(c) is str)
        marked[id(node)] = (node.tag in ("article", "main")) + sum(marked[id(c)] for c in inner)
        told[id(node)] = node.tag in PARAGRAPHS or any(told[id(c)] for c in inner)
    kept = []
    for node in order:
        whole = 2 * chars[id(node)] > chars[id(root)] and marked[id(node)] == marked[id(root)] and told[id(node)] and node.tag not in ALWAYS_SKIP
        node.skip = node.parent is not None and (node.parent.skip or node.furniture and not whole)
        if not node.skip:
            kept.append(node)
    return kept


def measure(root: Node) -> list[Node]:
    """Characters, tags and their shares in links for every subtree that isn't left out, then densities and their sums."""
    order = leave_out(root)
    for node in reversed(order):
        node.tags += node.parent is not None
        node.told = node.tag in PARAGRAPHS
        for child in node.children:
            if type(child) is str:
                node.chars += _letters(child)
            elif not child.skip:
                node.chars += child.chars
                node.tags += child.tags
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags
                node.told |= child.told and child.chars > 0
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    whole = root.link_chars / root.chars if root.chars else 0.0
    for node in order:
        if node.chars:
            other = node.chars - node.link_chars
            base = math.log(node.chars * node.link_chars / max(1, other) + whole * node.chars + math.e)
            ratio = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
            node.density = node.chars / max(1, node.tags) * math.log(max(ratio, 1.0)) / base
    for node in order:
        node.sum = math.fsum(c.density for c in node.children if type(c) is Node and not c.skip)
    return order


def blocks(root: Node) -> Iterator[str]:
    """The text of a subtree, one string per block with its white space made single, empty ones left out."""
    pieces: list[str] = []

    def flush() -> Iterator[str]:
        if pieces:
            text = BLANK.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                yield text

    waiting: list[Node | str | None] = [root]
    while waiting:
        item = waiting.pop()
        if item is None:
            yield from flush()
        elif type(item) is str:
            pieces.append(item)
        elif item.skip:
            if item.tag in BLOCK and item.tag not in ("button", "label", "select"):
                yield from flush()
        else:
            if item.tag == "br":
                pieces.append(" ")
            if item.tag in BLOCK:
                yield from flush()
                waiting.append(None)
            waiting += reversed(item.children)
    yield from flush()


def _mostly_links(node: Node) -> bool:
    return 2 * node.link_chars >= node.chars


def _has_title(node: Node) -> bool:
    return any(n.tag == "h1" and n.chars and not n.skip for n in _in_order(node))


def content(root: Node) -> list[Node]:
    """The subtrees that make up the article, in page order, none inside another."""
    order = [n for n in measure(root) if n.chars]
    if not order:
        return []
    marked: list[Node] = []                            # outermost article and main elements that are not mostly links
    inside: set[int] = set()
    for node in order:
        if node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
        elif node.tag in ("article", "main") and not _mostly_links(node):
            inside.add(id(node))
            marked.append(node)
    body = next((n for n in order if n.tag == "body"), root)
    best = max((n for n in order if n is not root or body is root), key=lambda n: n.sum)
    if marked and (id(best) in inside or 2 * sum(n.chars for n in marked) >= best.chars):
        return marked

    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    least = min(n.density for n in path)
    others = [c for c in body.children if type(c) is Node and not c.skip and c.chars and c.tag in BLOCK]
    core = path[-2] if len(path) > 1 and path[-2] in others else None
    if core is not None and body.chars - sum(c.chars for c in others) > core.chars - core.link_chars:
        core, least = None, body.density               # the text stands in the body itself

    def wanted(node: Node) -> bool:
        return node is core or node.density >= least or not _mostly_links(node) and node.told or _has_title(node)

    kept = [c for c in others if wanted(c) or any(c is n for n in marked)]
    if core is not None:
        return kept
    for node in others:
        node.skip = all(node is not k for k in kept)
    return [body]


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by line feeds; empty where there is none."""
    return "\n".join(text for node in content(parse(page)) for text in blocks(node)) if page else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its main text and the number of code points in it.

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
    one line feed.  Null or empty pages, and pages without text outside of the parts left out, give an empty text; an
    article that a form, a wrapper or a class name of the whole page encloses stays.
    Nothing else is dropped or cut.  Repeated rows give repeated rows, null ids and urls stay null, other columns are
    not read.  No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    picked = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return picked.mapInArrow(tidied(run), SCHEMA)
