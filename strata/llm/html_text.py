"""Main-text extraction from HTML by tree scoring.

A page is parsed into a light tree (end tags that HTML lets authors omit are implied). Subtrees that
are boilerplate by their element, role or name are dropped (a class or id of nothing but telling and general words;
where it has other words too, the subtree is only dropped if it holds the smaller part of the page's text); every paragraph that is left gives points
for its length and commas, discounted by the share of its text that is links: the full points to its
parent, half to the next ancestor, less and less above. The best container, once more discounted by its
own link density, is kept with those of its siblings that read like more of the same text. An enclosing
``article`` or ``main`` is taken in its place, so that headings and short paragraphs aren't lost.

The text: character references decoded; white space in a block turned into one space and trimmed; blocks
in page order, joined by a newline. Nothing is cut. Null, empty and textless pages give an empty string.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import raw_texts

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "script style title head nav footer aside form button select textarea input iframe noscript template svg canvas object embed dialog menu map audio video".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Parts of class names and ids that tell boilerplate.
UNLIKELY = frozenset(
    "ad ads adv advert advertisement advertising adsense adverts advertorial banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer discussion disqus footer footnav gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination paywall popup promo promoted promotion recommended recommendations related replies reply respond share sharing sidebar "
    "signin signup skip skyscraper social sponsor sponsored subscribe subscription subnav teaser toolbar topbar widget widgets".split()
)
#: Words that say nothing of what a name stands for.
GENERAL = frozenset(
    "section sections wrapper wrap container box block area list item items inner outer content contents main page post posts article articles entry user users reader readers "
    "site global top bottom left right primary secondary row col column columns bar panel group link links button buttons icon icons the and js ui id div module region zone slot unit "
    "title heading text body small large fixed sticky bottombar rail".split()
)
#: Beside these a name says what a page's wrapper has, not what it is.
WRAPPERS = frozenset("with has no without layout page".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends an open element of these kinds, if none of the others stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("html body article section div main td th li dd blockquote figure table header footer aside nav form button object caption".split())

#: Characters of the shortest paragraph that gives points; ancestors that get them; siblings' share of the best score.
LEAST, LEVELS, SIBLING = 25, 6, 0.2


class Node:
    __slots__ = ("tag", "parent", "items", "attributes", "gone", "chars", "links", "commas", "score", "below", "below_links")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]):
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.items: list[Node | str] = []
        self.gone = False
        self.chars = self.links = self.commas = self.below = self.below_links = 0
        self.score = 0.0


def parse(page: str) -> list[Node]:
    """All elements in page order; the first is the root."""
    root = Node("html", None, {})
    nodes, stack, at, n = [root], [root], 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            stack[-1].items.append(page[at:start])
        if start == n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        mark = page[start + 1 : start + 2]
        if mark in ("!", "?") or (mark == "/" and not page[start + 2 : start + 3].isalpha()):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        if not (mark == "/" or mark.isascii() and mark.isalpha()):
            stack[-1].items.append("<")
            at = start + 1
            continue
        tag = TAG.match(page, start)
        if tag:
            closing, name, rest, at = tag[1], tag[2].lower(), tag[3], tag.end()
        else:  # a quote or the tag itself doesn't end
            end = page.find(">", start)
            if end < 0:
                break
            closing, name, rest, at = "/" if mark == "/" else "", re.split(r"[\s/>]", page[start + 1 + (mark == "/") : end], maxsplit=1)[0].lower(), "", end + 1
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
                if name not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        if name == "html" or name == "body" and any(x.tag == "body" for x in stack):
            continue
        if name in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in P_SCOPE:
                    break
        if name in IMPLIED:
            closes, within = IMPLIED[name]
            low = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag in closes:
                    low = i
            if low:
                del stack[low:]
        if name == "body":
            del stack[1:]
        attributes = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)} if rest.strip(" /") else {}
        node = Node(name, stack[-1], attributes)
        stack[-1].items.append(node)
        nodes.append(node)
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(page, at)
            if not end:
                break
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
        elif name not in VOID and not (rest.endswith("/") and name not in BLOCK and name in ("path", "circle", "rect", "use")):
            stack.append(node)
    return nodes


def _boilerplate(node: Node, in_article: bool) -> int:
    """0, 1 if only a name hints at it, or 2."""
    tag, a = node.tag, node.attributes
    if tag in DROPPED:
        return 2
    if tag == "header":
        return 0 if in_article else 2
    if not a:
        return 0
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return 2
    if "display:none" in a.get("style", "").replace(" ", "").lower():
        return 2
    if tag in ("html", "body", "main"):
        return 0
    hint = 0
    for names in (a.get("class", ""), a.get("id", "")):
        for name in names.split():
            parts = {x.lower() for x in NAME_PARTS.findall(name) if not x.isdigit()}
            telling = parts & UNLIKELY or ({"header"} & parts if not in_article else set())
            if telling and not parts & WRAPPERS:
                hint = max(hint, 2 if parts <= UNLIKELY | GENERAL | {"header"} else 1)
    return hint


def _sum(nodes: list[Node]) -> None:
    """Of each element, the text in it and below."""
    for node in nodes:
        node.below, node.below_links = node.chars, node.links
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.below += node.below
            node.parent.below_links += node.below_links


def _measure(nodes: list[Node]) -> None:
    """Marks what is dropped and gives each block its text's figures and each container its score."""
    article: dict[int, bool] = {}
    block: dict[int, Node] = {}
    linked: dict[int, bool] = {}
    hinted: list[Node] = []
    for node in nodes:
        up = node.parent
        inside = up is not None and article[id(up)]
        sign = 0 if up is None or up.gone else _boilerplate(node, inside)
        node.gone = up is not None and (up.gone or sign == 2)
        if sign == 1:
            hinted.append(node)
        article[id(node)] = inside or node.tag in ("article", "main")
        linked[id(node)] = node.tag == "a" or up is not None and linked[id(up)]
        own = block[id(node)] = node if up is None or node.tag in BLOCK else block[id(up)]
        if not node.gone:
            for item in node.items:
                if type(item) is str:
                    size = len(" ".join(item.split()))
                    own.chars += size
                    own.commas += item.count(",") + item.count("、") + item.count("，")
                    if linked[id(node)]:
                        own.links += size
    _sum(nodes)
    if hinted:
        whole = nodes[0].below - nodes[0].below_links
        for node in hinted:
            node.gone = 2 * (node.below - node.below_links) <= whole
        for node in nodes:
            node.gone = node.gone or node.parent is not None and node.parent.gone
            if node.gone:
                node.chars = node.links = node.commas = 0
        _sum(nodes)
    for node in nodes:
        if node.chars < LEAST or node.tag in HEADINGS:
            continue
        points = (1 + node.commas + min(node.chars / 100, 3)) * (1 - min(1, node.links / node.chars))
        up, level = node if node.tag in ("div", "section", "article", "main", "body") else node.parent, 0
        while up is not None and level < LEVELS:
            up.score += points / (1, 2, 6, 9, 12, 15)[level]
            up, level = up.parent, level + 1


def _density(node: Node) -> float:
    return min(1.0, node.below_links / node.below) if node.below else 0.0


def _chosen(nodes: list[Node]) -> list[Node]:
    best, most = None, 0.0
    for node in nodes:
        score = node.score * (1 - _density(node))
        if not node.gone and score > most:
            best, most = node, score
    if best is None:
        for tags in (("article",), ("main",), ("body",), ("html",)):
            for node in nodes:
                if node.tag in tags and not node.gone and node.below:
                    return [node]
        return []
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best, most = up, max(most, up.score * (1 - _density(up)))
            break
        up = up.parent
    if best.parent is None:
        return [best]
    kept = []
    for node in best.parent.items:
        if node is best:
            kept.append(node)
        elif type(node) is not str and not node.gone and node.below:
            like = node.score * (1 - _density(node)) >= max(10, SIBLING * most)
            paragraph = node.tag == "p" and (node.chars > 80 and _density(node) < 0.25 or node.chars and not node.links and node.tag == best.tag)
            if like or paragraph or node.tag == "h1":
                kept.append(node)
    return kept


def _blocks(nodes: list[Node]):
    for top in nodes:
        run: list[str] = []
        stack: list[tuple[Node, int]] = [(top, 0)]
        while stack:
            node, i = stack.pop()
            if i == len(node.items):
                if node.tag in BLOCK:
                    yield "".join(run)
                    run = []
                continue
            stack.append((node, i + 1))
            item = node.items[i]
            if type(item) is str:
                run.append(item)
            elif item.tag == "br":
                run.append(" ")
            elif not item.gone:
                if item.tag in BLOCK:
                    yield "".join(run)
                    run = []
                stack.append((item, 0))
        yield "".join(run)


def main_text(page: str) -> str:
    """The main text of a page."""
    if not page:
        return ""
    nodes = parse(page)
    _measure(nodes)
    blocks = (" ".join(html.unescape(block).split()) for block in _blocks(_chosen(nodes)))
    return "\n".join(block for block in blocks if block)


def extract(pages: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without the html, with its main text in a column ``out``; other columns are kept."""
    from pyspark.sql import types as T

    keep = [c for c in pages.columns if c not in (html_column, out)]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(out, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(raw.decode()) for raw in raw_texts(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, out])

    return pages.select(*[f"`{c}`" for c in keep], html_column).mapInArrow(run, schema)
