"""The main text of web pages by composite text density.

Each page becomes a tree of its tags (unclosed and stray tags are put right as a browser would). For every node the
characters and tags under it, and those under links, give its composite density: characters per tag, damped where
links hold most of them. A node's density sum is the sum over its children. From the body the content is the node of
the largest density sum; the least density on the way from it up to the body is the threshold below which parts of it
are left out, if they are containers that hold mostly links; headings, paragraphs and items are not left out.

What is never main text is taken out before counting: scripts, styles, forms, navigation, headers and footers of the
page, sidebars, reader comments and elements of such a role. Elements whose class or id names an advert, a notice, a
menu and the like are taken out where they hold mostly links or little of the body's text (PART_OF_NAME, or WHOLE_NAME
where nothing else is in the name), or stand beside an article or main element; if nothing is left, names do not count.

Text: character references decoded, white space inside a block is one blank, blocks are joined by one line feed in
page order; nothing is cut.

Cases: null and empty pages give an empty text; pages without markup are text; unclosed tags, stray end tags,
repeated attributes and references without a semicolon are taken as they come; ties go to the earlier, inner node;
repeated rows each get a row; extra columns are dropped.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
BLOCKS = frozenset("html body address article aside blockquote center details dd dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head script style noscript template iframe svg math object form button select textarea input nav footer aside menu dialog".split())
ENDS_P = BLOCKS - {"html", "body", "td", "th", "option", "legend", "summary"}
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
UNWANTED = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|comments?|commentlist|disqus|respond|replies|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|sidebar|side|widget\w*|nav|navbar|navigation|menu|breadcrumbs?|pagination|pager|footer|masthead|topbar|toolbar|related|share|sharing|social|skip|signup|login)(?:[-_\s\d]|$)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
COMMENTS = frozenset(("comments", "commentlist", "comment-list", "disqus_thread", "disqus-thread", "respond", "reader-comments", "readercomments"))
WHOLE_NAME, PART_OF_NAME = 0.5, 0.25  # an element named "sidebar" goes below half of the body's text, "with-sidebar" below a quarter
SITE_HEADER = frozenset(("header", "site-header", "page-header", "global-header", "top-header"))
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("attrs", "chars", "children", "density", "link_chars", "link_tags", "parent", "sum", "tag", "tags")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def tree(page: str) -> Node:
    """The page as nodes and strings."""
    root = Node("#root", "", None)
    open_node, at, end = root, 0, len(page)
    while at < end:
        found = TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at:
            open_node.children.append(html.unescape(page[at:stop]))
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            if found[0].startswith("<![CDATA["):
                open_node.children.append(found[0][9:].removesuffix("]]>"))
            continue
        if found[1]:
            if tag == "br" or tag == "p" and not _is_open(open_node, "p"):
                open_node.children.append(Node(tag, "", open_node))
                continue
            up = open_node
            while up is not root and up.tag != tag:
                up = None if tag in INLINE and up.tag in BLOCKS else up.parent  # an inline end does not close blocks
                if up is None:
                    break
            if up is not None and up is not root:
                open_node = up.parent
            continue
        if tag in ENDS_P:
            while _is_open(open_node, "p"):
                open_node = _above(open_node, "p")
        for same, limits in (("li", ("ul", "ol", "menu")), ("tr", ("table",)), ("option", ("select",)), ("td", ("tr", "table")), ("th", ("tr", "table")), ("dt", ("dl",)), ("dd", ("dl",))):
            if tag == same or {tag, same} in ({"td", "th"}, {"dt", "dd"}):
                open_node = _close(open_node, same, limits)
        node = Node(tag, found[3], open_node)
        open_node.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            inside = page[at : close.start() if close else end]
            if tag in ("title", "textarea"):
                node.children.append(html.unescape(inside))
            at = close.end() if close else end
        elif tag not in VOID:
            open_node = node
    return root


def _is_open(node: Node, tag: str) -> bool:
    """Whether a tag is open inside the nearest block that is not that tag."""
    while node is not None and node.tag != "#root":
        if node.tag == tag:
            return True
        if node.tag in BLOCKS:
            return False
        node = node.parent
    return False


def _above(node: Node, tag: str) -> Node:
    while node.tag != tag:
        node = node.parent
    return node.parent


def _close(node: Node, tag: str, limits: tuple[str, ...]) -> Node:
    up = node
    while up.tag != "#root" and up.tag not in limits:
        if up.tag == tag:
            return up.parent
        up = up.parent
    return node


def unwanted(node: Node, in_article: bool) -> bool:
    """What is never main text, however much it holds."""
    if node.tag in NEVER:
        return True
    if node.tag == "header":
        return not in_article
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return False
    a = attributes(node.attrs)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    return not COMMENTS.isdisjoint(f"{a.get('class', '')} {a.get('id', '')}".lower().split())


def named(node: Node, in_article: bool) -> float:
    """The share of the body's text under which an element goes because of its class or id; 0.0 without such a name."""
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return 0.0
    a = attributes(node.attrs)
    names = CAMEL.sub("-", f"{a.get('class', '')} {a.get('id', '')}")
    if not in_article and not SITE_HEADER.isdisjoint(names.lower().split()):
        return WHOLE_NAME
    if not UNWANTED.search(names):
        return 0.0
    whole = any(all(UNWANTED.fullmatch(part) for part in re.split(r"[-_]+", name) if part) for name in names.split())
    return WHOLE_NAME if whole else PART_OF_NAME


def walk(root: Node, body: Node, by_name: bool = True) -> list[tuple[Node, bool]]:
    """Nodes under the body in page order without unwanted ones, each with whether it is within a link."""
    out, todo, suspects = [], [(body, False, False)], {}
    while todo:
        node, link, article = todo.pop()
        out.append((node, link))
        article = article or node.tag in ("article", "main")
        node.children = [c for c in node.children if isinstance(c, str) or not unwanted(c, article)]
        for c in node.children if by_name else ():
            if not isinstance(c, str) and (share := named(c, article)):
                suspects[id(c)] = share, article
        todo += [(c, link or c.tag == "a", article) for c in reversed(node.children) if not isinstance(c, str)]
    return _without(out, suspects) if suspects else out


def _without(nodes: list[tuple[Node, bool]], suspects: dict[int, tuple[float, bool]]) -> list[tuple[Node, bool]]:
    """Without the elements with unwanted names that hold mostly links or little of the body's text. Beside an article or
    main element with text, what neither holds nor is in one goes whatever its size."""
    chars, links, holds = {}, {}, {}
    for node, link in reversed(nodes):
        k, own, inside = id(node), [len(SPACE.sub(" ", c).strip()) for c in node.children if isinstance(c, str)], [id(c) for c in node.children if not isinstance(c, str)]
        chars[k] = sum(own) + sum(chars[c] for c in inside)
        links[k] = sum(own) * (link or node.tag == "a") + sum(links[c] for c in inside)
        holds[k] = node.tag in ("article", "main") and chars[k] > links[k] or any(holds[c] for c in inside)
    body = id(nodes[0][0])
    text = chars[body] - links[body]

    def goes(node: Node) -> bool:
        share, in_article = suspects.get(id(node), (0.0, False))
        if not share:
            return False
        k = id(node)
        beside = holds[body] and not in_article and not holds[k]
        return beside or links[k] * 2 > chars[k] or chars[k] - links[k] < share * text or not chars[k]

    out, todo = [], [(nodes[0][0], nodes[0][1])]
    while todo:
        node, link = todo.pop()
        out.append((node, link))
        node.children = [c for c in node.children if isinstance(c, str) or not goes(c)]
        todo += [(c, link or c.tag == "a") for c in reversed(node.children) if not isinstance(c, str)]
    return out


def measure(nodes: list[tuple[Node, bool]]) -> None:
    """Counts and densities, children before parents."""
    for node, link in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                n = len(SPACE.sub(" ", c).strip())
                node.chars += n
                node.link_chars += n * (link or node.tag == "a")
            else:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    body = nodes[0][0]
    share = body.link_chars / body.chars if body.chars else 0.0
    for node, _ in nodes:
        if not node.chars:
            continue
        c, t, lc, lt = node.chars, node.tags or 1, node.link_chars, node.link_tags
        base = max(2.0, math.log(c / ((c - lc) or 1) * lc + share * c + math.e))  # a base near one would make any node the densest
        node.density = c / t * math.log(c / (lc or 1) * t / (lt or 1), base) if c * t > (lc or 1) * (lt or 1) else 0.0
    for node, _ in nodes:
        node.sum = sum(c.density for c in node.children if not isinstance(c, str))


def main_node(nodes: list[tuple[Node, bool]]) -> tuple[Node, float]:
    """The node of the largest density sum and the threshold: the least density on its way up to the body."""
    body = nodes[0][0]
    best = max((n for n, _ in nodes), key=lambda n: (n.sum, _depth(n)))
    least, up = best.density, best
    while up is not body:
        up = up.parent
        least = min(least, up.density)
    return best, least


def _depth(node: Node) -> int:
    n = 0
    while node.parent is not None:
        node, n = node.parent, n + 1
    return n


HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
TEXT_BLOCKS = INLINE | HEADINGS | {"p", "li", "ul", "ol", "blockquote", "pre", "td", "tr", "tbody", "table", "dd", "dt", "dl"}
ITEMS = frozenset(("p", "li", "dt", "dd", "blockquote", "pre", "figcaption", "td", "th", "tr", "caption"))
LISTS = frozenset(("ul", "ol", "dl", "table", "tbody", "thead"))


def content(nodes: list[tuple[Node, bool]]) -> Node:
    """The subtree to read: the outermost article around the densest node, or the main element where that adds a heading
    or other articles (or, without one, a parent that holds nothing but articles and headings). Without article and main,
    the densest node, widened out of text blocks (they are not split), to parents where other parts at least as dense as
    the threshold hold a tenth of its text or more, and to a parent that adds its heading."""
    best, threshold = main_node(nodes)
    body, up = nodes[0][0], best
    article = main = None
    while up is not None:
        article = up if up.tag == "article" else article
        main = up if up.tag == "main" else main
        up = up.parent
    if article is not None:
        inside = {id(n) for n, _ in _below(article)}
        if main is not None and any(n.chars and id(n) not in inside and (n.tag in HEADINGS or n.tag == "article") for n, _ in _below(main)):
            return main
        parts = [c for c in article.parent.children if (c.strip() if isinstance(c, str) else c.chars)] if article is not body else []
        if len(parts) > 1 and all(not isinstance(c, str) and (c.tag == "article" or c.tag in HEADINGS) for c in parts):
            return article.parent
        return article
    if main is not None:
        return main
    while best is not body and best.tag in TEXT_BLOCKS:
        best = best.parent
    wide, up = best, best
    while up is not body:
        others = [c for c in up.parent.children if not isinstance(c, str) and c is not up]
        heads = any(c.tag in HEADINGS for c in others) and up.parent is not body
        if heads or any(c.density >= threshold and (c.chars - c.link_chars) * 10 >= wide.chars for c in others):
            wide = up.parent
        up = up.parent
    return wide


def _below(node: Node) -> list[tuple[Node, bool]]:
    """A node and the nodes under it, in page order, each with whether it is within a link inside the node."""
    out, todo = [], [(node, False)]
    while todo:
        x, link = todo.pop()
        out.append((x, link))
        todo += [(c, link or c.tag == "a") for c in reversed(x.children) if not isinstance(c, str)]
    return out


def _is_text(node: Node, listed: bool) -> bool:
    """Whether a block is text of its own: a heading, paragraph or item, a list where `listed`, or a wrapper of just one."""
    while True:
        if node.tag in HEADINGS or node.tag in ITEMS or listed and node.tag in LISTS:
            return True
        parts = [c for c in node.children if (c.strip() if isinstance(c, str) else c.chars)]
        if len(parts) != 1 or isinstance(parts[0], str):
            return False
        node = parts[0]


def blocks(node: Node, threshold: float) -> list[str]:
    """Texts of the blocks under a node. A container that is mostly links and below the threshold is left out; headings,
    paragraphs and items stay, and inside an article or main element lists."""
    in_article = node.tag in ("article", "main") or any(not isinstance(c, str) and c.tag == "article" for c in node.children)
    out: list[list[str]] = [[]]
    todo: list = [("open", node)]
    while todo:
        what, x = todo.pop()
        if what == "text":
            out[-1].append(x)
        elif what == "close":
            out.append([])
        else:
            if x is not node and x.density < threshold and x.link_chars * 2 > x.chars and x.tag in BLOCKS and not _is_text(x, in_article):
                continue
            if x.tag == "br":
                out[-1].append(" ")
                continue
            if x.tag in BLOCKS:
                out.append([])
                todo.append(("close", x))
            todo += [("text", c) if isinstance(c, str) else ("open", c) for c in reversed(x.children)]
    texts = [SPACE.sub(" ", "".join(parts)).strip() for parts in out]
    return [t for t in texts if t]


def main_text(page: str | None) -> str:
    """The main text; where names leave nothing, once more without them."""
    return _main_text(page, True) or _main_text(page, False) if page else ""


def _main_text(page: str, by_name: bool) -> str:
    root = tree(page)
    body = _find(root, "body") or root
    nodes = walk(root, body, by_name)
    measure(nodes)
    if not body.chars:
        return ""
    _, threshold = main_node(nodes)
    return "\n".join(blocks(content(nodes), threshold))


def _find(root: Node, tag: str) -> Node | None:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == tag:
            return node
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return None


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars."""
    schema = "id bigint, url string, text string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["id", "url", "text"])

    read = pages.select(F.col(key).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html")).mapInArrow(work, schema)
    return read.select(F.col("id").alias(key), F.col("url").alias(url), "text", F.length("text").cast("bigint").alias("n_chars"))
