"""Main text of HTML pages by composite text density.

Every DOM node of the whole page, menus and all, gets link-adjusted characters per tag; a node's
density sum adds up those of its child blocks and of the text that stands in it directly. The node
with the largest sum is the core of the main text, and the least density on its path up to the body
is the threshold. Subtrees beside that path are looked at in the same way: one at or above the
threshold whose best node has a fair share of the core's sum is main text too. Within the chosen
subtrees furniture by kind or name goes, and so do blocks with a third of links or whose name may be
furniture if they reach neither the threshold nor half the density of what they stand in; all else,
short paragraphs too, stays.

Inline elements other than links are text of the block they are in. Scripts, styles, templates and
hidden elements are not rendered and count nowhere. What can only be furniture by its kind or name (a
nav, a footer, an advert, reader comments) is measured like all else, but can't be the core unless the
text outside of such boxes is a small part of the page: then the box that holds most is the page.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sigloom.llm.common import with_arrow

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: Elements that are not rendered as text.
DROPPED = frozenset("head script style template noscript iframe object embed applet svg math canvas audio video map select option datalist".split())
#: Elements that hold no part of an article, whatever their density.
CHROME = frozenset("nav footer aside menu dialog button form label legend".split())
#: Start tags that end an open p.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: Start tags that end an open element of the same kind, up to the element that bounds the search.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "thead": ({"tr", "td", "th", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
}
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog form toolbar".split())
#: Names (class or id) of boxes that hold no part of an article; a name is one if all its parts are in these two lists and one is in the first.
_STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adbox adslot banner banners sponsor sponsors sponsored promo promos promotion promotions popup popups modal modals "
    "cookie cookies consent gdpr nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead toolbar comment comments commentlist replies disqus newsletter subscribe "
    "subscription signup login pagination pager skiplink notice notices".split()
)
_WEAK = frozenset("alert alerts overlay rail widget widgets foot respond discussion share sharing social related recommend recommended recommendations search skip".split())
_PLAIN = frozenset(
    "a the of to for and site page main global top bottom left right side head header inner outer primary secondary box boxes bar bars block blocks wrap wrapper container content area section list lists "
    "item items link links group holder panel row col column form button buttons icon icons title text post posts article articles story stories news media more tags info id js ui c s".split()
)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S,
)
#: Of the core's density sum: what a subtree beside its path needs to be main text too.
SIDE_SHARE = 0.2

_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def one_line(text: str) -> str:
    """``text`` trimmed, with white space joined to one space."""
    return " ".join(text.split())


class Node:
    """An element: its tag, its children (elements and strings), the counts of its subtree, and what its kind and names say.

    ``role`` is 0 for a plain element, 1 for one that may be furniture, 2 for one that is.
    """

    __slots__ = ("chars", "children", "density", "link_chars", "link_tags", "own", "own_tags", "parent", "role", "tag", "tags", "text", "total")

    def __init__(self, tag: str, parent: Node | None, role: int = 0):
        self.tag, self.parent, self.children, self.role = tag, parent, [], role


def name_role(value: str) -> int:
    """What a class or id attribute says: 2 for furniture, 1 for a name that articles have too, else 0."""
    out = 0
    for name in value.split():
        parts = [x.lower() for x in _NAME_PART.findall(name)]
        if parts and all(x in _STRONG or x in _WEAK or x in _PLAIN for x in parts):
            out = max(out, 2 if any(x in _STRONG for x in parts) else 1 if any(x in _WEAK for x in parts) else 0)
    return out


def _role(tag: str, attributes: str, inside: bool) -> int | None:
    """The role of a start tag; None if it isn't rendered. ``inside``: it stands in an article or main element."""
    role = 2 if tag in CHROME or tag == "header" and not inside else 0
    if "=" not in attributes and "hidden" not in attributes:
        return role
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return None if tag not in ("html", "body") else 0
        if tag in ("html", "body", "main", "article"):
            continue
        if name in ("class", "id"):
            role = max(role, name_role(value))
        elif name == "role" and value.strip().lower() in _ROLES:
            role = 2
    return role


def parse(page: str) -> Node:
    """The tree of ``page`` without what isn't rendered. Unclosed, stray and cut-off tags are repaired."""
    root = Node("#root", None)
    at, node, pos, inside = 0, root, 0, 0
    open_skip: list[str] = []

    def text(upto):
        if upto > pos and not open_skip:
            node.children.append(html.unescape(page[pos:upto]))

    def close(upto):
        nonlocal node, inside
        while node is not upto:
            inside -= node.tag in ("article", "main")
            node = node.parent

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            text(len(page))
            break
        text(m.start())
        at = pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag, attributes = tag.lower(), m[3] or ""
        if not page.endswith(">", m.start(), m.end()):
            break  # a tag cut off by the end of the page
        if m[1]:
            if open_skip:
                if tag in open_skip:
                    while open_skip.pop() != tag:
                        pass
                continue
            if tag in ("p", "br") and not _has(node, tag):
                node.children.append(Node("br", node))
                continue
            target = node
            while target.parent is not None and target.tag != tag:
                if tag in INLINE and target.tag not in INLINE:  # an inline end tag closes no block
                    target = root
                    break
                target = target.parent
            if target.parent is not None:
                close(target.parent)
            continue
        void = tag in VOID
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = pos = end.end() if end else len(page)
            continue
        if open_skip:
            if not void and not attributes.endswith("/"):
                if tag == open_skip[-1] and tag in ("p", "li", "option"):
                    continue
                open_skip.append(tag)
            continue
        if tag in ENDS_P:
            target = node
            while target.parent is not None and target.tag != "p":
                if target.tag not in INLINE:
                    target = root
                    break
                target = target.parent
            if target.parent is not None:
                close(target.parent)
        if tag in SIBLINGS:
            ended, bound = SIBLINGS[tag]
            target, found = node, None
            while target.parent is not None and target.tag not in bound:
                if target.tag in ended:
                    found = target
                target = target.parent
            if found:
                close(found.parent)
        role = None if tag in DROPPED else _role(tag, attributes, inside > 0)
        if role is None:
            if not void and not attributes.endswith("/"):
                open_skip.append(tag)
            node.children.append("\n" if tag in INLINE else Node("br", node))
            continue
        child = Node(tag, node, role)
        node.children.append(child)
        if not void:
            inside += tag in ("article", "main")
            node = child
    return root


def _has(node: Node, tag: str) -> bool:
    while node.parent is not None:
        if node.tag == tag:
            return True
        node = node.parent
    return False


def _walk(root: Node) -> list[Node]:
    """All elements, parents first."""
    out, i = [root], 0
    while i < len(out):
        out.extend(c for c in out[i].children if isinstance(c, Node))
        i += 1
    return out


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density: characters per tag, scaled by how far they are from being links.

    ``share`` is the part of the page's text that is in links. Without any links on the page, where
    the scale is not defined, it is characters per tag alone.
    """
    if not chars:
        return 0.0
    plain = chars / max(tags, 1)
    if not share:
        return plain
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    ratio = chars / max(link_chars, 1) * (max(tags, 1) / max(link_tags, 1))
    return plain * math.log(ratio) / math.log(base) if ratio > 1 else 0.0


def measure(root: Node) -> list[Node]:
    """Counts, composite text densities and density sums of all elements; returns them, parents first."""
    nodes = _walk(root)
    for node in reversed(nodes):
        node.chars = node.tags = node.link_chars = node.link_tags = node.own = node.own_tags = node.text = 0
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
                if c.tag in INLINE and c.tag != "a":
                    node.own += c.own
                    node.own_tags += c.own_tags + 1
            else:
                n = len(one_line(c))
                node.chars += n
                node.own += n
                node.text += n
        if node.tag == "a":
            node.link_chars = node.chars
            node.link_tags = max(node.link_tags, 1)
    share = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        # what the sum is over: child blocks, also within inline elements, and the text beside them
        parts, stack = [], [c for c in node.children if isinstance(c, Node)]
        while stack:
            c = stack.pop()
            if c.tag in INLINE and c.tag != "a":
                stack.extend(x for x in c.children if isinstance(x, Node))
            elif c.tag not in VOID:
                parts.append(c)
        node.total = density(node.own, node.own_tags, 0, 0, share) if parts else node.density
        node.total += sum(c.density for c in parts if not c.role)
    return nodes


def _settle(body: Node) -> None:
    """Takes the role from boxes that hold the page itself: while what is outside of furniture is a small part of it."""
    while True:
        outside, boxes, stack = 0, [], [body]
        while stack:
            node = stack.pop()
            if node.role:
                boxes.append(node)
                continue
            outside += node.text
            stack.extend(c for c in node.children if isinstance(c, Node))
        large = [b for b in boxes if b.tag not in ("nav", "footer", "menu") and b.chars > 4 * outside and 2 * b.chars > body.chars]
        if not large:
            return
        large[0].role = 0


def select(root: Node) -> tuple[list[Node], float]:
    """The elements whose subtrees are main text, in page order, and the threshold."""
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    if not body.chars:
        return [], 0.0
    before = [n.role for n in nodes]
    _settle(body)
    if before != [n.role for n in nodes]:
        measure(root)

    def inner(top: Node) -> list[Node]:
        """Blocks of a subtree outside of furniture, in page order."""
        out, stack = [], [top]
        while stack:
            node = stack.pop()
            out.append(node)
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.role and c.tag not in INLINE)
        return out

    core = max(inner(body), key=lambda n: n.total)  # the first in page order where equal
    if core.total <= 0:
        return [body], 0.0
    threshold, node = core.density, core
    while node is not body and node.parent is not None:
        node = node.parent
        threshold = min(threshold, node.density)
    chosen, path = [core], [core]

    def beside(top: Node, peak: Node) -> None:
        """Chooses among what stands beside the path from ``top`` down to ``peak``."""
        while peak is not top:
            for c in peak.parent.children:
                if isinstance(c, Node) and c is not peak and not c.role and c.tag not in INLINE:
                    path.append(c)
            peak = peak.parent

    path.clear()
    beside(body, core)
    while path:
        top = path.pop()
        best = max(inner(top), key=lambda n: n.total)
        if top.density >= threshold and best.total >= SIDE_SHARE * core.total:
            chosen.append(best)
            beside(top, best)
    keep = {id(n) for n in chosen}
    return [n for n in _preorder(body) if id(n) in keep], threshold


def _preorder(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def _left_out(node: Node, least: float) -> bool:
    """Whether a block inside main text is furniture: by its role, or less dense than ``least`` with a third of it in links.

    A name that may be furniture's counts for a block that is less dense or a single run of text.
    """
    low = node.density < least
    return node.role == 2 or node.role == 1 and (low or node.total <= node.density) or low and node.link_tags > 1 and 3 * node.link_chars > node.chars


def blocks(node: Node, least: float = 0.0) -> list[str]:
    """The text blocks of a subtree in page order, white space joined to one space."""
    out, run = [], []

    def end():
        line = one_line("".join(run))
        if line:
            out.append(line)
        run.clear()

    stack: list = [node]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            run.append(item)
        elif item is not node and _left_out(item, least):
            if item.tag not in INLINE:
                end()
        elif item.tag in INLINE:
            stack.extend(reversed(item.children))
        else:
            end()
            stack.append(None)
            stack.extend(reversed(item.children))
    end()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page; empty for a null, an empty page or one without text."""
    if not page:
        return ""
    chosen, threshold = select(parse(page))
    return "\n".join(line for node in chosen for line in blocks(node, max(threshold, node.density / 2)))


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points of it), from the whole html.

    Defined cases: a null or empty page, or one without rendered text, gives an empty text; where no
    block has any density the whole body is the text; of subtrees with equal sums the first in page
    order is the core; equal rows give equal texts each; an empty table stays empty. Unclosed, stray
    and cut-off tags are repaired, however deep elements are nested. Other columns pass through;
    those named ``text`` or ``n_chars`` are replaced.
    """
    def fn(values):
        texts = [main_text(v) for v in values]
        return texts, [len(t) for t in texts]

    return with_arrow(pages, [html_col], [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], fn)
