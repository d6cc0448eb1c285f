"""A small DOM of block elements: parsing with omitted end tags, roles of elements, simple tree matching."""

from __future__ import annotations

import html as entities
import re

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.DOTALL,
)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
# Elements and names by what they are: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math select object canvas audio video noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
APART = frozenset("nav header footer aside form button dialog menu head fieldset datalist search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist tooltip status".split())
NAMES = re.compile(
    r"ads?|advert\w*|adsense|adbox|adslot|banners?|sponsor\w*|promo\w*|cookies?|cookiebar|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w+|paywall|"
    r"sidebar\w*|widgets?|menus?|nav\w*|breadcrumbs?|footers?|header|masthead|topbar|comments?|commentlist|disqus|respond|replies|discussion|"
    r"share|sharing|social|related|recommend\w*|teasers?|toolbar|pagination|pager|skip|login|signup|register|tagcloud|copyright|legal|disclaimer"
)
# A name that says what an element has, not what it is.
HAS = frozenset("has with no is without page body site wrapper container main content article post layout".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag ends an open element of the named kinds; the search stops at the elements after the bar.
_P = ("p",), ("article", "td", "th", "li", "section", "blockquote", "body", "button")
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead"), ("table",)), "tfoot": (("tbody", "thead"), ("table",)),
    "option": (("option",), ("select",)),
}
# Elements deeper than this hang on the last one above.
DEPTH = 120


# Marked elements are the article unless the page has this many times as much other text outside of links.
OUTSIDE = 4


class Link(str):
    """Text inside a link; ``at`` tells links apart."""

    at = 0


class Node:
    """A block element: its text runs and block children in page order; text of links is ``Link``."""

    __slots__ = ("tag", "label", "kids", "parts", "apart", "main", "number")

    def __init__(self, tag: str, label: str, apart: bool, main: bool):
        self.tag, self.label, self.apart, self.main = tag, label, apart, main
        self.kids: list[Node] = []
        self.parts: list = []  # text, or a Node
        self.number = -1


def _is_apart(tag: str, attrs: str, inside_main: bool) -> tuple[bool, str, bool]:
    """(kept out of the article?, label for matching, does it say it holds the article?)."""
    if not attrs:
        return tag in APART and not (tag == "header" and inside_main), tag, tag in ("article", "main")
    a = {k.lower(): b or c or d for k, b, c, d in ATTR.findall(attrs)}
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    role = a.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article") or "articlebody" in a.get("itemprop", "").lower()
    label = f"{tag}.{names[0]}" if names else tag
    bare = re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs).lower().split()
    if "hidden" in bare or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "").lower()):
        return True, label, main
    if tag in APART and not (tag == "header" and inside_main) or role in ROLES:
        return True, label, False
    if tag in ("body", "html", "main"):
        return False, label, main
    for name in names:
        words = re.split(r"[^a-z0-9]+", name)
        if words[0] in HAS and len(words) > 1 and tag != "section":
            words = words[1:] if words[0] in ("site", "page") else []
        if any(w and NAMES.fullmatch(w) for w in words):
            return True, label, False
    return False, label, main


def parse(page: str) -> Node:
    """The tree of block elements; raw elements, comments and markup are left out, inline elements are dissolved."""
    root = Node("html", "html", False, False)
    stack = [root]
    depth_in_main = 0
    link = 0
    at = 0
    find = TAG.search
    while True:
        m = find(page, at)
        top = stack[-1]
        text = page[at : m.start()] if m else page[at:]
        if text:
            if link:
                text = Link(text)
                text.at = link
            top.parts.append(text)
        if not m:
            return root
        at = m.end()
        if m.lastindex is None:
            continue
        end, tag, attrs = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        tag = tag.lower()
        if tag in RAW:
            if not end and not attrs.endswith("/"):
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = close.end() if close else len(page)
            top.parts.append(" ")
        elif tag in INLINE:
            if tag == "br":
                top.parts.append(" ")
            elif tag == "a":
                link = 0 if end else at
        elif tag in VOID:
            top.parts.append(None)
        elif end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    depth_in_main -= sum(n.main for n in stack[i:])
                    del stack[i:]
                    link = 0
                    break
        else:
            kinds, stop = CLOSES.get(tag, _P)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in kinds:
                    depth_in_main -= sum(n.main for n in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in stop:
                    break
            if tag in ("html", "head", "body") and len(stack) == 1 and tag == "html":
                continue
            if tag == "body" and len(stack) > 1 and stack[-1].tag == "head":
                stack.pop()
            link = 0
            apart, label, main = _is_apart(tag, attrs, depth_in_main > 0)
            node = Node(tag, label, apart, main and not apart)
            stack[-1].kids.append(node)
            stack[-1].parts.append(node)
            if len(stack) < DEPTH and not attrs.endswith("/"):
                stack.append(node)
                depth_in_main += node.main


def size(node: Node) -> int:
    """Characters of text below a node that are neither kept out nor in a link."""
    total, todo = 0, [node]
    while todo:
        n = todo.pop()
        if not n.apart:
            total += sum(len(p.strip()) for p in n.parts if type(p) is str)
            todo += n.kids
    return total


def _mains(node: Node, out: list[Node]) -> None:
    for kid in node.kids:
        if kid.apart:
            continue
        if kid.main:
            inner: list[Node] = []
            _mains(kid, inner)
            out += [n for n in inner if n.tag == "article"] or [kid] if kid.tag == "main" else [kid]
        else:
            _mains(kid, out)


def article(root: Node) -> tuple[list[Node], bool]:
    """(elements that hold the article, are they marked as such?): all marked ones, or the page if they hold little of it."""
    found: list[Node] = []
    _mains(root, found)
    if not found:
        return [root], False
    inside = sum(size(n) for n in found)
    return ([root], False) if size(root) - inside > OUTSIDE * inside else (found, True)


def numbered(nodes: list[Node]) -> list[Node]:
    """All nodes below that are not kept out, numbered in page order."""
    out: list[Node] = []
    todo = list(reversed(nodes))
    while todo:
        n = todo.pop()
        if n.apart:
            continue
        n.number = len(out)
        out.append(n)
        todo.extend(reversed(n.kids))
    return out


def clean(text: str) -> str:
    if "&" in text:
        text = entities.unescape(text)
    return " ".join(text.split())


def own_text(node: Node) -> str:
    """A node's text without its block children's."""
    return clean(" ".join(p if p is not None else " " for p in ("" if isinstance(p, Node) else p for p in node.parts)))


def only_links(tag: str, run: list[str]) -> bool:
    """Is a block of an unmarked page part of a list of links?  Words outside of links say no, and so does a heading or one link's paragraph."""
    links = {p.at for p in run if type(p) is Link and p.strip()}
    if not links or tag in HEADINGS or (tag == "p" and len(links) == 1):
        return False
    return not any(ch.isalnum() for p in run if type(p) is str for ch in clean(p))


def blocks(nodes: list[Node], marked: bool, drop: frozenset | set = frozenset()) -> list[str]:
    """Blocks of text in page order, without nodes numbered in ``drop``; lists of links go if no article is marked."""
    out: list[str] = []

    def walk(node: Node, only_headings: bool) -> None:
        if node.apart or node.number in drop:
            return
        only_headings = only_headings or node.tag == "header"
        run: list[str] = []

        def flush() -> None:
            text = clean("".join(run))
            if text and not (only_headings and node.tag not in HEADINGS) and (marked or not only_links(node.tag, run)):
                out.append(text)
            run.clear()

        for p in node.parts:
            if isinstance(p, str):
                run.append(p)
            else:
                flush()
                if p is not None:
                    walk(p, only_headings)
        flush()

    for n in nodes:
        walk(n, False)
    return out


def skeleton(nodes: list[Node], hashed) -> list:
    """[label, hash of own text, number, children] of each node, for matching with other pages."""

    def make(n: Node) -> list:
        return [n.label, hashed(own_text(n)), n.number, [make(k) for k in n.kids if not k.apart]]

    return [make(n) for n in nodes]


def matched(left: list, right: list) -> list[tuple[int, int]]:
    """Simple tree matching of two skeletons: pairs (number, number) of the largest common top-down tree.

    Children are aligned in order; equal text counts half a node more, so that constant nodes find each other.
    """

    def match(a: list, b: list) -> tuple[float, list]:
        base = 1.5 if a[1] == b[1] else 1.0
        if not a[3] or not b[3]:
            return base, [(a[2], b[2])]
        score, pairs = align(a[3], b[3])
        return base + score, [(a[2], b[2]), *pairs]

    def align(xs: list, ys: list) -> tuple[float, list]:
        n = len(ys)
        rows = [[0.0] * (n + 1)]
        cells = []
        for x in xs:
            before, row, found = rows[-1], [0.0], []
            label, text, leaf = x[0], x[1], not x[3]
            for j, y in enumerate(ys):
                w, pair = 0.0, None
                if y[0] == label:
                    if leaf or not y[3]:
                        w = 1.5 if y[1] == text else 1.0
                    else:
                        w, pair = match(x, y)
                found.append((w, pair))
                best = before[j + 1] if before[j + 1] > row[j] else row[j]
                if w and before[j] + w > best:
                    best = before[j] + w
                row.append(best)
            rows.append(row)
            cells.append(found)
        pairs: list = []
        i, j = len(xs), n
        while i and j:
            w, pair = cells[i - 1][j - 1]
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                pairs += pair or [(xs[i - 1][2], ys[j - 1][2])]
                i, j = i - 1, j - 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return rows[-1][n], pairs

    return align(left, right)[1]
