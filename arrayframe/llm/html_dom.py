"""A small HTML tree for operator 3: block nodes, their text runs and features.

Forgiving, never failing: unclosed and stray tags, cut documents, comments,
raw-text elements and implied ends (p, li, cells) are handled as browsers do in
the common cases. Character references are decoded once.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np

#: Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCK = frozenset(
    "html body article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table caption tbody td tfoot th thead tr ul address button label".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element whose start ends an open element of the second set, up to one of the third.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Words of class, id and role values that speak against and for the main text.
AGAINST = frozenset(
    "ad ads advert advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot copyright legal sidebar side aside widget related recommended popular trending share social sharing comment comments reply replies discussion respond disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login form search pagination pager tags meta byline toolbar toc skip hidden contentinfo complementary".split()
)
FOR = frozenset("article content main post entry story body text blog page prose hentry articlebody markdown".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z))", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_WORD = re.compile(r"[a-z]+")
_CASED = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Node:
    """A block element, or a run of text between blocks (tag '')."""

    __slots__ = ("tag", "parent", "children", "depth", "against", "for_", "text", "linked", "items", "marks")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.against = self.for_ = self.linked = self.items = self.marks = 0
        self.text = ""


def tokens_of(attributes: str) -> tuple[int, int]:
    """How many words of class, id and role speak against and for the main text."""
    against = for_ = 0
    for name, a, b, c in _ATTR.findall(attributes):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            words = set(_WORD.findall(_CASED.sub(" ", a or b or c).lower()))
            against += len(words & AGAINST)
            for_ += len(words & FOR)
    return against, for_


def parse(source: str) -> Node:
    """The tree of block nodes; each text run is a leaf of its own below the block that holds it."""
    root = Node("html", None)
    stack: list[tuple[str, Node | None]] = [("html", root)]  # element, and its node where it is a block
    blocks = [root]
    opened: Counter[str] = Counter()  # of the stack's elements: nothing is searched for that is not open
    parts: list[str] = []
    linked = items = 0
    in_link = 0

    def close_run() -> None:
        nonlocal linked, items
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                leaf = Node("", blocks[-1])
                leaf.text, leaf.linked, leaf.items = text, linked, items
                blocks[-1].children.append(leaf)
            parts.clear()
        linked = items = 0

    def pop() -> None:
        nonlocal in_link
        tag, node = stack.pop()
        opened[tag] -= 1
        if tag == "a":
            in_link = max(0, in_link - 1)
        if node is not None:
            close_run()
            blocks.pop()

    at, size = 0, len(source)
    while at < size:
        found = _TAG.search(source, at)
        text = source[at : found.start() if found else size]
        if text:
            decoded = html.unescape(text) if "&" in text else text
            parts.append(decoded)
            if in_link:
                linked += len(decoded.strip())
        if not found:
            break
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            if tag in ("html", "body") or not opened[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break
            continue
        if tag in RAW and not found[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else size
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag == "head":
            end = re.compile(r"</head\s*>|<body\b", re.I).search(source, at)
            if end:
                at = end.end() if end[0][1] == "/" else end.start()
            continue
        if tag in ("html", "body"):
            continue
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1) if any(opened[e] for e in ends) else ():
                if stack[k][0] in until:
                    break
                if stack[k][0] in ends:
                    while len(stack) > k:
                        pop()
                    break
        if opened["p"] and tag in BLOCK and tag != "button" and tag != "label":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][1] is not None:
                    break
        if tag in VOID:
            if tag == "hr":
                close_run()
            continue
        if tag in BLOCK:
            close_run()
            node = Node(tag, blocks[-1])
            node.against, node.for_ = tokens_of(found[3]) if found[3].strip() else (0, 0)
            blocks[-1].children.append(node)
            blocks.append(node)
            stack.append((tag, node))
            opened[tag] += 1
        else:
            items += 1
            in_link += tag == "a"
            stack.append((tag, None))
            opened[tag] += 1
    while len(stack) > 1:
        pop()
    close_run()
    return root


#: Element groups that are features of a node and of its ancestors.
KINDS = (("nav",), ("footer", "address"), ("header", "hgroup"), ("aside",), ("article", "main"), ("form", "fieldset", "select", "button", "label", "option", "legend", "dialog"), ("ul", "ol", "menu", "dl"), ("table", "tr", "td", "th"), ("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("div", "section"), ("blockquote", "pre", "figure", "figcaption"), ("",), ("li", "dt", "dd"))
_KIND = {t: i for i, k in enumerate(KINDS) for t in k}
_BITS = np.arange(len(KINDS))


class Nodes:
    """The nodes of a page in page order, as columns that ``feature_rows`` turns into features."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.parent: list[int] = []
        todo = [(root, 0)]
        nodes, parent = self.nodes, self.parent
        while todo:
            n, up = todo.pop()
            at = len(nodes)
            nodes.append(n)
            parent.append(up)
            todo.extend([(c, at) for c in reversed(n.children)])
        size = len(nodes)
        chars, linked, items, leaves, paragraphs, stops, count = ([0] * size for _ in range(7))
        kind, above, against, for_ = ([0] * size for _ in range(4))
        before, at_sibling, siblings, previous, following = ([0] * size for _ in range(5))
        passed = 0
        for i, n in enumerate(nodes):
            up = parent[i]
            before[i] = passed
            if n.tag:
                paragraphs[i] = n.tag == "p"
            else:
                chars[i] = len(n.text)
                passed += chars[i]
                linked[i], items[i], leaves[i] = n.linked, n.items, 1
                stops[i] = n.text.count(".") + n.text.count(",")
            count[i] = 1
            kind[i] = 1 << _KIND.get(n.tag, 10)
            if i:
                above[i] = above[up] | kind[up]
                against[i], for_[i] = against[up] + nodes[up].against, for_[up] + nodes[up].for_
        for i in range(size - 1, 0, -1):
            up = parent[i]
            chars[up] += chars[i]
            linked[up] += linked[i]
            items[up] += items[i]
            leaves[up] += leaves[i]
            paragraphs[up] += paragraphs[i]
            stops[up] += stops[i]
            count[up] += count[i]
        last: dict[int, int] = {}
        for i in range(1, size):
            up = parent[i]
            j = last.get(up)
            if j is not None:
                at_sibling[i] = at_sibling[j] + 1
                previous[i] = chars[j]
                following[j] = chars[i]
            last[up] = i
        for i in range(size):
            siblings[i] = len(nodes[parent[i]].children) if i else 1
        self.columns = (chars, linked, items, leaves, paragraphs, stops, count, before, at_sibling, siblings, previous, following, kind, above, against, for_, [n.depth for n in nodes], [len(n.children) for n in nodes], [n.against for n in nodes], [n.for_ for n in nodes], [chars[0]] * size)


def feature_rows(pages: list[Nodes]) -> np.ndarray:
    """A row of features for each node of the pages."""
    if not pages:
        return np.zeros((0, 0), dtype=np.float32)
    sizes = np.array([len(p.nodes) for p in pages])
    up = np.concatenate([p.parent for p in pages]) + np.repeat(np.cumsum(sizes) - sizes, sizes)
    chars, linked, items, leaves, paragraphs, stops, count, before, at, siblings, previous, following, kind, above, against, for_, depth, children, own_against, own_for, total = (np.concatenate([p.columns[k] for p in pages]).astype(np.float64 if k not in (12, 13) else np.int64) for k in range(21))
    over = np.maximum(1.0, chars)
    stop = stops / over * 100
    mean = chars / np.maximum(1.0, leaves)
    total = np.maximum(1.0, total)
    flags = [(c[:, None] >> _BITS & 1) for c in (kind, above)]
    columns = (
        np.log1p(chars), linked / over, items / np.maximum(1.0, leaves), leaves, paragraphs, mean, chars / count, stop,
        depth, siblings, at / np.maximum(1.0, siblings - 1), np.log1p(previous), np.log1p(following), chars / total, before / total, children,
        chars / over[up], paragraphs[up], (linked / over)[up], np.log1p(chars)[up], stop[up], mean[up],
        own_against, own_for, against, for_,
    )
    return np.concatenate([np.stack(columns, axis=1), *flags], axis=1).astype(np.float32)
