"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from hashlib import blake2b
from html import unescape
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, ship
from .urls import host_and_path

#: A leaf is template if it says the same on this share of the layout's pages that have it, of so many pages
#: at least, and of this share of all its pages that differ from the reference. With fewer pages, all must agree.
SAME = 0.9
LEAST_PAGES = 5
LEAST_SHARE = 0.5
#: A layout with so many pages has a reference of its own.
LAYOUT_PAGES = 10
#: Reference pages, in bytes, that are sent to every task; more of them meet the pages in a shuffled join.
SENT_BYTES = 16 << 20
#: Larger tables of pairs are kept in part and made again; more than the texts of any page.
CELLS = 1 << 20
TEXTS = 1 << 24

ship(__name__)

# Elements by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("head title script style noscript template svg math canvas iframe object embed audio video map datalist".split())
BOILERPLATE = frozenset("nav footer aside form button select textarea fieldset menu dialog".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("html body table ul ol dl div article section main nav aside header footer form blockquote td th li".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist respond replies disqus share sharing "
    "social related recommended newsletter subscribe subscription signup login popup modal overlay paywall toolbar widget widgets pagination pager skip".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|title|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|$)|<[!?/][^>]*(?:>|$)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
#: Class, id and role values of the element that holds the content where there is no article.
CONTENT = frozenset("content main article post entry story main-content page-content post-content entry-content article-content article-body post-body story-body maincontent".split())
NAME_PART = re.compile(r"[a-z0-9]+")


class Node:
    """An element, or a leaf of text. kind: what must agree for two nodes to match. shape: a hash of the
    kinds of the tree below; full: with its texts."""

    __slots__ = ("kind", "tag", "dropped", "header", "main", "children", "text", "linked", "index", "size", "shape", "full", "number")

    def __init__(self, kind: str, tag: str, dropped: bool = False):
        self.kind, self.tag, self.dropped = kind, tag, dropped
        self.header, self.main = tag == "header", tag == "main"
        self.children: list[Node] = []
        self.text, self.linked, self.index, self.size = "", 0, -1, 1
        self.shape = self.full = self.number = 0


#: Start tags that a task has read lately, and what they mean.
TAGS: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}


def meaning(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Of a start tag: kind, dropped, header, main."""
    kind, dropped, header, main = tag, tag in BOILERPLATE or tag in SKIPPED, tag == "header", tag == "main"
    if attributes and ("=" in attributes or "hidden" in attributes):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                kind += f" {name}={value}" if name == "class" else ""
                if tag not in ("html", "body", "article", "main"):
                    parts = NAME_PART.findall(value)
                    dropped = dropped or not MARKED.isdisjoint(parts)
                    header = header or "header" in parts
                    main = main or not CONTENT.isdisjoint(value.split())
            elif name == "role":
                dropped, main = dropped or value in ROLES, main or value == "main"
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                dropped = True
    return kind, dropped, header, main


def opened(tag: str, attributes: str) -> Node:
    if (found := TAGS.get((tag, attributes))) is None:
        found = meaning(tag, attributes)
        if len(attributes) <= 200:
            if len(TAGS) >= 4096:
                TAGS.clear()
            TAGS[tag, attributes] = found
    node = Node(found[0], tag, found[1])
    _, _, node.header, node.main = found
    return node


def in_order(root: Node) -> list[Node]:
    """All nodes of a tree, parents first; their places are their numbers."""
    out, stack = [], [root]
    while stack:
        out.append(n := stack.pop())
        if n.children:
            stack += n.children[::-1]
    return out


def headed(root: Node) -> set[int]:
    """Which nodes have a heading, by id: one pass over the tree, from below."""
    found: set[int] = set()
    nodes = in_order(root)
    if any([n.tag == "h1" for n in nodes]):
        for n in reversed(nodes):
            if n.tag == "h1" or n.children and not found.isdisjoint([id(c) for c in n.children]):
                found.add(id(n))
    return found


def parse(html: str) -> tuple[Node, list[Node]]:
    """The tree of a page's block elements, and its leaves of text in page order.

    Inline elements belong to the text around them. A start tag ends what HTML lets it end; an end tag
    without a start is nothing; what is open at the end of the page ends there. Scripts, styles and
    comments are no text. Character references are decoded; white space becomes single spaces. Elements
    may be nested to any depth.
    """
    root = Node("#root", "#root")
    stack, leaves, pieces, links, linked = [root], [], [], 0, 0
    opens: dict[str, list[int]] = {}  # where on the stack each kind of tag is open
    fences: list[int] = []

    def close(at: int) -> None:
        while len(stack) > at:
            opens[stack.pop().tag].pop()
        while fences and fences[-1] >= at:
            fences.pop()

    def flush() -> None:
        nonlocal linked
        text = " ".join((pieces[0] if len(pieces) == 1 else "".join(pieces)).split())
        pieces.clear()
        if text:
            leaf = Node("#text", "#text")
            leaf.text, leaf.linked, leaf.index = text, linked, len(leaves)
            leaves.append(leaf)
            stack[-1].children.append(leaf)
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(text.strip())

    at = 0
    for m in TOKEN.finditer(html):
        start, end = m.span()
        if at < start:
            said(html[at:start])
        at = end
        ends, tag, attributes = m.group("end", "tag", "attributes")
        if tag is None:
            continue
        tag = tag.lower()
        if tag in VOID and tag != "hr":
            pieces.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links + (-1 if ends else 1))
            continue
        if pieces:
            flush()
        if ends:
            if (at_tag := opens.get(tag)) and (tag in FENCE or not fences or fences[-1] < at_tag[-1]):
                close(at_tag[-1])
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            close(len(stack) - 1)
        if closes := SAME_CLOSES.get(tag):
            last = max((opens[c][-1] for c in closes if opens.get(c)), default=-1)
            if last >= max(1, fences[-1] if fences else 0):
                close(last)
        if tag == "hr":
            continue
        node = opened(tag, attributes)
        stack[-1].children.append(node)
        opens.setdefault(tag, []).append(len(stack))
        if tag in FENCE:
            fences.append(len(stack))
        stack.append(node)
        links = 0
    if at < len(html):
        said(html[at:])
    flush()

    leaf = hash(("#text",))
    for n in reversed(in_order(root)):
        if n.children:
            n.size = 1 + sum([c.size for c in n.children])
            n.shape = hash((n.kind, *[c.shape for c in n.children]))
            n.full = hash((n.kind, n.text, *[c.full for c in n.children]))
        else:
            n.shape = leaf if n.kind == "#text" else hash((n.kind,))
            n.full = hash((n.kind, n.text))
    return root, leaves


def paired(n: int, m: int, weights: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """The heaviest pairs of n things in a row and m others, orders kept; weights(i): those of i with each of the m.

    Rows of the table are kept at every step only, and made again on the way back.
    """
    step = n if n * m <= CELLS else isqrt(n) + 1

    def rows(row: np.ndarray, start: int, end: int) -> Iterator[np.ndarray]:
        for i in range(start, end):
            new = row.copy()
            np.maximum(row[1:], row[:-1] + weights(i), out=new[1:])
            row = np.maximum.accumulate(new, out=new)
            yield row

    row = np.zeros(m + 1, np.int64)
    kept = [row]
    for start in range(0, n - step, step):
        for row in rows(kept[-1], start, start + step):
            pass
        kept.append(row)
    out, j = [], m
    for k in range(len(kept) - 1, -1, -1):
        start, end = k * step, min(n, (k + 1) * step)
        table = [kept[k], *rows(kept[k], start, end)]
        for i in range(end - 1, start - 1, -1):
            above, here = table[i - start], table[i - start + 1]
            if here[j] == above[j]:
                continue
            j = int(np.searchsorted(here[: j + 1], here[j]))  # the first place with this value: it is paired there
            j -= 1
            out.append((i, j))
    return out[::-1]


def common_ends(left: list, right: list) -> tuple[int, int]:
    """How many things are equal at the front, and how many of the others at the back."""
    least = min(len(left), len(right))
    front = next((i for i in range(least) if left[i] != right[i]), least)
    least -= front
    return front, next((i for i in range(least) if left[-1 - i] != right[-1 - i]), least)


def most_nodes(a: Node, b: Node, known: dict[tuple[int, int], int]) -> int:
    """The most nodes of two trees that pair up with their kinds, order and parents kept. known: by shapes."""
    if a.kind != b.kind:
        return 0
    if a.shape == b.shape:
        return a.size
    if not a.children or not b.children:
        return 1
    if (found := known.get((a.shape, b.shape))) is None:
        front, back = common_ends([x.shape for x in a.children], [x.shape for x in b.children])
        left, right = a.children[front : len(a.children) - back], b.children[front : len(b.children) - back]
        found = 1 + sum(x.size for x in a.children[:front]) + sum(x.size for x in a.children[len(a.children) - back :])
        if left and right:
            weigh = weights_of(left, right, known)
            row = np.zeros(len(right) + 1, np.int64)
            for i in range(len(left)):
                new = row.copy()
                np.maximum(row[1:], row[:-1] + weigh(i), out=new[1:])
                row = np.maximum.accumulate(new)
            found += int(row[-1])
        known[a.shape, b.shape] = found
    return found


def weights_of(left: list[Node], right: list[Node], known: dict[tuple[int, int], int]) -> Callable[[int], np.ndarray]:
    """The matching nodes of a left child with each of the right ones."""
    shapes: dict[int, int] = {}
    place = np.array([shapes.setdefault(y.shape, len(shapes)) for y in right])
    some = list({y.shape: y for y in reversed(right)}.values())
    some.sort(key=lambda y: shapes[y.shape])
    rows: dict[int, np.ndarray] = {}

    def weigh(i: int) -> np.ndarray:
        x = left[i]
        if x.shape not in rows:
            rows[x.shape] = np.array([most_nodes(x, y, known) for y in some], np.int64)[place]
        return rows[x.shape]

    return weigh


def texts(n: Node) -> set[str]:
    if not n.children:
        return {n.text} if n.kind == "#text" else set()
    if len(n.children) == 1 and n.children[0].kind == "#text":
        return {n.children[0].text}
    return {x.text for x in in_order(n) if x.kind == "#text"}


def only_pairs(left: list[str], right: list[str]) -> list[tuple[int, int]] | None:
    """All pairs of one kind, if no kind comes twice on a side and the kinds of both come in one order: then no other pairing has as many nodes, and
    neither nodes nor texts below need be counted. None otherwise."""
    where = {k: j for j, k in enumerate(right)}
    pairs = [(i, where[k]) for i, k in enumerate(left) if k in where]
    alone = len(set(left)) == len(left) and len(where) == len(right)
    return pairs if alone and all(p[1] < q[1] for p, q in zip(pairs, pairs[1:])) else None


def matching(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most nodes of two trees that pair up with their kinds, order and parents
    kept, and the pairs. Of pairings of children with as many nodes, one with the most texts in common."""
    known: dict[tuple[int, int], int] = {}
    out: list[tuple[Node, Node]] = []
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000 + 4 * a.size))

    def whole(x: Node, y: Node) -> None:
        out.append((x, y))
        if len(x.children) == 1 and not x.children[0].children:
            out.append((x.children[0], y.children[0]))
        elif x.children:
            out.extend(zip(in_order(x)[1:], in_order(y)[1:]))

    stack = [(a, b)] if a.kind == b.kind else []
    while stack:
        x, y = stack.pop()
        if x.shape == y.shape:
            whole(x, y)
            continue
        out.append((x, y))
        front, back = common_ends([c.full for c in x.children], [c.full for c in y.children])
        left, right = x.children[front : len(x.children) - back], y.children[front : len(y.children) - back]
        for p, q in zip(x.children[:front], y.children[:front]):
            whole(p, q)
        for p, q in zip(x.children[len(x.children) - back :], y.children[len(y.children) - back :]):
            whole(p, q)
        if len(left) == len(right) == 1:
            if left[0].kind == right[0].kind:
                stack.append((left[0], right[0]))
        elif (only := only_pairs([c.kind for c in left], [c.kind for c in right])) is not None:
            stack.extend((left[i], right[j]) for i, j in only)
        elif left and right:
            weigh = weights_of(left, right, known)
            where: dict[str, list[int]] = {}
            for j, q in enumerate(right):
                for t in texts(q):
                    where.setdefault(t, []).append(j)

            def with_texts(i: int) -> np.ndarray:
                nodes = weigh(i)
                row = nodes * TEXTS
                for t in texts(left[i]):
                    for j in where.get(t, ()):
                        row[j] += nodes[j] > 0
                return row

            stack.extend((left[i], right[j]) for i, j in paired(len(left), len(right), with_texts))
    return len(out), out


def content(root: Node, template: set[int], slot: Node | None = None) -> str:
    """The varying text of a page. template: leaves that belong to the wrapper.

    slot: the element in which the host's pages vary, read as a whole, after the heading if that stands
    before it. Without one, or if it has no text, tags choose: article elements if there are any, else the
    outermost element that is marked as the content, else the whole page without blocks that are mostly
    links. A header inside the article stays if it has the heading.
    """
    with_heading = headed(root)
    roots: dict[str, list[Node]] = {"slot": [slot] if slot else [], "article": [], "main": [], "#root": [root]}

    stack = [root]
    while stack:
        n = stack.pop()
        if n.dropped:
            continue
        if n.tag == "article":
            roots["article"].append(n)
            continue
        if n.main:
            roots["main"].append(n)
        stack.extend(reversed(n.children))
    blocks: list[str] = []

    def read(top: Node, whole: bool) -> None:
        stack = [top]
        while stack:
            n = stack.pop()
            if n.dropped or n.header and (whole or id(n) not in with_heading):
                continue
            if n.kind == "#text":
                if n.index not in template and not (whole and 2 * n.linked > len(n.text)):
                    blocks.append(n.text)
            stack.extend(reversed(n.children))

    for kind in roots:
        for n in roots[kind][: None if kind != "main" else 1]:
            read(n, kind == "#root" or kind == "slot" and not (n.main or n.tag == "article"))
        if blocks:
            if kind == "slot" and id(slot) not in with_heading and (h := heading_before(root, slot)):
                blocks[:0] = [t.text for t in leaves_below(h) if t.index not in template]
            break
    return " ".join(blocks)


def leaves_below(n: Node) -> list[Node]:
    return [x for x in in_order(n) if x.kind == "#text"]


def heading_before(root: Node, slot: Node) -> Node | None:
    """The last h1 before an element, not in an article or a dropped element."""
    last, stack = None, [root]
    while stack:
        n = stack.pop()
        if n is slot:
            return last
        if n.dropped or n.tag == "article":
            continue
        if n.tag == "h1":
            last = n
            continue
        stack.extend(reversed(n.children))
    return None


def varying(page: Node, met: dict[int, tuple[int, bool]]) -> Iterator[tuple[int, Node]]:
    """The leaves of a page that are not in the reference, or say something else there, each with the number
    of the reference's node that it meets or in which it stands. Dropped elements are left out.
    met: by id of a page's node, the number of the reference's node and whether both say the same."""
    stack = [(page, 0)]
    while stack:
        n, at = stack.pop()
        if n.dropped:
            continue
        at, same = met.get(id(n), (at, False))
        if n.kind == "#text" and not same:
            yield at, n
        stack.extend((c, at) for c in n.children)


def slot_of(root: Node, weights: dict[int, int]) -> int:
    """The number of the reference's element that holds the content, -1 if tags are to tell.

    weights: characters by node in which pages vary. From the root down it is the element with more than half of them,
    as deep as there is one; an article, or else an element marked as content, around it goes with it. If no
    element below the body has so many, the body is read as a whole unless articles or marked elements have half.
    """
    nodes = in_order(root)
    number = {id(n): i for i, n in enumerate(nodes)}
    sums = [weights.get(i, 0) for i in range(len(nodes))]
    for i in range(len(nodes) - 1, -1, -1):
        sums[i] += sum([sums[number[id(c)]] for c in nodes[i].children])
    total, at, way = sums[0], root, []
    if not total:
        return -1
    while True:
        way.append(at)
        best = max(at.children, key=lambda c: sums[number[id(c)]], default=None)
        if best is None or 2 * sums[number[id(best)]] <= total or not (best.tag == "article" or any(c.kind != "#text" for c in best.children)):
            break
        at = best
    for marked in ([n for n in way if n.tag == "article"], [n for n in way if n.main]):
        if marked:
            return number[id(marked[0])]

    held, stack = 0, [at]
    while stack:
        n = stack.pop()
        if n.tag == "article" or n.main:
            held += 0 if n.dropped else sums[number[id(n)]]
        elif not n.dropped:
            stack.extend(n.children)
    return -1 if 2 * held >= sums[number[id(at)]] else number[id(at)]


def layout(html: Column) -> Column:
    """A hash of the kinds of block elements on a page, each once: tag and class, digits aside."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:article|aside|div|footer|form|header|main|nav|section|table)\b[^>]*>)"), F.lit(1))
    name = lambda x: F.lower(F.concat(F.regexp_extract(x, r"^<(\w+)", 1), F.lit(" "), F.regexp_extract(x, r"(?i)\bclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, lambda x: F.regexp_replace(name(x), r"\d+", "#")))))


def references(pages: DataFrame) -> DataFrame:
    """One page of each group of a host's pages, the least by a hash: host, layout, grp, reference.

    pages: host, layout, url, html. A layout of LAYOUT_PAGES pages is a group; the pages of smaller ones are one
    together (layout null), if they are so many or the host has no large layout, else they go with its largest.
    """
    best = F.struct(F.xxhash64("url", "html").alias("h"), F.col("html"))
    found = cut(pages.where("host <> '' AND html IS NOT NULL").groupBy("host", "layout").agg(F.count("*").alias("n"), F.min(best)["html"].alias("reference")))
    large = F.col("n") >= LAYOUT_PAGES
    own = found.where(large).select("host", "layout", "reference")
    small = F.sum(F.when(~large, F.col("n")).otherwise(0))
    rest = found.groupBy("host").agg(small.alias("small"), F.max(F.when(large, F.struct("n", "layout", "reference"))).alias("big"), F.min(F.when(~large, F.struct(F.xxhash64("reference").alias("h"), F.col("reference")))).alias("one"))
    alone = (F.col("small") >= LAYOUT_PAGES) | F.col("big").isNull()
    rest = rest.select("host", F.lit(None).cast("long").alias("layout"), F.when(alone, F.lit(None)).otherwise(F.col("big.layout")).alias("as"), F.when(alone, F.col("one.reference")).otherwise(F.col("big.reference")).alias("reference"))
    group = lambda x: F.concat_ws("\n", "host", x.cast("string"))
    return own.select("host", "layout", group(F.col("layout")).alias("grp"), "reference").unionByName(rest.select("host", "layout", group(F.col("as")).alias("grp"), "reference")).where("reference IS NOT NULL")


def with_references(pages: DataFrame, references: DataFrame) -> DataFrame:
    """Each page beside its group's row of references."""
    size = references.agg(F.coalesce(F.sum(F.octet_length("reference")), F.lit(0))).first()[0]
    sent = (lambda x: F.broadcast(x)) if size <= SENT_BYTES else (lambda x: x)
    known = references.where("layout IS NOT NULL").select("host", "layout", F.lit(True).alias("own"))
    pages = pages.join(sent(known), ["host", "layout"], "left").withColumn("layout", F.when(F.col("own"), F.col("layout")))
    named = references.withColumnsRenamed({"host": "its_host", "layout": "its_layout"})
    return pages.join(sent(named), (F.col("host") == F.col("its_host")) & F.col("layout").eqNullSafe(F.col("its_layout")), "left")


class References:
    """Parsed reference pages of the hosts that a task has just seen: their nodes in order, leaves and slots."""

    def __init__(self):
        self.kept: dict[str, tuple[list[Node], list[Node], int]] = {}

    def get(self, host: str, html: str, weights: list[dict] | None = None) -> tuple[list[Node], list[Node], int]:
        if host not in self.kept:
            if len(self.kept) >= 256:
                self.kept.pop(next(iter(self.kept)))
            root, leaves = parse(html)
            for i, n in enumerate(in_order(root)):
                n.number = i
            self.kept[host] = in_order(root), leaves, slot_of(root, {w["node"]: w["varying"] for w in weights or ()})
        return self.kept[host]


def met_nodes(nodes: list[Node], page: Node) -> dict[int, tuple[int, bool]]:
    """nodes: a reference's, numbered. By id of a page's node: the number of the reference's node that it meets, and whether both are leaves of one text."""
    return {id(y): (x.number, x.kind == "#text" and x.text == y.text) for x, y in matching(nodes[0], page)[1]}


def undropped(top: Node) -> Iterator[Node]:
    stack = [top]
    while stack:
        n = stack.pop()
        if n.kind == "#text" and not n.dropped:
            yield n
        if not n.dropped:
            stack.extend(n.children)


def keys(page: Node) -> dict[int, int]:
    """Hashes of the kinds down to each leaf and its text, by number of the leaf."""
    out, stack, known = {}, [(page, b"")], {}
    digest = lambda above, said: blake2b(above + said.encode("utf-8", "replace"), digest_size=8).digest()
    while stack:
        n, above = stack.pop()
        if n.kind == "#text":
            out[n.index] = int.from_bytes(digest(above, n.text), "big", signed=True)
        elif n.children:
            if (here := known.get(at := (above, n.kind))) is None:
                here = known[at] = digest(above, n.kind)
            for c in n.children:
                stack.append((c, here))
    return out


def wrappers(pages: DataFrame) -> DataFrame:
    """The wrapper of every group whose pages differ: grp, template (numbers of the reference's leaves among
    its nodes), weights (node, varying: characters in which pages vary there), more (what the reference lacks).

    pages: grp, html, reference. Every page is aligned with its group's reference; pages with the same text
    as the reference say nothing and do not count. A task adds up the nodes of each group before the shuffle.
    In a group of fewer than LEAST_PAGES such pages, a leaf is template if all say the same, unless one of
    them is a near copy, with half of its text from the reference. A leaf that the reference lacks is
    template by path and text, if LEAST_SHARE of the pages have it; pages with the same longest leaf beside it
    count once, so that copies are no template.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = References()
        counts: dict[str, np.ndarray] = {}
        others: set[tuple[str, int, int]] = set()

        def done() -> pa.RecordBatch:
            rows = [(h, node - 1, 0, *map(int, c[node])) for h, c in counts.items() for node in range(len(c)) if c[node].any()]
            rows += [(h, -2, key, beside, 0, 0) for h, key, beside in others]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["grp", "node", "key", "matched", "same", "varying"])

        for b in batches:
            for group, html, reference in zip(*(b.column(i).to_pylist() for i in range(3))):
                own, own_leaves, _ = references.get(group, reference)
                page, leaves = parse(html)
                if [x.text for x in leaves] == [x.text for x in own_leaves]:
                    continue
                c = counts.setdefault(group, np.zeros((len(own) + 1, 3), np.int64))  # row 0: the pages
                c[0, 0] += 1
                met = met_nodes(own, page)
                for x in leaves:
                    if id(x) in met:
                        at, same = met[id(x)]
                        c[at + 1, :2] += (1, same)
                new = list(varying(page, met))
                for at, x in new:
                    c[at + 1, 2] += len(x.text)
                said = sum(len(x.text) for x in undropped(page))
                c[0, 1] += 2 * sum(len(x.text) for _, x in new) <= said
                names = keys(page)
                longest = sorted({(len(x.text), names[x.index]) for _, x in new}, reverse=True)[:2]
                for key in {names[x.index] for _, x in new}:
                    beside = [k for _, k in longest if k != key]
                    if beside:
                        others.add((group, key, beside[0]))
            if len(counts) > 2000 or len(others) > 200_000:
                yield done()
                counts.clear()
                others.clear()
        yield done()

    found = pages.where("reference IS NOT NULL AND html IS NOT NULL").select("grp", "html", "reference").mapInArrow(task, "grp string, node int, key long, matched long, same long, varying long")
    # by node, the sums; by leaf that the reference lacks, the leaves beside it, each once
    found = cut(found.groupBy("grp", "node", "key", F.when(F.col("node") == -2, F.col("matched")).alias("beside")).agg(*(F.sum(F.when(F.col("node") >= -1, F.col(c))).alias(c) for c in ("matched", "same", "varying"))))
    total = found.where("node = -1").select("grp", F.col("matched").alias("pages"), (F.col("same") == 0).alias("apart"))
    fixed = (F.col("matched") >= F.greatest(F.lit(LEAST_PAGES), LEAST_SHARE * F.col("pages"))) & (F.col("same") >= SAME * F.col("matched"))
    fixed |= (F.col("pages") < LEAST_PAGES) & F.col("apart") & (F.col("same") == F.col("pages"))
    template = F.collect_list(F.when(fixed, F.col("node"))).alias("template")
    weights = F.collect_list(F.when(F.col("varying") > 0, F.struct("node", "varying"))).alias("weights")
    lacking = found.where("node = -2").groupBy("grp", "key").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES).join(total, "grp")
    lacking = lacking.where(F.col("n") >= LEAST_SHARE * F.col("pages")).groupBy("grp").agg(F.collect_list("key").alias("more"))
    return found.where("node >= 0").join(total, "grp").groupBy("grp").agg(template, weights).join(lacking, "grp", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: id, url, text.

    The wrapper of a host is learnt from all its pages, by layout (see references and wrappers). It tells in which element the text
    varies (see slot_of), and what a page shares with the others at the same place is template and goes, as do
    menus, footers, forms and other elements that are marked as no part of the article. Null and empty html
    have an empty text, as has a page without content. Pages without a host, and those of a host with few
    pages, are read without a wrapper. Repeated rows stay.
    """
    host, _ = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), layout(F.col(html_col)).alias("layout"), F.col(html_col).alias("html"))
    chosen = cut(references(rows))
    found = wrappers(with_references(rows, chosen))
    both = cut(chosen.join(found, "grp", "left"))
    schema = T.StructType([rows.schema["id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = References()
        for b in batches:
            texts = []
            for group, html, reference, template, weights, more in zip(*(b.column(i).to_pylist() for i in range(2, 8))):
                page, _ = parse(html or "")
                fixed: set[int] = set()
                slot = None
                if template or weights:
                    own, _, slot_at = references.get(group, reference, weights)
                    known = set(template or ())
                    for n in in_order(page) if (met := met_nodes(own, page)) else ():
                        at, same = met.get(id(n), (-1, False))
                        if same and at in known:
                            fixed.add(n.index)
                        if at == slot_at >= 0:
                            slot = n
                if more:
                    every = set(more)
                    fixed |= {i for i, key in keys(page).items() if key in every}
                texts.append(content(page, fixed, slot))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=schema.names)

    return with_references(rows, both).select("id", "url", "grp", "html", "reference", "template", "weights", "more").mapInArrow(task, schema)
