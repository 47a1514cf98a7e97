"""Main text of HTML pages by wrapper induction.

A page is parsed into a tree of its block elements; neighbours with the same tag and classes
are merged into one repeated node.  The trees of a host's pages are aligned by simple tree
matching (the best order-preserving match of children, subtree by subtree) and united into
the host's wrapper, so every node of every page has a slot in it.  What a slot is gets decided
once for the host, from all its different pages:

* A slot whose text is nearly always the same is template.
* A varying slot's weight is the text outside links that it holds over all pages; a slot that is
  mostly links weighs nothing.  From the root on, the wrapper is descended as long as one subtree
  holds nearly all weight: that is the content region.  Menus, adverts and footers vary, too, but
  lie outside it.
* Within the region, subtrees of links are left out, and slots that the pages' own marks (element,
  role, class) name as comments, forms, asides and the like, which no statistic can tell from
  paragraphs.  Outside of it marks only break ties: text marked in this way weighs little, and text
  marked as the article much.

A page's text is that of its nodes whose slots are content.  A page is read by its host's wrapper
alone; its own marks don't matter any more.

Every page counts in the statistics, exact copies of a page once.  Trees are kept as strings
and only their distinct forms are aligned, in groups by host and part of a hash, then by host.

Defined results: null or empty html gives an empty text.  A null url, or one without a host,
belongs to the host ''.  On a host with fewer than MIN_PAGES different pages no slot is template;
weights and marks decide.  Repeated rows each give a row.  Columns other than the three are
ignored.  An unclosed element ends where its parent ends; inline elements don't end blocks.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .url_filter import host_of

#: A slot is template if this share of at least MIN_PAGES different pages has one text there.
CONSTANT = 0.9
MIN_PAGES = 4
SALTS = 16
#: A subtree with this share of a node's weight is descended into, if no more than OWN is the node's own.
NEARLY_ALL, OWN = 0.75, 0.05
#: A slot or subtree with this share of its text in links is a list of links.
LINKED = 0.5
#: Factors on the weight of what the pages mark as left out and as the article.
MARKED, ARTICLE = 0.1, 4.0
#: Bytes of wrapper rows that are told to all tasks; more are joined by host.
TOLD_BYTES = 32_000_000
#: Lists of children whose table of matches has more cells are cut by their equal ends first.
LARGE = 1 << 16

# Element names of the HTML standard by how they behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SAME_END = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "thead": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"})}
LEFT_OUT = frozenset("head title nav footer aside form script style noscript template button select option optgroup datalist textarea iframe svg math canvas object audio video map menu dialog fieldset legend input search noembed noframes xmp".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar tablist form".split())
LEFT_OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer comment comments disqus reply replies respond related recommended recommendations share sharing social subscribe subscription newsletter signup login popup modal overlay widget widgets toolbar pagination pager copyright disclaimer legal skip search tags".split())
OUTSIDE_WORDS = frozenset("header masthead topbar top".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li blockquote pre table figure hr center".split())
ARTICLE_WORDS = frozenset("article post entry story content".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_WORD = re.compile(r"[a-z]+")


class Linked(str):
    """Text within a link."""


@dataclass
class Node:
    tag: str
    label: str = ""
    out: bool = False
    article: int = 0  # 2: article or main element, 1: a class that says so
    items: list = field(default_factory=list)  # nodes and texts, in order
    slot: int = -1


def _open(tag: str, attributes: str, inside: bool) -> Node:
    node = Node(tag, tag, tag in LEFT_OUT)
    values = {}
    if attributes.strip():
        values = {k.lower(): entities.unescape(next((v for v in vs if v), "")) for k, *vs in _ATTRIBUTE.findall(attributes)}
    classes = values.get("class", "").lower().split()
    if classes:
        node.label += "." + ".".join(sorted(set(re.sub(r"[^a-z_-]", "", c) for c in classes)))
    words = set(_WORD.findall(" ".join(classes) + " " + values.get("id", "").lower()))
    role = values.get("role", "").lower()
    article = tag in ("article", "main") or role in ("main", "article")
    node.article = 2 if article else 1 if words & ARTICLE_WORDS else 0
    if tag == "body":
        return node
    if words & LEFT_OUT_WORDS or role in LEFT_OUT_ROLES or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower():
        node.out = True
    if not inside and not article and (tag == "header" or words & OUTSIDE_WORDS and not node.article):
        node.out = True
    if node.out:
        node.label += "~"  # not merged with neighbours that aren't
    return node


def parse(text: str) -> Node:
    """The tree of block elements with its texts; inline elements leave only their texts."""
    root = Node("#root", "#root")
    stack = [root]
    at = 0
    inside = 0
    opened: Counter[str] = Counter()  # open elements by tag
    link = 0  # how deep the stack was where a link began

    def pop_to(depth: int) -> None:
        nonlocal inside, link
        while len(stack) > depth:
            node = stack.pop()
            inside -= node.article == 2
            opened[node.tag] -= 1
        if depth < link:
            link = 0

    def add(part: str) -> None:
        stack[-1].items.append(Linked(part) if link else part)

    end = len(text)
    while at < end:
        m = _TOKEN.search(text, at)
        if m is None:
            add(text[at:])
            break
        if m.start() > at:
            add(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = 0
            if tag in INLINE or tag in VOID and tag != "br":
                continue
            if tag == "br":
                stack[-1].items.append(" ")
                continue
            for depth in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
            continue
        if tag in INLINE:
            link = len(stack) if tag == "a" else link
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]|</{re.escape(tag)}\Z", re.I).search(text, at)
            at = text.find(">", close.end() - 1) + 1 if close else end
            at = at or end
            continue
        if tag in VOID:
            if tag != "wbr":
                stack[-1].items.append(" " if tag != "hr" else Node("hr", "hr"))
            continue
        if tag in ENDS_P and opened["p"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    pop_to(depth)
                    break
                if stack[depth].tag in ("div", "article", "section", "main", "td", "li", "body", "table"):
                    break
        if tag in SAME_END:
            same, stop = SAME_END[tag]
            for depth in range(len(stack) - 1, 0, -1) if any(opened[t] for t in same) else ():
                if stack[depth].tag in stop:
                    break
                if stack[depth].tag in same:
                    pop_to(depth)
                    break
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag == "body":
            pop_to(next((d for d, n in enumerate(stack) if n.tag == "head"), len(stack)))
        node = _open(tag, m[3], inside > 0)
        stack[-1].items.append(node)
        stack.append(node)
        opened[tag] += 1
        inside += node.article == 2
    return root


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


# -- wrapper trees: label and children, where neighbours with equal labels are one node.  They can
# be as deep as a page nests, so nothing here recurses.


class Tree:
    __slots__ = ("label", "children", "size", "key")

    def __init__(self, label: str, children: tuple[Tree, ...] = ()) -> None:
        self.label, self.children = label, children
        self.size = 1 + sum(c.size for c in children)
        #: Equal for equal trees.
        self.key = hashlib.blake2b(b"".join([*(c.key for c in children), label.encode("utf-8", "surrogatepass")]), digest_size=16, key=len(children).to_bytes(8, "big")).digest()


Known = dict  # sizes of matches by the trees' keys


def _score(a: Tree, b: Tree, known: Known) -> int | None:
    if a.label != b.label:
        return 0
    return a.size if a.key == b.key else known.get((a.key, b.key))


def matching(a: Tree, b: Tree, known: Known | None = None) -> int:
    """Size of the largest order-preserving match of two trees with equal roots (simple tree matching)."""
    known = {} if known is None else known
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        if _score(x, y, known) is not None:
            stack.pop()
        elif below := _unknown(x.children, y.children, known):
            stack += below
        else:
            known[x.key, y.key] = 1 + _aligned_lists(x.children, y.children, known)[0]
            stack.pop()
    return _score(a, b, known) or 0


def _ends(xs: tuple, ys: tuple) -> tuple[int, int]:
    """How many children at the start and at the end are equal one by one; ends are looked at in large lists only."""
    m, n = len(xs), len(ys)
    head = 0
    while head < min(m, n) and xs[head].key == ys[head].key:
        head += 1
    tail = 0
    if (m - head) * (n - head) > LARGE:
        while tail < min(m, n) - head and xs[m - 1 - tail].key == ys[n - 1 - tail].key:
            tail += 1
    return head, tail


def _unknown(xs: tuple, ys: tuple, known: Known) -> list[tuple[Tree, Tree]]:
    head, tail = _ends(xs, ys)
    return [(x, y) for x in xs[head : len(xs) - tail] for y in ys[head : len(ys) - tail] if _score(x, y, known) is None]


def _aligned_lists(xs: tuple, ys: tuple, known: Known) -> tuple[int, list[tuple[int, int]]]:
    """The best match of two lists of subtrees whose scores are known, and its pairs.  Equal starts go together in a best match."""
    head, tail = _ends(xs, ys)
    m, n = len(xs) - tail, len(ys) - tail
    below = [0] * (n + 1)
    steps: list[bytearray] = []  # 0: pair, 1: leave x out, 2: leave y out
    for i in range(m - 1, head - 1, -1):
        row, step, x = [0] * (n + 1), bytearray(n + 1), xs[i]
        for j in range(n - 1, head - 1, -1):
            s = _score(x, ys[j], known)
            both = below[j + 1] + s if s else -1
            row[j] = most = max(below[j], row[j + 1], both)
            step[j] = 0 if both == most else 1 if below[j] == most else 2
        below = row
        steps.append(step)
    pairs, i, j = [(k, k) for k in range(head)], head, head
    while i < m and j < n:
        step = steps[m - 1 - i][j]
        if step == 0:
            pairs.append((i, j))
        i, j = i + (step != 2), j + (step != 1)
    pairs += [(m + k, n + k) for k in range(tail)]
    return below[head] + sum(x.size for x in (*xs[:head], *xs[m:])), pairs


def _align(xs: tuple, ys: tuple, known: Known) -> list[tuple[int, int]]:
    for x, y in _unknown(xs, ys, known):
        matching(x, y, known)
    return _aligned_lists(xs, ys, known)[1]


def unite(a: Tree, b: Tree) -> Tree:
    """A tree in which both can be matched whole; the roots' labels are equal."""
    known: Known = {}
    jobs: list[list] = [[a, b, None]]  # two trees, then the parts of what unites them: trees and jobs
    for job in jobs:
        a, b, _ = job
        if a.key == b.key:
            continue
        parts, i, j = [], 0, 0
        for x, y in [*_align(a.children, b.children, known), (len(a.children), len(b.children))]:
            parts += a.children[i:x]
            parts += b.children[j:y]
            if x < len(a.children):
                jobs.append([a.children[x], b.children[y], None])
                parts.append(jobs[-1])
            i, j = x + 1, y + 1
        job[2] = parts
    for job in reversed(jobs):
        a, _, parts = job
        job[:] = [a if parts is None else Tree(a.label, tuple(p if isinstance(p, Tree) else p[0] for p in parts))]
    return jobs[0][0]


def _runs(nodes: list[Node]) -> list[list[Node]]:
    """The children of repeated nodes: neighbours with equal labels go together, and equal labels in order."""
    merged: list[list[Node]] = []
    for k, node in enumerate(nodes):
        mine: list[list[Node]] = []
        for item in node.items:
            if isinstance(item, Node):
                if mine and mine[-1][0].label == item.label:
                    mine[-1].append(item)
                else:
                    mine.append([item])
        if not k:
            merged = mine
            continue
        out, i = [], 0
        for run in mine:
            j = next((k for k in range(i, len(merged)) if merged[k][0].label == run[0].label), None)
            if j is None:
                out.append(run)
            else:
                out += merged[i:j]
                out.append(merged[j] + run)
                i = j + 1
        merged = out + merged[i:]
    return merged


def skeleton(root: Node) -> Tree:
    """The tree of a parsed page; each of the page's nodes gets its number in it, in preorder."""
    order: list[list] = []
    stack: list[list] = [[[root], []]]
    while stack:
        group = stack.pop()
        for n in group[0]:
            n.slot = len(order)
        order.append(group)
        group[1] = [[r, []] for r in _runs(group[0])]
        stack += reversed(group[1])
    for group in reversed(order):
        nodes, below = group
        group[:] = [Tree(nodes[0].label, tuple(g[0] for g in below))]
    return order[0][0]


def write_tree(t: Tree) -> str:
    out: list[str] = []
    stack: list[Tree | str] = [t]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append(x.label)
        if x.children:
            out.append("(")
            stack.append(")")
            for k, c in enumerate(reversed(x.children)):
                stack += [",", c] if k else [c]
    return "".join(out)


def read_tree(s: str) -> Tree:
    stack: list[tuple[str, list]] = [("", [])]
    for name, mark in re.findall(r"([^(),]*)([(),]|\Z)", s):
        if mark == "(":
            stack.append((name, []))
            continue
        if name:
            stack[-1][1].append(Tree(name))
        if mark == ")":
            label, children = stack.pop()
            stack[-1][1].append(Tree(label, tuple(children)))
    return stack[0][1][0]


def slots_of(tree: Tree, wrapper: Tree) -> list[int]:
    """The wrapper's slot (its number in preorder) for each node of ``tree`` in preorder; -1: none."""
    out: list[int] = []
    known: Known = {}
    stack: list[tuple[Tree, Tree | None, int]] = [(tree, wrapper, 0)]
    while stack:
        t, w, at = stack.pop()
        out.append(at)
        pairs = dict(_align(t.children, w.children, known)) if w else {}
        starts, k = [], at + 1
        for c in w.children if w else ():
            starts.append(k)
            k += c.size
        stack += [(c, w.children[pairs[i]], starts[pairs[i]]) if i in pairs else (c, None, -1) for i, c in reversed([*enumerate(t.children)])]
    return out


# -- what a slot is


@dataclass
class Slot:
    """Sums over the host's pages."""

    nodes: float = 0  # occurrences
    pages: float = 0  # pages with a text there
    most: float = 0  # pages with the most frequent text
    plain: float = 0  # characters outside links
    links: float = 0
    out: float = 0  # occurrences that are marked as left out
    article: int = 0


def content_slots(wrapper: Tree, slots: dict[int, Slot]) -> list[int]:
    """The numbers of the wrapper's slots that are content."""
    trees: list[Tree] = []
    below: list[list[int]] = []
    stack: list[tuple[Tree, int]] = [(wrapper, -1)]
    while stack:
        tree, parent = stack.pop()
        at = len(trees)
        trees.append(tree)
        below.append([])
        if parent >= 0:
            below[parent].append(at)
        stack += [(c, at) for c in reversed(tree.children)]
    own = [slots.get(i, Slot()) for i in range(len(trees))]
    tags = [re.split(r"[.~]", t.label, maxsplit=1)[0] for t in trees]
    constant = [s.pages >= MIN_PAGES and s.most >= CONSTANT * s.pages for s in own]
    out = [s.nodes > 0 and s.out >= s.nodes / 2 for s in own]
    plain, links, weight = [0.0] * len(trees), [0.0] * len(trees), [0.0] * len(trees)
    mine = [0.0] * len(trees)
    for i in range(len(trees) - 1, -1, -1):  # children have higher numbers
        s = own[i]
        plain[i], links[i] = s.plain, s.links
        mine[i] = 0.0 if constant[i] or s.links > LINKED * (s.plain + s.links) else s.plain
        weight[i] = mine[i]
        for c in below[i]:
            plain[i] += plain[c]
            links[i] += links[c]
            weight[i] += weight[c]
        weight[i] *= (MARKED if out[i] else 1.0) * (ARTICLE if s.article == 2 and not out[i] else 1.0)
    region = 0
    while below[region] and mine[region] <= OWN * weight[region]:
        best = max(below[region], key=lambda c: (weight[c], -c))
        total = sum(weight[c] for c in below[region])
        if not total or weight[best] < NEARLY_ALL * total:
            break
        beside = any(tags[c] in FLOW and weight[c] > 0 for c in below[region] if c != best)
        if beside or not below[best] and (tags[best] in FLOW or len(below[region]) == 1):
            break
        region = best
    # parts that are marked as articles and hold most of the region
    inside, found = [region], []
    while inside:
        i = inside.pop()
        if out[i] and i != region:
            continue
        if own[i].article == 2:
            found.append(i)
        else:
            inside += below[i]
    starts = found if found and sum(weight[i] for i in found) >= weight[region] / 2 else [region]
    content, todo = [], list(starts)
    while todo:
        i = todo.pop()
        if i not in starts and (out[i] or tags[i] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and links[i] > LINKED * (plain[i] + links[i])):
            continue
        if not constant[i]:
            content.append(i)
        todo += below[i]
    return sorted(content)


# -- per page


def examine(html: str) -> tuple[Node, str, list[tuple[str, int, int, int, int]]]:
    """Parsed page, its tree as text, and for each node of the tree its text, the characters outside
    and in links, the share of it that is marked as left out, and how it is marked as an article."""
    root = parse(html)
    tree = skeleton(root)
    found: list[list] = [[[], 0, 0, 0, 0, 0] for _ in range(tree.size)]
    stack = [root]
    while stack:
        node = stack.pop()
        own = _clean([i if isinstance(i, str) else " " for i in node.items])
        f = found[node.slot]
        if own:
            f[0].append(own)
            linked = len(_clean([i if isinstance(i, Linked) else " " for i in node.items]))
            f[1] += max(0, len(own) - linked)
            f[2] += linked
        f[3] += node.out
        f[4] = max(f[4], node.article)
        f[5] += 1
        stack.extend(i for i in reversed(node.items) if isinstance(i, Node))
    return root, write_tree(tree), [("\n".join(t), plain, links, int(2 * out >= n), article) for t, plain, links, out, article, n in found]


def content(root: Node, nodes: frozenset[int]) -> str:
    """The texts of the nodes with these numbers, in page order."""
    out: list[str] = []
    stack: list[tuple[Node, list, Iterator]] = [(root, [], iter(root.items))]
    while stack:
        node, run, rest = stack[-1]
        item = None
        for item in rest:
            if not isinstance(item, str):
                break
            run.append(item)
        else:
            item = None
            stack.pop()
        if node.slot in nodes and (text := _clean(run)):
            out.append(text)
        run.clear()
        if item is not None:
            stack.append((item, [], iter(item.items)))
    return "\n".join(out)


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)


_SURVEYED = "host string, tree string, page long, nodes array<struct<text:long,plain:long,links:long,out:int,article:int>>"
_NODE = pa.struct([("text", pa.int64()), ("plain", pa.int64()), ("links", pa.int64()), ("out", pa.int32()), ("article", pa.int32())])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if html:
                _, tree, nodes = examine(html)
                rows.append((host, tree, _hash(html), [{"text": _hash(t) if t else None, "plain": p, "links": k, "out": o, "article": a} for t, p, k, o, a in nodes]))
        columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.list_(_NODE)), strict=True)], ["host", "tree", "page", "nodes"])


def _united(table: pa.Table) -> pa.Table:
    wrapper = None
    for s in sorted(set(table.column("tree").to_pylist()), key=lambda s: (-len(s), s)):
        t = read_tree(s)
        wrapper = t if wrapper is None else unite(wrapper, t)
    return pa.table({"host": pa.array([table.column("host")[0].as_py()]), "tree": pa.array([write_tree(wrapper)])})


def _aligned(table: pa.Table) -> pa.Table:
    """Slots of each distinct tree of a host and part of a hash."""
    wrapper = read_tree(table.column("wrapper")[0].as_py())
    trees = table.column("tree").to_pylist()
    return pa.table({"host": table.column("host"), "tree": table.column("tree"), "slots": pa.array([slots_of(read_tree(t), wrapper) for t in trees], pa.list_(pa.int32()))})


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for wrapper, slots in zip(batch.column("wrapper").to_pylist(), batch.column("known").to_pylist(), strict=True):
            out.append(content_slots(read_tree(wrapper), {s.pop("slot"): Slot(**s) for s in slots}))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.list_(pa.int32()))], ["host", "content"])


def wrappers_of(pages: DataFrame) -> DataFrame:
    """host, tree and nodes (numbers of the tree's nodes that are content) for each distinct tree.

    ``pages``: host and html."""
    seen = cut(pages.mapInArrow(_survey, _SURVEYED))
    trees = cut(seen.select("host", "tree").distinct())
    salt = F.pmod(F.xxhash64("tree"), F.lit(SALTS)).alias("salt")
    parts = trees.groupBy("host", salt).applyInArrow(_united, "host string, tree string")
    wrappers = cut(parts.groupBy("host").applyInArrow(_united, "host string, tree string").withColumnRenamed("tree", "wrapper"))
    aligned = cut(trees.join(wrappers, "host").groupBy("host", salt).applyInArrow(_aligned, "host string, tree string, slots array<int>"))
    each = seen.dropDuplicates(["host", "page"]).select("host", "tree", F.posexplode("nodes").alias("node", "x")).select("host", "tree", "node", "x.*")
    sums = lambda n: [F.sum(n).alias("n"), *(F.sum(c).alias(c) for c in ("plain", "links", "out")), F.max("article").alias("article")]
    counted = each.groupBy("host", "tree", "node", "text").agg(*sums(F.lit(1)))
    by_text = counted.join(aligned, ["host", "tree"]).withColumn("slot", F.get("slots", F.col("node"))).groupBy("host", "slot", "text").agg(*sums("n"))
    told = F.col("text").isNotNull()
    by_slot = by_text.groupBy("host", "slot").agg(
        F.sum("n").alias("nodes"), F.coalesce(F.sum(F.when(told, F.col("n"))), F.lit(0)).alias("pages"), F.coalesce(F.max(F.when(told, F.col("n"))), F.lit(0)).alias("most"),
        *(F.sum(c).alias(c) for c in ("plain", "links", "out")), F.max("article").alias("article"),
    )
    known = by_slot.groupBy("host").agg(F.collect_list(F.struct("slot", "nodes", "pages", "most", "plain", "links", "out", "article")).alias("known"))
    decided = known.join(wrappers, "host").select("host", "wrapper", "known").mapInArrow(_decided, "host string, content array<int>")
    is_content = F.filter(F.transform("slots", lambda s, i: F.when(F.array_contains("content", s), i)), lambda i: i.isNotNull())
    return aligned.join(decided, "host").select("host", "tree", is_content.alias("nodes"))


def _read_by(known: dict[tuple[str, int], frozenset[int]] | None):
    """Texts of pages; ``known``: the content nodes by host and hash of the tree, or None if they come with the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: frozenset[int] = frozenset()
        for batch in batches:
            out = []
            given = batch.column("nodes").to_pylist() if known is None else None
            for i, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                if not html:
                    out.append("")
                    continue
                root = parse(html)
                tree = skeleton(root)
                out.append(content(root, frozenset(given[i] or ()) if known is None else known.get((host, _hash(write_tree(tree))), none)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [_hash(write_tree(skeleton(parse(h)))) if h else None for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], [*batch.schema.names, "key"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([_hash(t) for t in batch.column("tree").to_pylist()], pa.int64()), batch.column("nodes")], ["host", "key", "nodes"])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars for each page."""
    pages = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    pages = pages.withColumn("host", host_of(F.col("url"))).select("page_id", "url", "html", "host")
    found = cut(wrappers_of(pages.select("host", "html")).mapInArrow(_hashed, "host string, key long, nodes array<int>"))
    size = found.agg(F.coalesce(F.sum(F.length("host") + 24 + 8 * F.size("nodes")), F.lit(0))).first()[0]
    schema = "page_id long, url string, text string"
    if size <= TOLD_BYTES:  # the wrappers' decisions are told to every task
        known = pages.sparkSession.sparkContext.broadcast({(r["host"], r["key"]): frozenset(r["nodes"]) for r in found.toLocalIterator()})
        texts = pages.mapInArrow(lambda batches: _read_by(known.value)(batches), schema)
    else:  # or met by host and tree, which AQE splits where many pages share one
        keyed = pages.mapInArrow(_keyed, "page_id long, url string, html string, host string, key long")
        texts = keyed.join(found, ["host", "key"], "left").select("page_id", "url", "html", "host", "nodes").mapInArrow(_read_by(None), schema)
    return texts.withColumn("n_chars", F.length("text").cast("long"))
