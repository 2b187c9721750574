"""Main text of web pages by a tree-structured graphical model (operator 10).

The elements of a page are the nodes of a tree; each is main text or not. A node's features (tag, words
of class, id and role, share of linked text, length) give its own potential, and each edge a
parent-child potential that depends on the child's kind of tag. Sum-product messages pass up from the
leaves and down from the root, which gives every node's exact marginal; the text of a block is kept if
its element's marginal is at least one half. Potentials are smoothed counts over labelled pages
(labelled_pages.py: `count` pages, a documented bound; none of the pages of the input is needed).

Text: character references are decoded, white space inside a block becomes one space, blocks are joined
in page order by one newline. <br> is white space. What is never shown (head, script, style, form
controls, comments, markup) has no text at all, and within a block it does not part it; formulas are text
of their block. Forms are elements like others, about which the model decides, as pages may lie in one.

Nulls and edge cases: a null or empty html gives an empty text, as does a page without main text; a null
page_id or url is kept; repeated rows give repeated results; unclosed, misnested and stray tags are
tolerated; a page without block elements is one block, kept if it is as long as such labelled pages are; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled_pages

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mtable mtr mtd semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("head title script style template noscript textarea select option button input object iframe svg canvas audio video datalist annotation annotation-xml".split())
#: Those that stand within a line of text without parting it.
_UNSEEN = _SILENT - {"head", "title", "option"}
_RAW = frozenset("script style textarea title noscript iframe".split())
#: Start tags that end an open element of these kinds.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORD = re.compile(r"[a-z]{2,}")
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "words", "label", "parent", "children", "text", "linked", "pieces", "quiet")

    def __init__(self, tag: str, parent: int, words: tuple[str, ...] = (), label: int | None = None):
        self.tag, self.parent, self.words, self.label = tag, parent, words, label
        self.children: list[int] = []
        self.text = self.linked = 0
        self.pieces = 0
        self.quiet = False  # never shown, so no evidence either


class Markup:
    """Tags, comments and declarations of a page, found in time linear in its length whatever is left open."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.asked, self.found, self.searched = 0, -1, False  # the last search for a stop, and its result
        self.dead: set[int] = set()  # quotes from which on no tag ends

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """Where it begins and ends, "/" of an end tag, its name ("" of what is no tag) and its attributes."""
        html = self.html
        while (at := html.find("<", at)) >= 0:
            for begin, stop in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if html.startswith(begin, at):
                    end = html.find(stop, at + len(begin))
                    return at, end + len(stop) if end >= 0 else len(html), "", "", ""
            if at > self.last:
                return None
            if html.startswith(("<!", "<?"), at):
                return at, html.find(">", at) + 1, "", "", ""
            if (m := _NAME.match(html, at)) and (end := self._end(m.end())) is not None:
                return at, end, m[1], m[2].lower(), html[m.end() : end - 1]
            at += 1
        return None

    def _stop(self, at: int) -> int:
        """Place of the next > or quote, or -1."""
        if at < self.asked or self.found < at and self.found != -1 or not self.searched:
            m = _STOP.search(self.html, at)
            self.asked, self.found, self.searched = at, m.start() if m else -1, True
        return self.found

    def _end(self, at: int) -> int | None:
        """Place behind the > that ends a tag; a quoted value may hold one."""
        met = []
        while (k := self._stop(at)) >= 0 and k not in self.dead:
            if self.html[k] == ">":
                return k + 1
            met.append(k)
            other = self.html.find(self.html[k], k + 1)
            if other < 0:
                break
            at = other + 1
        self.dead.update(met)
        return None


def parse(html: str, labelled: bool = False) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements as a tree (node 0 is the page) and the blocks of shown text with their element.
    Inline elements belong to the block around them. labelled: whether data-main attributes are read."""
    nodes = [Node("html", -1)]
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("#page", 0)]  # open tags, each with the block that text in it belongs to
    run: list[str] = []
    links = silent = linked = 0
    is_open: Counter = Counter()  # tags on the stack
    markup = Markup(html)

    def flush() -> None:
        nonlocal run, linked
        if run:
            text = _WHITE.sub(" ", htmllib.unescape("".join(run))).strip()
            if text:
                own = stack[-1][1]
                blocks.append((own, text))
                nodes[own].pieces += 1
                nodes[own].text += len(text)
                nodes[own].linked += min(linked, len(text))
            run, linked = [], 0

    def close(upto: int) -> None:
        nonlocal links, silent
        while len(stack) > upto:
            tag = stack[-1][0]
            if tag not in _INLINE and not silent:
                flush()
            stack.pop()
            is_open[tag] -= 1
            links -= tag == "a"
            silent -= tag in _SILENT

    def open_tag(tags: set | frozenset, stop: set | frozenset) -> int | None:
        if not any(is_open[t] for t in tags):
            return None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in stop:
                return None
        return None

    def skipped(tag: str, at: int) -> int:
        """Where reading goes on behind a start tag: the content of some elements holds no tags."""
        if tag not in _RAW:
            return at
        stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
        return stop.start() if stop else end

    at, end = 0, len(html)
    while at < end:
        found = markup.next(at)
        if (upto := found[0] if found else end) > at and not silent:
            run.append(html[at:upto])
            linked += (upto - at) * (links > 0)
        if not found:
            break
        _, at, closing, tag, attributes = found
        if not tag:
            continue
        if closing:
            if tag == "p" and open_tag({"p"}, frozenset()) is None:
                continue
            k = open_tag({tag}, {"td", "th", "article", "section", "main", "div"} - {tag} if tag in _INLINE else frozenset())
            if k is not None:
                close(k)
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in _ENDS_P and (k := open_tag({"p"}, {"table", "button", "td"})) is not None:
            close(k)
        elif tag in _ENDS:
            first, stop = _ENDS[tag]
            while (k := open_tag(first, stop)) is not None:
                close(k)
        if tag in _INLINE:
            if tag not in _VOID and not attributes.endswith("/"):
                stack.append((tag, stack[-1][1]))
                is_open[tag] += 1
                links += tag == "a"
            continue
        if silent or tag in _UNSEEN:  # no text of its own, so no element of the tree
            if tag not in _VOID and not (tag == "svg" and attributes.endswith("/")):
                stack.append((tag, stack[-1][1]))
                is_open[tag] += 1
                silent += tag in _SILENT
                at = skipped(tag, at)
            continue
        flush()
        words, label = [], None
        for a in _ATTRIBUTE.finditer(attributes):
            name = a[1].lower()
            if name in ("class", "id", "role"):
                words += _WORD.findall((a[2] or a[3] or a[4] or "").lower())
            elif labelled and name == "data-main":
                label = int(a[2])
        nodes.append(Node(tag, stack[-1][1], tuple(words), label))
        nodes[-1].quiet = tag in _SILENT
        nodes[nodes[-1].parent].children.append(len(nodes) - 1)
        if tag not in _VOID:
            stack.append((tag, len(nodes) - 1))
            is_open[tag] += 1
            silent += tag in _SILENT
            at = skipped(tag, at)
    close(0)
    return nodes, blocks


def _long(length: int) -> int:
    return min(6, int(math.log(1 + length, 4)))


def _features(node: Node, length: int, linked: int) -> list[str]:
    words = sorted(set(node.words))
    share = round(3 * linked / length) if length else "-"
    return ["tag " + node.tag, *("word " + w for w in words), f"tag {node.tag} {share} {_long(length)}", f"linked {share}", f"length {_long(length)}", f"classed {bool(words)}"]


def _kind(node: Node) -> str:
    return node.tag if not node.words else node.tag + "."


class Model:
    """Counts as log potentials: features given the label, and the label given the parent's."""

    def __init__(self, pages: list[str]):
        self.seen: tuple[Counter, Counter] = (Counter(), Counter())
        self.total = [0, 0]
        self.edges: Counter = Counter()
        self.loose: Counter = Counter()  # length of text outside all block elements, and the page's label
        for page in pages:
            nodes, _ = parse(page, labelled=True)
            labels: list[int] = []
            if len(nodes) == 1:  # nothing but text
                nodes[0].label = 1
            if nodes[0].text:
                self.loose[_long(nodes[0].text), nodes[0].label or 0] += 1
            sums = subtree(nodes)
            for k, node in enumerate(nodes):
                own = node.label if node.label is not None else (labels[node.parent] if k else 0)
                labels.append(own)
                if node.quiet:
                    continue
                self.total[own] += 1
                self.seen[own].update(_features(node, *sums[k]))
                if k:
                    self.edges[(labels[node.parent], own)] += 1
                    self.edges[(labels[node.parent], own, _kind(node))] += 1
        self.own_cache: dict[str, float] = {}

    def weight(self, feature: str) -> float:
        """Log ratio of a feature's frequencies with either label."""
        w = self.own_cache.get(feature)
        if w is None:
            p, q = ((self.seen[y][feature] + 0.5) / (self.total[y] + 1) for y in (1, 0))
            w = math.log(p / q) if feature.startswith(("tag", "word")) else 0.5 * math.log(p / q)
            if not (self.seen[0][feature] or self.seen[1][feature]):
                w = 0.0
            if len(self.own_cache) < 100_000:
                self.own_cache[feature] = w
        return w

    @lru_cache(maxsize=10_000)
    def edge(self, kind: str) -> tuple[tuple[float, float], tuple[float, float]]:
        """P(child | parent), by the child's kind of element, smoothed towards that of all kinds."""
        table = []
        for parent in (0, 1):
            every = [self.edges[(parent, y)] + 1 for y in (0, 1)]
            own = [self.edges[(parent, y, kind)] + 4 * every[y] / sum(every) for y in (0, 1)]
            table.append(tuple(max(1e-4, x / sum(own)) for x in own))
        return tuple(table)

    def page(self, node: Node) -> tuple[float, float]:
        """Potential of the page itself: it is main text only where text lies outside all block elements."""
        if not node.text:
            return 1.0, 1e-6
        no, yes = (self.loose[_long(node.text), y] + 0.5 for y in (0, 1))
        return no / (no + yes), yes / (no + yes)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability that each node is main text: messages up from the leaves, then down."""
        n, sums = len(nodes), subtree(nodes)
        own, tables = [], []
        for k, node in enumerate(nodes):
            if node.quiet:
                own.append((1.0, 1.0))
                tables.append(((0.5, 0.5), (0.5, 0.5)))
                continue
            # words of class, id and role together weigh as eight at most
            own_features = _features(node, *sums[k])
            named = [self.weight(f) for f in own_features if f.startswith("word ")]
            z = sum(self.weight(f) for f in own_features if not f.startswith("word ")) + sum(named) * min(1.0, 8 / max(1, len(named)))
            z = max(-30.0, min(30.0, z))
            p = 1 / (1 + math.exp(-z))
            own.append((1 - p, p) if k else self.page(node))
            tables.append(self.edge(_kind(node)))
        below = [list(x) for x in own]  # own potential times the messages of all children
        message: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            b0, b1 = below[k]
            (t00, t01), (t10, t11) = tables[k]
            m0, m1 = t00 * b0 + t01 * b1, t10 * b0 + t11 * b1
            s = m0 + m1
            message[k] = (m0 / s, m1 / s)
            parent = below[nodes[k].parent]
            parent[0] *= message[k][0]
            parent[1] *= message[k][1]
            s = parent[0] + parent[1]
            parent[0], parent[1] = max(parent[0] / s, 1e-300), max(parent[1] / s, 1e-300)
        belief = [tuple(below[0])] + [(0.0, 0.0)] * (n - 1)
        for k in range(1, n):
            a0, a1 = belief[nodes[k].parent]
            a0, a1 = a0 / max(message[k][0], 1e-300), a1 / max(message[k][1], 1e-300)
            (t00, t01), (t10, t11) = tables[k]
            c0, c1 = (a0 * t00 + a1 * t10) * below[k][0], (a0 * t01 + a1 * t11) * below[k][1]
            s = c0 + c1 or 1.0
            belief[k] = (c0 / s, c1 / s)
        s = sum(belief[0])
        return [belief[0][1] / s] + [b[1] for b in belief[1:]]


def subtree(nodes: list[Node]) -> list[tuple[int, int]]:
    """Length of all text and of linked text in each node's subtree."""
    sums = [[x.text, x.linked] for x in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        up = sums[nodes[k].parent]
        up[0] += sums[k][0]
        up[1] += sums[k][1]
    return [tuple(x) for x in sums]


@lru_cache(maxsize=2)
def model(count: int) -> Model:
    return Model(labelled_pages.pages(count))


def main_text(html: str | None, own: Model) -> str:
    if not html:
        return ""
    nodes, blocks = parse(html)
    if not blocks:
        return ""
    p = own.marginals(nodes)
    return "\n".join(text for k, text in blocks if p[k] >= 0.5)


def extract(df: DataFrame, labelled: int = 600) -> DataFrame:
    """page_id, url, text, n_chars of every page. labelled: how many labelled pages to train on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(labelled)
        for batch in batches:
            texts = [main_text(x, own) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
