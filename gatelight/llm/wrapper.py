"""Main text of web pages by wrapper induction.

Pages of one host are taken in blocks of at most ``pages_per_block``; the last two blocks
share their pages evenly, so that no block is short unless the host (or its part) is. Every page is parsed
into a tree of block elements; runs of like siblings, and runs of paragraphs, headings and
items, count as one repeated node. The trees of a block are merged into its pattern one by
one, aligned by simple tree matching: two nodes match when their tags do, and the children
of matching nodes are aligned in order with the largest number of matches; nodes without a
match join the pattern as slots of their own. Sub-trees of one shape share their score, and
children are aligned row by row in linear memory, so pages of any length are aligned whole.

A constant node is template, whatever its tag: a text that nine tenths of the different pages
of a block (of eight pages or more) have in one slot. In bare containers it is enough that
two and three quarters of those that have the slot agree. Slots whose text varies are
content. The wrapper of the block is the deepest container that still holds nearly all
varying text outside menus, headers, footers, sidebars, notices, adverts, forms and comments.
Each page gives the blocks inside its own copy of that container, without template.

A page alone in its block has no template, so all its text counts as varying. A page
without the container is treated as if it were alone.

Hosts with more than a thousandth of all pages (and more than a block) are split over
several tasks; there can be at most a thousand such hosts, so their list is broadcast.
Within a task pages stream by in host order and at most two blocks are held. All pages are
parsed whole.

Null and empty pages give the empty text; pages without a URL or host share one group.
Repeated rows give equal rows when alone or alike; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.llm.common import slices

EXTRACTED = "page_id long, url string, text string"

# Elements of HTML, by how they take part (fixed by the HTML standard).
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select option button datalist".split())
_APART = frozenset("nav header footer aside form dialog menu search".split())
_BARE = frozenset("div section td center".split())
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd figcaption address".split())
_CONTAINERS = frozenset("html body div main article section center table tbody tr td".split())
# What an open paragraph ends at, and items that end their like.
_ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS_LIKE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
# Elements nested deeper become siblings, as in browsers.
_DEEPEST = 200
# Pages from which on a text that nearly all of them share is template whatever its tag.
_FEWEST_PAGES = 8
# Cells of an alignment kept at once, and pairs of shapes whose scores are worked out for one alignment.
_MOST_CELLS, _MOST_PAIRS = 1 << 18, 10_000
# Words in class, id and role that name what is not the article.
_APART_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|"
    r"menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|sidebar|widgets?|masthead|header|footer|copyright|"
    r"comments?|respond|replies|disqus|share|sharing|social|related|recommended|complementary|contentinfo|search|login|signup)(?:$|[\s_-])",
    re.I,
)


@dataclass
class Node:
    """A block element: its own text blocks and its child elements in page order."""

    tag: str
    names: str = ""
    apart: bool = False
    children: list = field(default_factory=list)  # Node or str

    def leaf(self) -> bool:
        return not any(isinstance(c, Node) for c in self.children)


class _Builder(HTMLParser):
    """Builds the tree, closing what HTML lets authors leave open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#page")
        self.open: list[Node] = [self.root]
        self.inline: list[str] = []
        self.text: list[str] = []
        self.unseen: list[str] = []

    def flush(self) -> None:
        words = " ".join("".join(self.text).split())
        self.text = []
        if words:
            self.open[-1].children.append(words)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.unseen:
            if tag not in _VOID:
                self.unseen.append(tag)
            return
        if tag in _UNSEEN:
            if tag == "head" or tag not in _VOID:
                self.unseen.append(tag)
            return
        if tag in _INLINE:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in _ENDS_P and any(n.tag == "p" for n in self.open):
            self.close_to("p")
        if tag in _ENDS_LIKE:
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag in _HOLDS_LIKE[tag]:
                    break
                if self.open[at].tag in _ENDS_LIKE[tag]:
                    self.flush()
                    del self.open[at:]
                    break
        self.flush()
        if tag in _VOID or tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        given = {k: v or "" for k, v in attrs}
        names = " ".join(filter(None, (given.get("class"), given.get("id"), given.get("role"))))
        inside = any(n.tag in ("article", "main") for n in self.open)
        apart = tag in _APART and not (tag == "header" and inside)
        apart = apart or bool(_APART_NAMES.search(names)) and tag not in ("html", "body", "article", "main", "h1")
        node = Node(tag, names, apart or "hidden" in given or given.get("aria-hidden") == "true")
        if len(self.open) > _DEEPEST:
            self.open.pop()
        self.open[-1].children.append(node)
        self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # In HTML the slash means nothing, except that void elements have no end.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag in self.unseen:
                while self.unseen.pop() != tag:
                    pass
            elif tag in ("body", "html"):
                self.unseen.clear()
            return
        if tag in _INLINE or tag in ("html", "body"):
            return
        self.close_to(tag)

    def close_to(self, tag: str) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self.flush()
                del self.open[at:]
                return

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.text.append(data)


def parse(html: str | None) -> Node:
    """The tree of a page; anything that reads as HTML gives one."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    builder.flush()
    return builder.root


# Patterns


@dataclass
class Slot:
    """A node of a page's pattern: one node, or a run of like siblings that are leaves."""

    tag: str
    names: str
    apart: bool
    nodes: list[Node]
    own: str  # the text directly in it
    children: list = field(default_factory=list)


def _run_on(last: Slot, node: Node) -> bool:
    """Whether a leaf belongs to the run before it."""
    if not (node.leaf() and last.nodes[0].leaf()) or last.apart != node.apart:
        return False
    return (last.tag, last.names) == (node.tag, node.names) or (last.tag in _FLOW and node.tag in _FLOW)


def slot_of(node: Node) -> Slot:
    """The pattern of a node, repeated leaves taken together."""
    children: list[Slot] = []
    for child in node.children:
        if not isinstance(child, Node):
            continue
        if children and _run_on(children[-1], child):
            children[-1].nodes.append(child)
            children[-1].own += "\n" + "\n".join(child.children)
        else:
            children.append(slot_of(child))
    return Slot(node.tag, node.names, node.apart, [node], "\n".join(c for c in node.children if isinstance(c, str)), children)


class Matcher:
    """Simple tree matching of patterns: the number of matching nodes, where like names count once more.

    A score depends on the shapes of two trees only, so it is worked out once for each pair of shapes.
    """

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.scores: dict[tuple[int, int], int] = {}
        self.of: dict[int, int] = {}

    def shape(self, slot: Slot) -> int:
        key = (slot.tag if slot.tag not in _FLOW else "#flow", slot.names, tuple(self.shape(c) for c in slot.children))
        found = self.of[id(slot)] = self.shapes.setdefault(key, len(self.shapes))
        return found

    def score(self, a: Slot, b: Slot) -> int:
        if not _like(a, b):
            return 0
        key = self.of[id(a)], self.of[id(b)]
        if key not in self.scores:
            inner = sum(self.score(x, y) for x, y in self.aligned(a.children, b.children))
            self.scores[key] = inner + 1 + (a.names == b.names)
        return self.scores[key]

    def pairs(self, a: Slot, b: Slot) -> list[tuple[Slot, Slot]]:
        """All matching nodes of two trees, from the roots down."""
        if not _like(a, b):
            return []
        return [(a, b)] + [pair for x, y in self.aligned(a.children, b.children) for pair in self.pairs(x, y)]

    def aligned(self, left: list[Slot], right: list[Slot]) -> list[tuple[Slot, Slot]]:
        """The children of two nodes that match, in order, with the largest sum of scores."""
        # Trees of one shape at either end match in some best alignment.
        head, most = 0, min(len(left), len(right))
        while head < most and self.of[id(left[head])] == self.of[id(right[head])]:
            head += 1
        tail = 0
        while tail < most - head and self.of[id(left[-1 - tail])] == self.of[id(right[-1 - tail])]:
            tail += 1
        inner = self._inner(left[head : len(left) - tail], right[head : len(right) - tail])
        ends = list(zip(left[len(left) - tail :], right[len(right) - tail :])) if tail else []
        return list(zip(left[:head], right[:head])) + inner + ends

    def _inner(self, left: list[Slot], right: list[Slot]) -> list[tuple[Slot, Slot]]:
        if not left or not right:
            return []
        kinds = [{}, {}]
        rows, columns = (np.array([kind.setdefault(self.of[id(s)], (len(kind), s))[0] for s in slots]) for kind, slots in zip(kinds, (left, right)))
        examples = [[s for _, s in kind.values()] for kind in kinds]
        exact = len(examples[0]) * len(examples[1]) <= _MOST_PAIRS
        # Of very many different shapes only the roots are compared when their order is sought.
        weights = np.array([[(self.score(a, b) if exact else _like(a, b) * (1 + (a.names == b.names))) for b in examples[1]] for a in examples[0]], np.int32)
        return [(left[i], right[j]) for i, j in best_order(weights, rows, columns)]


def _like(a: Slot, b: Slot) -> bool:
    return a.tag == b.tag or (a.tag in _FLOW and b.tag in _FLOW)


def best_order(weights: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (i, j), ascending in both, whose weights[rows[i], columns[j]] have the largest sum; pairs of weight 0 are none.

    Small tables are kept whole; large ones are halved at the best column of their middle row, which needs two rows at a time.
    """
    if not len(rows) or not len(columns):
        return []
    if len(rows) == 1 or len(rows) * len(columns) <= _MOST_CELLS:
        table = np.zeros((len(rows) + 1, len(columns) + 1), np.int32)
        for i, kind in enumerate(rows):
            _next_row(table[i], weights[kind][columns], table[i + 1])
        out, i, j = [], len(rows), len(columns)
        while i and j:
            weight = weights[rows[i - 1], columns[j - 1]]
            if weight and table[i, j] == table[i - 1, j - 1] + weight:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif table[i, j] == table[i - 1, j]:
                i -= 1
            else:
                j -= 1
        return out[::-1]
    middle = len(rows) // 2
    before, after = _last_row(weights, rows[:middle], columns), _last_row(weights, rows[middle:][::-1], columns[::-1])
    cut = int(np.argmax(before + after[::-1]))
    return best_order(weights, rows[:middle], columns[:cut]) + [(i + middle, j + cut) for i, j in best_order(weights, rows[middle:], columns[cut:])]


def _next_row(row: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
    np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weight), out=out[1:])


def _last_row(weights: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    row, spare = np.zeros(len(columns) + 1, np.int32), np.zeros(len(columns) + 1, np.int32)
    for kind in rows:
        _next_row(row, weights[kind][columns], spare)
        row, spare = spare, row
    return row


def match(a: Slot, b: Slot) -> tuple[int, list[tuple[Slot, Slot]]]:
    """The score of two patterns and their matching nodes."""
    matcher = Matcher()
    matcher.shape(a), matcher.shape(b)
    return matcher.score(a, b), matcher.pairs(a, b)


def _slots(root: Slot) -> Iterator[Slot]:
    yield root
    for child in root.children:
        yield from _slots(child)


def _empty_copy(slot: Slot, aligned: dict[int, Slot]) -> Slot:
    """A slot of a pattern for a page's slot, entered in ``aligned``."""
    made = Slot(slot.tag, slot.names, False, [], "", [_empty_copy(c, aligned) for c in slot.children])
    aligned[id(made)] = slot
    return made


class Wrapper:
    """What a block of pages has in common: its pattern, the template texts, and the content container."""

    def __init__(self, pages: list[Slot]) -> None:
        self.pattern = Slot(pages[0].tag, "", False, [], "")
        self.matcher = Matcher()
        self.aligned = [self._merged(page) for page in pages]
        varying: dict[int, float] = {}
        #: The template texts of each slot.
        self.constant: dict[int, set[str]] = {}
        for slot in _slots(self.pattern):
            have = [page[id(slot)] for page in self.aligned if id(slot) in page]
            slot.apart = 2 * sum(h.apart for h in have) > len(have)
            template: set[str] = set()
            if slot.tag in _BARE:
                own, times = Counter(h.own for h in have).most_common(1)[0]
                if times > 1 and 4 * times >= 3 * len(have):
                    template.update(own.split("\n"))
            if len(pages) >= _FEWEST_PAGES and 10 * len(have) >= 9 * len(pages):
                held = Counter(text for h in have for text in set(h.own.split("\n")))
                template.update(text for text, times in held.items() if 10 * times >= 9 * len(pages))
            self.constant[id(slot)] = template
            # Mean size of what is no template text.
            varying[id(slot)] = sum(len(text) for h in have for text in h.own.split("\n") if text not in template) / len(pages)
        self.root = self._container(self.pattern, varying)

    def _merged(self, page: Slot) -> dict[int, Slot]:
        """Adds a page's tree to the pattern; the page's slots by the pattern's."""
        self.matcher.of.clear()
        self.matcher.shape(self.pattern), self.matcher.shape(page)
        pairs = self.matcher.pairs(self.pattern, page)
        partner = {id(b): a for a, b in pairs}
        aligned = {id(a): b for a, b in pairs}
        for a, b in pairs:
            children, at = [], 0
            for child in b.children:
                like = partner.get(id(child))
                if like is None:
                    children.append(_empty_copy(child, aligned))
                else:
                    end = next(i for i in range(at, len(a.children)) if a.children[i] is like) + 1
                    children += a.children[at:end]
                    at = end
            a.children = children + a.children[at:]
        return aligned

    def _mass(self, slot: Slot, varying: dict[int, float]) -> float:
        if slot.apart:
            return 0.0
        return varying[id(slot)] + sum(self._mass(c, varying) for c in slot.children)

    def _container(self, slot: Slot, varying: dict[int, float]) -> Slot:
        whole = self._mass(slot, varying)
        while True:
            inside = [c for c in slot.children if c.tag in _CONTAINERS and not c.apart]
            named = [c for c in inside if c.tag in ("article", "main")]
            heaviest = max(named or inside, key=lambda c: self._mass(c, varying), default=None)
            share = 0.5 if named else 0.8
            if heaviest is None or slot.tag == "article" or self._mass(heaviest, varying) < share * whole or whole == 0:
                return slot
            slot = heaviest

    def text(self, number: int) -> str:
        """The main text of one page of the block."""
        slots = self.aligned[number]
        page = slots.get(id(self.root))
        blocks: list[str] = []
        if page is not None:
            template = {id(n): self.constant[key] for key, slot in slots.items() for n in slot.nodes if self.constant[key]}
            for node in page.nodes:
                _blocks(node, template, blocks)
        return "\n".join(blocks)


def _blocks(node: Node, template: dict[int, set[str]], out: list[str]) -> None:
    """Text blocks in page order, without what is set apart and without template texts."""
    constant = template.get(id(node), ())
    for child in node.children:
        if isinstance(child, Node):
            if not child.apart:
                _blocks(child, template, out)
        elif child not in constant:
            out.append(child)


def texts_of_block(pages: list[str | None]) -> list[str]:
    """The main text of every page of one block.

    Equal pages count once when the template is sought, as their texts say nothing about it.
    """
    distinct = list(dict.fromkeys(p or "" for p in pages))
    slots = [slot_of(parse(p)) for p in distinct]
    wrapper = Wrapper(slots)
    found = {}
    for number, html in enumerate(distinct):
        text = wrapper.text(number)
        found[html] = text or (Wrapper([slots[number]]).text(0) if len(slots) > 1 else text)
    return [found[p or ""] for p in pages]


# Blocks of hosts


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def extract(pages: DataFrame, pages_per_block: int = 64, most_hot: int = 1_000) -> DataFrame:
    """``page_id``, ``url`` and the main ``text`` of every page."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))
    counts = own.groupBy("host").agg(F.count("*").alias("n"))
    total = own.count()
    share = max(4 * pages_per_block, total // most_hot)
    # More than ``share`` pages each: there are at most ``most_hot`` such hosts.
    hot = counts.filter(F.col("n") > share).withColumn("parts", F.ceil(F.col("n") / share).cast("int")).drop("n")
    dealt = own.join(F.broadcast(hot), "host", "left").withColumn("turn", F.xxhash64("page_id", "url"))
    dealt = dealt.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("turn", F.col("parts"))).cast("int"))
    ordered = dealt.select("host", "part", "turn", "page_id", "url", "html").repartition("host", "part").sortWithinPartitions("host", "part", "turn")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def ended() -> Iterator[pa.RecordBatch]:
            # The last two blocks share their pages evenly.
            half = len(held) if len(held) <= pages_per_block else -(-len(held) // 2)
            for at in range(0, len(held), half):
                yield _extracted(held[at : at + half])
            held.clear()

        for batch in slices(batches, 64, "html", 8 << 20):
            for host, part, page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "page_id", "url", "html"))):
                if held and (host, part) != group:
                    yield from ended()
                elif len(held) == 2 * pages_per_block:
                    yield _extracted(held[:pages_per_block])
                    del held[:pages_per_block]
                group = (host, part)
                held.append((page_id, url, html))
        if held:
            yield from ended()

    return ordered.mapInArrow(work, EXTRACTED)


def _extracted(held: list[tuple]) -> pa.RecordBatch:
    texts = texts_of_block([html for _, _, html in held])
    return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """The main text of every page and its length."""
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
