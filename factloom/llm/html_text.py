"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text.  A block's capacity, to the source (content) or to the sink
(boilerplate), is the log odds that three sources give it: what its containers say by elements and names
whose meaning is known, how the words of their names part content elsewhere, and a logistic classifier of
the text alone (words, closing mark, share of links, heading, list item).  The latter two are fitted
without labels: on pages that have an <article> or <main> they learn to tell the blocks within from those
without, starting from weights that hold where there are no such pages.
Smoothness edges join neighbours in page order, the weaker the further apart they stand in the DOM,
and next of kin under one parent.  The minimum cut, found by max-flow, labels the blocks, so that a
block with weak signs follows its neighbours; the content side is the text.

Bounds: ``FIT_PAGES`` pages fit the classifier, of which counts of kinds of blocks reach the driver.  The
features that names give are the first 16 different words of a container's names, and those of the
``NAME_DEPTH`` containers around a block; extraction reads every whole page.

Cases: a null page gives the empty text; text outside any block element is a block; a line break is
white space inside its block; unclosed and stray tags are repaired, in time linear in the page's length
however long or deep it is; formulas are part of their paragraph; the labels of closed svg graphics are
no text; repeated rows and extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from html import escape, unescape
from math import exp, log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.labelled import sampled, texts_of
from factloom.llm.shared import by_bytes, only

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_VALUE = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"\b(class|id|role|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

#: Elements of HTML by how they part text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | frozenset(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Hold no markup, only text up to their end tag, or up to the end of the page.
RAW = frozenset("script style title textarea iframe noembed noframes".split())
#: Left out with all they hold, and parsed as if they were not there where their own end tag is missing.
LEFT_OUT = frozenset("svg template annotation annotation-xml".split())
#: Containers inside paragraphs; without an end tag of their own they hold nothing.
HOLDERS = frozenset("canvas noscript object select".split())
VOID = frozenset("area base col embed hr img input link meta param source track wbr".split())
#: What a start tag closes, if open in the same container.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What elements and names say of the text within.
BAD_ELEMENTS = frozenset("nav footer aside form button menu dialog fieldset".split()) | HOLDERS
GOOD_ELEMENTS = frozenset("article main".split())
BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login"
    r"|nav|navbar|navigation|navi|menu|breadcrumbs?|pagination|pager|toolbar|topbar|masthead|header|footer|foot|copyright|legal"
    r"|sidebar|aside|rail|widgets?|related|recommend\w*|share|sharing|social|tags|comments?|commentlist|respond|replies|reply|disqus|complementary|contentinfo|search)(?=$|[\s_-])"
)
GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?=$|[\s_-])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

#: Strengths of smoothness edges: neighbours in page order, next of kin; how fast DOM distance weakens them, and where they end.
ADJACENT, KIN, DECAY, FAR = 4.0, 1.0, 0.5, 24
#: Pages that fit the classifier, and how many blocks its starting weights count for.
FIT_PAGES, PRIOR_BLOCKS = 2_000, 25.0
#: Starting weights: constant, log of words, closing mark, share of links, heading, list item.
PRIOR = (-1.9, 0.9, 0.5, -3.0, 1.0, 0.0)
#: Words of names are hashed to this many places; a place's log odds count in full where some ``PRIOR_BLOCKS`` blocks show it.
NAME_PLACES = 4096
#: Log odds of one word of a name, and of all names around a block, stay within these.
NAME_MOST, NAMES_MOST = 2.0, 4.0
#: Containers above a block whose names teach.
NAME_DEPTH = 8
#: The classifier's log odds stay within this, so that what the containers say is not drowned.
MOST = 6.0
#: Log odds on pages where no element names the main text.
UNNAMED = 1.5


@dataclass
class _Node:
    tag: str
    parent: int
    depth: int
    names: str = ""
    hidden: bool = False
    holds_main: bool = False


@dataclass
class _Block:
    node: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class _Tags:
    """Finds where tags end.  Each way of failing looks ahead once a page, so the time is linear."""

    def __init__(self, html: str):
        self.html, self.quoted, self.open = html, True, True

    def end(self, at: int) -> int | None:
        """Where the tag ends whose name ends at ``at``; None if nothing closes it."""
        plain = self.html.find(">", at) if self.open else -1
        if plain < 0:
            self.open = False
            return None
        while self.quoted and (found := _VALUE.search(self.html, at)):
            if not found[1]:
                return found.end()
            at = self.html.find(found[1], found.end()) + 1
            if not at:
                break
        # A quote that never ends: from here on quotes mean nothing.
        self.quoted = False
        return plain + 1


def _ends(html: str, tag: str) -> dict[int, int]:
    """Where each element of a name ends, by where its start tag ends; unclosed and self-closed ones have no entry."""
    found, open_, tags = {}, [], _Tags(html)
    for m in re.finditer(rf"<(/?){tag}(?![a-zA-Z0-9:-])", html, re.IGNORECASE):
        end = tags.end(m.end())
        if end is None:
            break
        if not m[1]:
            if html[end - 2] != "/":
                open_.append(end)
        elif open_:
            found[open_.pop()] = end
    return found


def parse(html: str) -> tuple[list[_Node], list[_Block]]:
    """The containers of a page and its blocks of text, in page order."""
    nodes, blocks, stack = [_Node("", -1, 0)], [], [0]
    links, block, tags = 0, _Block(0), _Tags(html)
    known: dict[str, dict[int, int]] = {}
    opened: Counter[str] = Counter()
    xmp_ends = True  # until a search finds no end behind it

    def own_end(tag: str, at: int) -> int | None:
        if tag not in known:
            known[tag] = _ends(html, tag)
        return known[tag].get(at)

    def finish(at: int) -> None:
        nonlocal block
        if block.parts:
            block.text = " ".join(unescape("".join(block.parts)).split())
            if block.text:
                blocks.append(block)
        block = _Block(at)

    def add(piece: str) -> None:
        block.parts.append(piece)
        block.linked += len(piece) if links else 0

    def pop() -> str:
        tag = nodes[stack.pop()].tag
        opened[tag] -= 1
        return tag

    at = 0
    while at < len(html):
        begin = html.find("<", at)
        if begin != at:
            add(html[at : begin if begin >= 0 else None])
            if begin < 0:
                break
        if html.startswith(("<!", "<?"), begin):
            comment = html.startswith("<!--", begin)
            empty = comment and re.compile("<!--?-?>").match(html, begin)
            end = empty.end() - 1 if empty else html.find("-->" if comment else ">", begin + (4 if comment else 2))
            at = len(html) if end < 0 else end + (3 if comment and not empty else 1)
            continue
        name = _OPEN.match(html, begin)
        end = tags.end(name.end()) if name else None
        if end is None:
            add("<")
            at = begin + 1
            continue
        tag, closing, rest, at = name[2].lower(), bool(name[1]), html[name.end() : end - 1], end
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            if tag not in ("script", "style"):
                finish(stack[-1])
            continue
        if tag in LEFT_OUT:
            at = at if closing else own_end(tag, at) or at
            continue
        if tag in HOLDERS and not closing and own_end(tag, at) is None:
            finish(stack[-1])
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag in VOID:
            finish(stack[-1])
            continue
        links = links if tag in HOLDERS else 0
        if closing:
            if opened[tag]:
                while pop() != tag:
                    pass
            finish(stack[-1])
            continue
        if nodes[stack[-1]].tag == "p" and tag not in HOLDERS:
            pop()
        if tag == "xmp" and xmp_ends and (end := re.compile(r"</xmp\b[^>]*>?", re.IGNORECASE).search(html, at)):
            nodes.append(_Node(tag, stack[-1], len(stack)))
            finish(len(nodes) - 1)
            block.parts.append(escape(html[at : end.start()]))
            finish(stack[-1])
            at = end.end()
            continue
        xmp_ends = xmp_ends and tag != "xmp"
        while len(stack) > 1 and nodes[stack[-1]].tag in CLOSES.get(tag, ()):
            pop()
        node = _Node(tag, stack[-1], len(stack))
        if rest and ("=" in rest or "hidden" in rest):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
            node.names = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower().strip()
            node.hidden = bool(_HIDDEN.search(found.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", rest))
        nodes.append(node)
        stack.append(len(nodes) - 1)
        opened[tag] += 1
        if tag in GOOD_ELEMENTS and not BAD_NAMES.search(node.names):
            for k in reversed(stack[:-1] if not nodes[stack[-2]].holds_main else ()):
                if nodes[k].holds_main:
                    break  # and so do all around it
                nodes[k].holds_main = True
        finish(stack[-1])
    finish(0)
    return nodes, blocks


def _place_score(nodes: list[_Node]) -> list[float]:
    """What the chain of containers says, for each container."""
    scores: list[float] = []
    for node in nodes:
        score = scores[node.parent] if node.parent >= 0 else 0.0
        if node.hidden:
            score -= 12
        elif not node.holds_main and node.tag not in ("html", "body"):
            inside = score >= 3  # already inside the main text
            if node.tag in BAD_ELEMENTS or BAD_NAMES.search(node.names):
                score -= 12
            elif node.tag == "header":
                score -= 2 if inside else 12
            elif node.tag in GOOD_ELEMENTS:
                score += 5
            elif node.names and GOOD_NAMES.search(node.names):
                score += 2
        scores.append(max(-12.0, min(8.0, score)))
    return scores


def kind_of(nodes: list[_Node], block: _Block) -> tuple[int, int, int, int, int]:
    """What the classifier knows of a block's text: words (in steps of the logarithm), closing mark, tenths of links, heading, list item."""
    tag = nodes[block.node].tag
    share = min(1.0, block.linked / max(1, len(block.text)))
    return round(4 * log1p(block.text.count(" ") + 1)), int(block.text[-1] in ".!?:\"»…"), round(10 * share), int(bool(re.fullmatch(r"h[1-6]", tag))), int(tag in ("li", "dt", "dd", "td", "th"))


def _design(kinds: Sequence[tuple]) -> np.ndarray:
    return np.array(kinds, float).reshape(-1, 5) * (0.25, 1, 0.1, 1, 1)


@dataclass(frozen=True)
class Model:
    """What is fitted: weights of the text's features, and the log odds of hashed words of names (none if empty)."""

    weights: tuple[float, ...] = PRIOR
    names: tuple[float, ...] = ()


def _name_places(node: _Node) -> list[int]:
    """The hashed words of a container's names; none for the main text's element and what holds it."""
    if not node.names or node.holds_main or node.tag in GOOD_ELEMENTS:
        return []
    words = dict.fromkeys(re.findall(r"[a-z0-9]+", node.names))
    return [crc32(w.encode()) % NAME_PLACES for w in list(words)[:16]]


def _name_score(nodes: list[_Node], names: Sequence[float]) -> list[float]:
    """What the names of a container and of those around it have been seen to say."""
    out: list[float] = []
    for node in nodes:
        own = sum(names[i] for i in _name_places(node)) if names else 0.0
        out.append(max(-NAMES_MOST, min(NAMES_MOST, (out[node.parent] if node.parent >= 0 else 0.0) + own)))
    return out


def scores(nodes: list[_Node], blocks: list[_Block], model: Model | None = None) -> list[float]:
    """Log odds of each block: above zero for content."""
    model = model or Model()
    weights, named = model.weights, _name_score(nodes, model.names)
    places = _place_score(nodes)
    bare = 0.0 if any(n.holds_main for n in nodes) else UNNAMED
    out = []
    for block in blocks:
        words, mark, links, heading, item = kind_of(nodes, block)
        own = weights[0] + weights[1] * words / 4 + weights[2] * mark + weights[3] * links / 10 + weights[4] * heading + weights[5] * item
        out.append(places[block.node] + named[block.node] + bare + max(-MOST, min(MOST, own)))
    return out


def seeds(html: str | None) -> list[tuple]:
    """(inside the main text, kind) of each block of a page that names its main text by an element, then (inside, place of a name's word, -1, ...) of the names around it."""
    nodes, blocks = parse(html or "")
    if not any(n.holds_main for n in nodes):
        return []
    places, found = _place_score(nodes), []
    for block in blocks:
        inside, at, words = int(places[block.node] > 0), block.node, set()
        for _ in range(NAME_DEPTH):
            words.update(_name_places(nodes[at]))
            if nodes[at].parent < 0 or nodes[at].tag in GOOD_ELEMENTS:
                break
            at = nodes[at].parent
        found += [(inside, *kind_of(nodes, block)), *((inside, w, -1, 0, 0, 0) for w in sorted(words))]
    return found


def name_scores(counts: Sequence[tuple]) -> tuple[float, ...]:
    """Log odds of each place of names' words, from (inside, place, number of blocks) and (inside, None, number of all blocks)."""
    held, total = np.zeros((2, NAME_PLACES)), np.zeros(2)
    for inside, place, n in counts:
        if place is None:
            total[inside] += n
        else:
            held[inside, place] += n
    if not total.all():
        return ()
    odds = np.log((held[1] + 1) / (total[1] + 2)) - np.log((held[0] + 1) / (total[0] + 2))
    seen = held.sum(axis=0)
    return tuple(np.clip(odds * seen / (seen + PRIOR_BLOCKS), -NAME_MOST, NAME_MOST).tolist())


def fitted(counts: Sequence[tuple]) -> tuple[float, ...]:
    """Weights from (inside, kind, number of blocks), by Newton's method; both sides weigh the same, and ``PRIOR`` counts for ``PRIOR_BLOCKS`` blocks."""
    prior = np.array(PRIOR)
    if not counts:
        return tuple(PRIOR)
    y, n = np.array([c[0] for c in counts], float), np.array([c[-1] for c in counts], float)
    design = np.hstack([np.ones((len(y), 1)), _design([c[1:-1] for c in counts])])
    for side in (0, 1):
        n[y == side] *= n.sum() / 2 / max(1.0, n[y == side].sum()) if (y == side).any() else 1
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + PRIOR_BLOCKS * np.eye(len(w))
        step = np.linalg.solve(hessian, design.T @ (n * (p - y)) + PRIOR_BLOCKS * (w - prior))
        w -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return tuple(float(x) for x in w)


def fit(df: DataFrame, id_col: str = "page_id", html_col: str = "html", pages: int = FIT_PAGES) -> Model:
    """What at most ``pages`` pages teach, those of the least hashes of ids; what comes to the driver is a count a kind of block and a place of names."""
    kind = ["inside", "words", "mark", "links", "heading", "item"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("html")
        for batch in by_bytes(batches, 0):
            found = Counter(x for html in batch.column(0).to_pylist() for x in seeds(html))
            columns = zip(*((*k, n) for k, n in found.items()), strict=True) if found else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[*kind, "n"])

    chosen = texts_of(df, sampled(df, pages, id_col), id_col, html_col).select("text")
    counted = chosen.mapInArrow(rows, ", ".join(f"{c} long" for c in [*kind, "n"])).groupBy(*kind).agg(F.sum("n").alias("n"))
    rows = sorted(tuple(r) for r in counted.collect())
    kinds = [r for r in rows if r[2] >= 0]
    return Model(fitted(kinds), name_scores([(r[0], None, r[-1]) for r in kinds] + [(r[0], r[1], r[-1]) for r in rows if r[2] < 0]))


def _distance(nodes: list[_Node], a: int, b: int) -> int:
    """Steps between two containers, up to ``FAR``."""
    steps = 0
    while a != b and steps < FAR:
        if nodes[a].depth < nodes[b].depth:
            a, b = b, a
        a = nodes[a].parent
        steps += 1
    return steps


def smoothness(nodes: list[_Node], blocks: list[_Block]) -> list[tuple[int, int, float]]:
    """(block, block, cost of labelling them differently)."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i and (steps := _distance(nodes, blocks[i - 1].node, block.node)) < FAR:
            edges.append((i - 1, i, ADJACENT * exp(-DECAY * steps)))
        parent = nodes[block.node].parent
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, KIN))
        last[parent] = i
    return edges


def min_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node lies on the source's side of the minimum cut: Dinic's max-flow, without recursion."""
    n = len(score)
    source, sink = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def join(a: int, b: int, forward: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forward)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(score):
        if s > 0:
            join(source, i, s, 0.0)
        elif s < 0:
            join(i, sink, -s, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            at = queue.popleft()
            for e in heads[at]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[at] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        following, path, at = [0] * (n + 2), [], source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(i for i, e in enumerate(path) if room[e] <= tiny)
                at = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while following[at] < len(heads[at]):
                e = heads[at][following[at]]
                if room[e] > tiny and level[to[e]] == level[at] + 1:
                    break
                following[at] += 1
            if following[at] < len(heads[at]):
                path.append(heads[at][following[at]])
                at = to[path[-1]]
            elif at == source:
                break
            else:
                level[at] = -1
                at = to[path.pop() ^ 1]


def main_text(html: str | None, model: Model | None = None) -> str:
    """The content blocks of a page, a line each."""
    if not html:
        return ""
    nodes, blocks = parse(html)
    keep = min_cut(scores(nodes, blocks, model), smoothness(nodes, blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def with_text(df: DataFrame, html_col: str = "html", name: str = "text", model: Model | None = None) -> DataFrame:
    """``df`` with the main text of every page in column ``name``."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only("html")
        for pages in batches:
            texts = [main_text(html, model) for part in by_bytes([pages]) for html in part.to_pylist()]
            yield pa.array(texts, pa.string())

    return df.withColumn(name, extract(F.col(html_col)))
