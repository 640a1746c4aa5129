"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A linear classifier on each block's length,
links, tags and attribute words gives the cost of calling it content or
boilerplate; these costs are the capacities to the two terminals. Neighbouring blocks
and blocks under the same container are tied by edges whose capacity is paid where
labels differ. The minimum cut labels all blocks of a page at once.

An attribute word such as "sidebar" speaks against the blocks of its element as far as the element is a small
part of the page: a wrapper that holds the page's text is not boilerplate for its name. The innermost element with
such a word counts, <article> and <main> without one end it, and words for content weigh against it.

A block whose terminal capacity outweighs all its edges is settled beforehand and passes its
label to its neighbours' capacities, which leaves most pages nothing to cut;
what remains goes through augmenting shortest paths. Pages are independent of each
other, so Spark deals them out without a shuffle.

Defined results: null or empty html gives an empty text; unclosed tags, stray ends and
cut-off markup are read as far as they go; a quote inside a tag opens a value only after "="; white space inside a block, line breaks
included, is one space; a page whose blocks are all boilerplate gives an empty text.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.tables import pick

# Element names of the HTML standard, by what they mean for text.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
# Elements and attribute words that speak for boilerplate or for content.
AWAY_TAGS = frozenset("nav header footer aside form dialog menu button fieldset address".split())
MAIN_TAGS = frozenset("article main".split())
AWAY_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies copyright disclaimer disqus dialog footer footnav form gdpr header login masthead menu meta modal nav "
    "navbar navigation newsletter notice notification overlay pager pagination popup privacy promo promoted recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription "
    "tags teaser toc toolbar topbar widget".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())

# The classifier's weights; a positive sum speaks for content.
WEIGHTS = {
    "bias": -0.6, "words": 0.09, "most_words": 2.2, "sentence": 0.8, "link_share": -4.5, "away": -9.0, "away_word": -6.0,
    "main": 2.5, "heading": 0.6, "paragraph": 0.7, "list_item": -0.4,
}
NEIGHBOUR = 0.8
SIBLING = 0.5
# What is left of an edge where only one end lies inside a boilerplate element; for words, in the measure of their weight.
ACROSS = 0.1

# An attribute of a tag: a quote opens a value only directly after the "=" of a name, elsewhere it is an ordinary character.
_NAME = r"[^\s/>][^\s/>=]*+"
_VALUE = r"""\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?!["'])[^\s>]*+)"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]++|{_NAME}(?:{_VALUE})?+)*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(rf"({_NAME})({_VALUE})?+", re.S)
_HINTS = frozenset("class id role itemprop hidden aria-hidden".split())
_WORD = re.compile(r"[a-z]+")
_CASE_STEP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block(NamedTuple):
    text: str
    linked: int
    tag: str
    away: bool
    main: bool
    parent: int
    # how much of the weight of an attribute word for boilerplate falls on the block, from 0 to 1
    doubt: float = 0.0


def _hints(attributes: str) -> tuple[bool, bool, bool]:
    """(is boilerplate by role or hidden, has a word for boilerplate, has one for content) from class, id and role."""
    away = word = main = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.lstrip("= \t\r\n\f").strip("\"'")
        if name not in _HINTS:
            continue
        words = _WORD.findall(_CASE_STEP.sub(" ", value).lower())
        if name == "role":
            away |= any(w in AWAY_ROLES for w in words)
        elif name == "hidden" or (name == "aria-hidden" and "true" in words):
            away = True
        else:
            word |= any(w in AWAY_WORDS for w in words)
            main |= any(w in MAIN_WORDS for w in words)
    return away, word, main


def blocks_of(html: str) -> list[Block]:
    """The page's blocks in order, each with the number of its container."""
    out: list[Block] = []
    # open elements: (tag, away, main, number, number of the innermost element with an attribute word for boilerplate,
    # the same unless <article> or <main> further in has ended it; 0 for none)
    stack: list[tuple[str, bool, bool, int, int, int]] = [("", False, False, 0, 0, 0)]
    # per element with such a word, the one around it, and the plain text in it
    around: dict[int, int] = {0: 0}
    plain: dict[int, int] = {0: 0}
    named: list[int] = []
    pieces: list[str] = []
    linked, links, numbers = 0, 0, 0

    def close_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                # the nearest element that is no inline element holds the block
                holder = next((e for e in reversed(stack) if e[0] not in INLINE), stack[0])
                below = next((e for e in reversed(stack) if e[3] < holder[3]), stack[0])
                away, main = stack[-1][1], stack[-1][2]
                parent = below[3] if holder[0] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td") else holder[3]
                out.append(Block(text, min(linked, len(text)), holder[0], away, main, parent))
                named.append(stack[-1][5])
                plain[stack[-1][4]] += 0 if away else len(text) - out[-1].linked
        linked = 0

    at, size = 0, len(html)
    for match in _TOKEN.finditer(html):
        low, high = match.span()
        if low < at:
            continue
        if low > at:
            piece = html[at:low]
            pieces.append(piece)
            linked += len(piece) if links else 0
        at = high
        tag = match.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if match.group(1):
            if tag not in INLINE:
                close_block()
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            # an end tag closes what it names; inline ends do not reach out of their block
            if depth and (tag not in INLINE or all(e[0] in INLINE for e in stack[depth:])):
                links -= sum(e[0] == "a" for e in stack[depth:])
                del stack[depth:]
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            close_block()
        if tag in RAW:
            if not match.group(0).endswith("/>"):
                end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(html, at)
                at = end.end() if end else size
            continue
        if tag in VOID or match.group(0).endswith("/>"):
            continue
        if tag in _ENDS_BEFORE:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in _ENDS_BEFORE[tag]), 0)
            if depth and not any(e[0] in _SCOPES for e in stack[depth + 1 :]):
                links -= sum(e[0] == "a" for e in stack[depth:])
                del stack[depth:]
        away, word, main = _hints(match.group(3)) if match.group(3) else (False, False, False)
        numbers += 1
        if tag == "header" and any(e[0] in MAIN_TAGS for e in stack):
            away_tag = False
        else:
            away_tag = tag in AWAY_TAGS
        body = tag in ("body", "html")
        above = stack[-1]
        away, word, main = above[1] or away_tag or (away and not body), word and not body, main and not body
        if word:
            around[numbers], plain[numbers] = above[4], 0
            inside = counted = numbers
        else:
            main |= above[2] or tag in MAIN_TAGS
            inside, counted = above[4], 0 if tag in MAIN_TAGS else above[5]
        stack.append((tag, away, main, numbers, inside, counted))
        links += tag == "a"
    if at < size:
        pieces.append(html[at:])
    close_block()
    # an element around another has the smaller number
    for number in sorted(around, reverse=True)[:-1]:
        plain[around[number]] += plain[number]
    return [b._replace(doubt=1 - plain[k] / max(plain[0], 1)) if k else b for b, k in zip(out, named, strict=True)]


# Start tags that end an open element of these kinds, and the elements that search does not leave (fixed values).
_CLOSES_P = (
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul"
).split()
_ENDS_BEFORE = {tag: frozenset(["p"]) for tag in _CLOSES_P} | {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
_SCOPES = frozenset("article aside body div footer header main nav ol section table ul".split())


def block_weight(block: Block) -> float:
    """The classifier: how much it costs to call the block boilerplate (positive) or content (negative)."""
    w, words = WEIGHTS, block.text.count(" ") + 1
    total = w["bias"] + min(w["words"] * words, w["most_words"])
    total += w["sentence"] * (block.text[-1] in ".!?。…:\"”")
    total += w["link_share"] * block.linked / len(block.text)
    total += w["away"] * block.away + w["away_word"] * block.doubt + w["main"] * (block.main and not block.away)
    total += w["heading"] * (block.tag[:1] == "h" and block.tag[1:].isdigit())
    total += w["paragraph"] * (block.tag in ("p", "pre", "blockquote")) + w["list_item"] * (block.tag == "li")
    return total


def min_cut(weights: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the weights of wrong labels plus the capacities of edges between unlike labels.

    A node of positive weight pays it when labelled False, one of negative weight when True. Ties go to False.
    """
    n = len(weights)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, capacity in edges:
        near[a][b] = near[a].get(b, 0.0) + capacity
        near[b][a] = near[b].get(a, 0.0) + capacity
    weight, label = list(weights), [None] * n
    strength = [sum(x.values()) for x in near]
    settled = deque(i for i in range(n) if abs(weight[i]) >= strength[i])
    while settled:
        i = settled.popleft()
        if label[i] is not None or abs(weight[i]) < strength[i]:
            continue
        label[i] = weight[i] > 0
        for j, capacity in near[i].items():
            if label[j] is None:
                weight[j] += capacity if label[i] else -capacity
                strength[j] -= capacity
                if abs(weight[j]) >= strength[j] - 1e-12:
                    strength[j] = min(strength[j], abs(weight[j]))
                    settled.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _max_flow(rest, weight, near, label)
        for i in rest:
            label[i] = i in side
    return label


def _max_flow(nodes: list[int], weight: list[float], near: list[dict[int, float]], label: list) -> set[int]:
    """The source side of a minimum cut, by augmenting shortest paths from positive to negative nodes."""
    spare = {i: {j: c for j, c in near[i].items() if label[j] is None} for i in nodes}
    supply = {i: max(weight[i], 0.0) for i in nodes}
    demand = {i: max(-weight[i], 0.0) for i in nodes}
    while True:
        came: dict[int, int] = {i: -1 for i in nodes if supply[i] > 1e-12}
        queue, goal = deque(came), None
        while queue and goal is None:
            i = queue.popleft()
            if demand[i] > 1e-12:
                goal = i
                break
            for j, c in spare[i].items():
                if c > 1e-12 and j not in came:
                    came[j] = i
                    queue.append(j)
        if goal is None:
            return set(came)
        path = [goal]
        while came[path[-1]] >= 0:
            path.append(came[path[-1]])
        push = min([supply[path[-1]], demand[goal], *(spare[b][a] for a, b in zip(path, path[1:], strict=False))])
        supply[path[-1]] -= push
        demand[goal] -= push
        for a, b in zip(path, path[1:], strict=False):
            spare[b][a] -= push
            spare[a][b] = spare[a].get(b, 0.0) + push


def main_text(html: str | None) -> str:
    """The content blocks of a page, one per line."""
    blocks = blocks_of(html or "")
    weights = [block_weight(b) for b in blocks]
    ties = [(i, i + 1, NEIGHBOUR) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        # blocks of one container form a chain, which ties them as the container's members
        if block.parent in last:
            ties.append((last[block.parent], i, SIBLING))
        last[block.parent] = i
    pulls = [1.0 if block.away else block.doubt for block in blocks]
    edges = [(a, b, c * max(ACROSS, 1 - abs(pulls[a] - pulls[b]))) for a, b, c in ties]
    labels = min_cut(weights, edges)
    return "\n".join(b.text for b, keep in zip(blocks, labels, strict=True) if keep)


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row."""
    source = pick(pages, page_id=page_id, url=url, html=html)
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.record_batch(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                }
            )

    return source.mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
