"""Operator 5: main text of web pages by minimum-cut labelling of blocks."""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import per_batch

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>))|[^>=])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""",
                    re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Elements that stand inside a line; all others end a block (fixed values).
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are never text of the page.
SKIPPED = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math select button object "
                    "audio video canvas datalist".split())
#: An opening tag here closes an open element of the set, up to a container.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table article section div main aside nav header footer form body blockquote".split())

#: Evidence of elements and of words in class, id and role (log-odds; positive: content).
TAG_WEIGHT = {"article": 6.0, "main": 4.0, "nav": -8.0, "footer": -8.0, "aside": -7.0, "header": -6.0, "form": -8.0, "menu": -8.0,
              "dialog": -8.0, "address": -2.0, "fieldset": -6.0}
WORD_WEIGHT = {
    **dict.fromkeys("article post entry story content main body text prose".split(), 2.0),
    **dict.fromkeys("nav navigation navbar menu sidebar aside footer header masthead banner contentinfo complementary ad ads advert "
                    "adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal "
                    "dialog overlay newsletter subscribe subscription signup login share sharing social related recommended "
                    "recommendations breadcrumb breadcrumbs pagination pager comment comments commentlist disqus reply replies "
                    "respond discussion search form widget toolbar skip copyright legal disclaimer tags toc outbrain taboola "
                    "paywall rating".split(), -8.0)}
#: Elements that usually hold sentences.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td dd figcaption".split())
#: How much less an element counts for each telling element inside it.
FADE = 0.4
#: Smoothness between neighbours in page order (divided by 1 + their distance in
#: the tree) and between successive blocks of one parent.
NEXT_WEIGHT, SIBLING_WEIGHT = 1.5, 1.0


@dataclass
class Block:
    text: str
    cost: float  # log-odds of content
    path: tuple[int, ...]  # element numbers from the root


def _hidden(attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower().replace(" ", "")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and ("display:none" in value or "visibility:hidden" in value):
            return True
    return False


def _element_weight(tag: str, attributes: str, inside: bool) -> float:
    """Evidence of one element; a header inside an article is the article's own."""
    weight = TAG_WEIGHT.get(tag, 0.0)
    if tag == "header" and inside:
        weight = 0.0
    if attributes and weight <= 0 and tag != "body":
        for name, value in _ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id", "role"):
                for word in _PIECES.findall(value):
                    found = WORD_WEIGHT.get(word.lower(), 0.0)
                    if inside and found < 0 and word.lower() in ("header", "tags", "text"):
                        found = 0.0
                    weight = min(weight, found) if found < 0 else weight if weight < 0 else max(weight, found)
    return weight


def _block_cost(text: str, linked: int, tag: str, evidence: Sequence[float]) -> float:
    words = text.count(" ") + 1
    cost = min(words, 40) / 20 - (0.25 if tag in PROSE else 0.6)
    cost -= 4.0 * min(1.0, linked / max(1, len(text)))
    if text[-1] in ".!?:;\"”»…":
        cost += 0.5
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        cost += 0.5
    if "©" in text[:20]:
        cost -= 3.0
    scale = 1.0
    for weight in reversed(evidence):
        if weight:
            cost += scale * weight
            scale *= FADE
    return cost


def parse_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with their costs and places in the tree.

    Missing end tags are supplied as browsers do for paragraphs, list items and
    table cells; stray end tags are ignored; an unfinished comment, script or the
    like runs to the end of the page.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, int, float]] = []  # tag, number, evidence
    parts: list[str] = []
    serial, linked, in_link, skip, articles = 0, 0, 0, 0, 0

    def close_block():
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text and not skip:
            tag = stack[-1][0] if stack else ""
            blocks.append(Block(text, _block_cost(text, linked, tag, [w for _, _, w in stack if w]), tuple(n for _, n, _ in stack)))
        linked = 0

    def pop_to(depth: int):
        nonlocal skip, articles
        while len(stack) > depth:
            tag, _, weight = stack.pop()
            skip -= weight == _GONE
            articles -= tag in ("article", "main")

    at, n, last = 0, len(page), page.rfind(">") + 1      # no tag ends beyond ``last``
    while at < n:
        m = _TOKEN.search(page, at, last) if at < last else None
        if m is None:
            parts.append(page[at:].split("<!--", 1)[0])
            break
        if m.start() > at:
            piece = page[at:m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = n if m.group().startswith("<!--") and not m.group().endswith("-->") else m.end()
        closing, tag, attributes = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if closing else 1
            continue
        close_block()
        in_link = 0
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if tag == "p" and stack[depth][0] in CONTAINERS:
                    break
            continue
        if tag in SKIPPED:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        if tag == "body" or tag == "html":
            if tag == "body":
                pop_to(0)
        elif tag == "head":
            end = re.compile(r"</head\s*>|<body", re.I).search(page, at)
            at = end.start() if end else at
        for closed in (CLOSES.get(tag, {"p"}),):
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in closed:
                    pop_to(depth)
                    break
                if stack[depth][0] in CONTAINERS:
                    break
        serial += 1
        weight = _GONE if _hidden(attributes) else _element_weight(tag, attributes, articles > 0)
        skip += weight == _GONE
        articles += tag in ("article", "main")
        stack.append((tag, serial, weight))
    close_block()
    return blocks


_GONE = float("-inf")


def smoothness(blocks: Sequence[Block]) -> list[tuple[int, int, float]]:
    """Edges (i, j, weight): each block with the next in page order, the less the
    further apart they are in the tree, and with the two before it under the same
    parent; the more their costs differ, the weaker the tie."""
    def tie(i: int, j: int, weight: float) -> float:
        return weight / (1.0 + abs(blocks[i].cost - blocks[j].cost))

    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            a, b = blocks[i - 1].path[:-1], block.path[:-1]
            common = 0
            for x, y in zip(a, b):
                if x != y:
                    break
                common += 1
            edges.append((i - 1, i, tie(i - 1, i, NEXT_WEIGHT / (1 + len(a) + len(b) - 2 * common))))
        siblings = last.setdefault(block.path[:-1], [])
        edges.extend((j, i, tie(j, i, SIBLING_WEIGHT)) for j in siblings[-2:] if j != i - 1)
        siblings.append(i)
    return edges


def minimum_cut(costs: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """Label the nodes (True: source side) at least total cost: a positive cost is
    paid by a node on the sink side, a negative one by a node on the source side,
    an edge's weight when it is cut.  Of several least cuts the one with the fewest
    source nodes is taken.

    Maximum flow by shortest augmenting paths from nodes that still have supply to
    nodes that still have demand.
    """
    n = len(costs)
    supply = [max(c, 0.0) for c in costs]
    demand = [max(-c, 0.0) for c in costs]
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        room[i][j] = room[i].get(j, 0.0) + w
        room[j][i] = room[j].get(i, 0.0) + w
    tiny = 1e-9
    while True:
        origin = {i: i for i in range(n) if supply[i] > tiny}
        queue, end = deque(origin), -1
        while queue and end < 0:
            i = queue.popleft()
            for j, w in room[i].items():
                if w > tiny and j not in origin:
                    origin[j] = i
                    if demand[j] > tiny:
                        end = j
                        break
                    queue.append(j)
        if end < 0:
            return [i in origin for i in range(n)]
        path = [end]
        while origin[path[-1]] != path[-1]:
            path.append(origin[path[-1]])
        push = min(supply[path[-1]], demand[end], *(room[b][a] for a, b in zip(path, path[1:])))
        supply[path[-1]] -= push
        demand[end] -= push
        for a, b in zip(path, path[1:]):
            room[b][a] -= push
            room[a][b] = room[a].get(b, 0.0) + push


def main_text(page: str | None) -> str:
    blocks = parse_blocks(page or "")
    keep = minimum_cut([b.cost for b in blocks], smoothness(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_pages(pages: DataFrame, html: str = "html", carry: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The columns ``carry``, ``text`` and ``n_chars`` (code points), one row per page.

    Every block's classifier cost (elements around it, words of their class, id and
    role, share of linked text, length) becomes its terminal capacity; neighbours
    in page order and in the tree are tied by smoothness edges; the minimum cut
    separates content from the rest, and content blocks are joined in page order by
    an empty line.  Nothing is dropped or capped inside a content block.

    Null html counts as empty: empty text, 0 characters.  Repeated pages are
    extracted each; an empty table gives no rows.  Row by row, without a shuffle.
    """
    kinds = dict(pages.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in carry), "text string", "n_chars long"])

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [main_text(p.as_py()) for p in batch.column(0)]
        yield {c: batch.column(i + 1) for i, c in enumerate(carry)} | {
            "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return per_batch(pages.select(F.col(html).alias("__html"), *carry), schema, make)
