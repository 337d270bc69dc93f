"""Main text of web pages by minimum cut.

A page becomes text blocks.  A linear classifier of tag, class, link and length
features gives each block its log-odds of being content: the capacity of its edge to
one terminal.  Neighbouring blocks, and blocks under one parent, are joined by edges
that weigh less the farther apart they lie in the DOM.  The cheapest cut parts
content from boilerplate.  A page is one row, so Spark spreads pages over tasks.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.llm._common import map_arrow
from linewell.llm._words import text_chunks

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|title|svg|annotation|textarea|select|iframe|object|canvas|video|audio)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    # Attributes with closed quotes up to a >, else whatever comes before the next > or the end: each read once.
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+>?", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br input button "
    "math mfrac mi mn mo mover mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover semantics".split())
_CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol p pre section table ul".split())
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
#: Words of class, id and role names that speak against content, or for it.
BOILERPLATE = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay sidebar side aside menu menus nav navbar navigation breadcrumb "
    "breadcrumbs header masthead topbar footer foot bottombar copyright legal share sharing social related recommended "
    "recommendations comment comments reply replies respond disqus discussion newsletter subscribe subscription signup "
    "login search form widget tags pager pagination toolbar skip hidden complementary contentinfo dialog".split())
CONTENT = frozenset("article content main post entry story body text".split())
#: Log-odds of the features; regions hold for all that lies in them.
WEIGHTS = {
    "bias": -0.4, "long": 1.6, "sentence": 0.6, "links": -3.0, "heading": 0.6, "paragraph": 0.6,
    "article": 3.0, "named content": 1.0, "boilerplate": -7.0,
}
SMOOTH, SAME_PARENT = 1.2, 0.6
_MODIFIERS = frozenset("has with no without".split())
_REGIONS = frozenset("nav footer aside form menu dialog fieldset head".split())


class Block:
    __slots__ = ("parts", "linked", "region", "article", "named", "tag", "parent", "depth")

    def __init__(self, node):
        self.parts, self.linked = [], 0
        self.tag, _, self.region, self.article, self.named, self.parent, self.depth = node


def blocks_of(page: str) -> list[tuple[str, Block]]:
    """(text, block) of all blocks that hold text, in page order."""
    # An open element: tag, inside link, in boilerplate, in article, in named content, number, depth.
    stack = [("", False, False, False, False, 0, 0)]
    opened: dict[str, int] = {}
    out, numbers, at = [], 0, 0
    block = Block(stack[0])

    def flush():
        nonlocal block
        text = " ".join(entities.unescape("".join(block.parts)).split())
        if text:
            out.append((text, block))
        holder = next((x for x in reversed(stack) if x[0] not in _INLINE), stack[0])
        block = Block(holder)

    def pop_to(tag):
        while stack[-1][0] != tag:
            opened[stack[-1][0]] -= 1
            stack.pop()
        opened[tag] -= 1
        stack.pop()

    def open_inline(name):
        """Is an element of the name open inside the block at hand?"""
        for x in reversed(stack):
            if x[0] == name or x[0] not in _INLINE:
                return x[0] == name

    def add(text):
        if text:
            block.parts.append(text)
            if stack[-1][1]:
                block.linked += len(text)

    for token in _TOKEN.finditer(page):
        add(page[at:token.start()])
        at = token.end()
        name = token[3]
        if name is None:
            if token[1] and token[1].lower() not in ("script", "style", "noscript", "template", "title"):
                add(" ")
            continue
        name = name.lower()
        if name == "br":
            add(" ")
            continue
        if token[2]:
            if opened.get(name):
                if name not in _INLINE:
                    pop_to_inline = name
                    flush()
                    pop_to(pop_to_inline)
                    flush()
                elif open_inline(name):
                    kept = []
                    while stack[-1][0] != name:
                        if stack[-1][0] not in _INLINE:
                            break
                        kept.append(stack.pop())
                    if stack[-1][0] == name:
                        opened[name] -= 1
                        stack.pop()
                    for x in reversed(kept):  # they go on, without the link that ends here
                        stack.append((x[0], stack[-1][1] or x[0] == "a", *x[2:]))
            elif name not in _INLINE:
                flush()
            continue
        if name in _VOID:
            if name not in _INLINE:
                flush()
            continue
        inline = name in _INLINE
        if not inline:
            flush()
            closes = _CLOSES.get(name, set())
            if name in _ENDS_P and opened.get("p"):
                closes = closes | {"p"}
            for k in range(len(stack) - 1, 0, -1) if any(opened.get(c) for c in closes) else ():
                if stack[k][0] in closes:
                    pop_to(stack[k][0])
                    break
                if stack[k][0] not in _INLINE:
                    break
        _, link, region, article, named, _, depth = stack[-1]
        if not inline or token[4]:
            tokens: set[str] = set()
            for kind, value in _ATTRIBUTE.findall(token[4] or ""):
                kind = kind.lower()
                if kind in ("class", "id", "role"):
                    tokens.update(_SPLIT.split(value.lower()))
                elif kind == "hidden" or kind == "aria-hidden" and "true" in value.lower() or \
                        kind == "style" and re.search(r"display\s*:\s*none", value, re.I):
                    tokens.add("hidden")
            if name in ("article", "main") or "article" in tokens and not tokens & BOILERPLATE:
                article = True
            against = tokens & BOILERPLATE
            if tokens & _MODIFIERS or against == {"header"} and tokens & CONTENT:
                against = set()  # "has-sidebar" tells of the page, "entry-header" is the article's own
            if against and name not in ("html", "body", "article", "main"):
                region = True
            elif tokens & CONTENT:
                named = True
        if name in _REGIONS or name == "header" and not article:
            region = True
        numbers += 1
        opened[name] = opened.get(name, 0) + 1
        stack.append((name, link or name == "a", region, article, named, numbers, depth + 1))
        if not inline:
            block = Block(stack[-1])
    add(page[at:] if "<" not in page[at:] else re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", page[at:]))
    flush()
    return out


def log_odds(text: str, block: Block) -> float:
    """The classifier: how much likelier content is than boilerplate, as a logarithm."""
    w, n = WEIGHTS, len(text)
    score = w["bias"] + w["long"] * min(1.0, n / 120) + w["links"] * min(1.0, block.linked / n)
    score += w["sentence"] * (text[-1] in ".!?…\"'”") + w["heading"] * (block.tag in ("h1", "h2", "h3"))
    score += w["paragraph"] * (block.tag in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"))
    score += w["article"] * block.article + w["named content"] * block.named
    return score + w["boilerplate"] * block.region


def min_cut(terminal: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut.

    ``terminal[i]`` > 0 is the capacity from the source to i, < 0 that from i to the
    sink.  A node whose terminal outweighs all its edges is settled at once and its
    edges become capacities of its neighbours; what is left is solved by augmenting
    along shortest paths.  Equal cuts go to the sink side.
    """
    terminal, near = list(terminal), [{} for _ in terminal]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    side: list[bool | None] = [None] * len(terminal)
    todo = deque(range(len(terminal)))
    while todo:
        i = todo.popleft()
        if side[i] is None and abs(terminal[i]) >= sum(near[i].values()):
            side[i] = terminal[i] > 0
            for j, w in near[i].items():
                terminal[j] += w if side[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    rest = [i for i, s in enumerate(side) if s is None]
    while True:
        # Breadth first from all nodes with capacity left from the source.
        back = {i: i for i in rest if terminal[i] > 1e-9}
        queue, end = deque(back), None
        while queue and end is None:
            i = queue.popleft()
            for j, w in near[i].items():
                if w > 1e-9 and j not in back:
                    back[j] = i
                    if terminal[j] < -1e-9:
                        end = j
                        break
                    queue.append(j)
        if end is None:
            break
        path = [end]
        while back[path[-1]] != path[-1]:
            path.append(back[path[-1]])
        path.reverse()
        flow = min(terminal[path[0]], -terminal[end], *(near[a][b] for a, b in zip(path[:-1], path[1:], strict=True)))
        terminal[path[0]] -= flow
        terminal[end] += flow
        for a, b in zip(path[:-1], path[1:], strict=True):
            near[a][b] -= flow
            near[b][a] = near[b].get(a, 0.0) + flow
    for i in rest:
        side[i] = i in back
    return [bool(s) for s in side]


def extract(page: str | None) -> str:
    """The main text of one page: its content blocks, one a line."""
    blocks = blocks_of(page or "")
    edges: dict[tuple[int, int], float] = {}
    last_under: dict[int, int] = {}
    for i, (_, block) in enumerate(blocks):
        if i:
            apart = abs(block.depth - blocks[i - 1][1].depth) + (block.parent != blocks[i - 1][1].parent)
            edges[i - 1, i] = SMOOTH / (1 + apart)
        before = last_under.get(block.parent)
        if before is not None and before < i - 1:
            edges[before, i] = SAME_PARENT
        last_under[block.parent] = i
    content = min_cut([log_odds(t, b) for t, b in blocks], edges)
    return "\n".join(t for (t, _), keep in zip(blocks, content, strict=True) if keep)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_chunks(batch, "html"):
            text = pa.array([extract(x) for x in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), text], names=["id", "url", "text"])


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id, url, text`` for every row of ``pages``; a null or empty page has an empty text.

    Pages that break off are read to their end; unknown tags are blocks.  Repeated rows
    are worked each.  Other columns are not read, so their names clash with nothing.
    """
    narrow = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = dict(narrow.dtypes)
    return map_arrow(narrow, _extract, f"id {kinds['id']}, url {kinds['url']}, text string")
