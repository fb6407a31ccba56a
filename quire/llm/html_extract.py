"""HTML extraction: blocks are labelled content or boilerplate by a minimum cut."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_STOP = re.compile(r"""[>"']""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ABOUT = re.compile(r"(?:has|with|no|without|is|show|hide)[-_]")  # such names speak of something else than the element's own text
_SPACE = re.compile(r"\s+")

RAW = frozenset("script style template noscript textarea select iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body p div section article main header footer nav aside form fieldset h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr "
    "caption blockquote pre figure figcaption address details summary hr center menu dialog hgroup search legend label button".split()
)
#: A start tag of the key ends open elements of the value, up to a container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "body": {"head"}}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
SCOPES = frozenset("ul ol dl table div section article main body".split())

#: What a container says about the text in it, as log-odds for content.
TAG_ODDS = {
    "article": 3.0, "main": 2.5, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "header": -4.0, "menu": -9.0, "dialog": -9.0,
    "button": -9.0, "label": -5.0, "fieldset": -9.0, "head": -12.0, "search": -9.0, "figure": 0.0, "address": -2.0,
}
#: Names of elements: words that speak for an article, words for boilerplate, and words that say nothing by themselves.
GOOD = frozenset("article articlebody content post entry story main maincontent body text prose page".split())
BAD = frozenset(
    "ad ads adv advert adverts advertisement adsense banner promo promotion sponsor sponsored sponsors nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer masthead sidebar rail widget widgets related recommended recommendation recommendations share sharing social follow "
    "comment comments commentlist reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay "
    "subscribe subscription newsletter signup login search form copyright disclaimer pagination pager tags toolbar skip complementary contentinfo".split()
)
PLAIN = frozenset(
    "site global page main top bottom left right inner outer box block bar area section container wrapper wrap list item items links link group row col column "
    "posts articles stories slot unit button buttons icons icon title heading primary secondary content thread form media bottom widget text policy info legal and".split()
)
#: A header with such a name holds the article's title.
TITLED = frozenset("article post entry story content".split())
#: What a name takes away or adds, and how much all containers may add up to either way.
NAMED_BAD, NAMED_GOOD, CAP = 9.5, 2.5, 12.0
LEAF_ODDS = {"p": 1.5, "h1": 1.0, "h2": 0.7, "h3": 0.7, "h4": 0.5, "blockquote": 1.0, "pre": 1.0, "li": -0.5, "dt": -0.3, "dd": -0.3, "tr": -0.3, "td": -0.3, "div": -0.3}
#: Smoothness: next block with the same parent, next block elsewhere, previous block under the same grandparent.
SAME, NEXT, NEAR = 1.5, 0.3, 0.5


class Block:
    __slots__ = ("grand", "linked", "odds", "parent", "tag", "text")

    def __init__(self, text: str, linked: int, tag: str, odds: float, parent: int, grand: int):
        self.text, self.linked, self.tag, self.odds, self.parent, self.grand = text, linked, tag, odds, parent, grand


def _speaks_of_boilerplate(name: str) -> bool:
    """Whether every word of an element's name is for boilerplate or says nothing, and one is for it: related-posts, not related-work."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    bad = [w for w in words if w in BAD or w == "header"]
    return bool(bad) and all(w in BAD or w in PLAIN or w == "header" for w in words) and not ("header" in bad and len(bad) == 1 and TITLED & set(words))


def _container_odds(tag: str, attributes: str, within: float) -> float:
    odds = TAG_ODDS.get(tag, 0.0)
    if tag == "header" and within > 1.5:
        odds = -1.5  # a header inside the article may hold its title
    if attributes and tag not in ("html", "body"):
        names = [re.sub(r"(?<=[a-z])(?=[A-Z])", "-", n).lower() for m in _NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").split()]
        names = [n for n in names if not _ABOUT.match(n)]
        if tag not in ("article", "main") and any(map(_speaks_of_boilerplate, names)):
            odds -= NAMED_BAD
        elif odds >= 0 and any(w in GOOD for n in names for w in re.split(r"[^a-z]+", n)):
            odds += NAMED_GOOD
    return odds


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, tag, attributes) of tags, comments and declarations ("" as tag); the caller may send a place to go on from.

    A tag ends at the first > outside quotes. One that never does ends at the next <. Such searches in vain
    are given up once they have read the page twice; then any > ends a tag, so the time stays linear.
    """
    at, vain, size = 0, 0, len(page)
    last = page.rfind(">")
    while m := _OPEN.search(page, at):
        at = m.end()
        if page.startswith("<!--", m.start()):
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            yield m.start(), at, False, "", ""
            continue
        end, k = -1, at
        if vain >= 2 * size or not m[2]:
            end = page.find(">", at) + 1 or -1 if at <= last else -1
        else:
            while stop := _STOP.search(page, k):
                if stop[0] == ">":
                    end = stop.end()
                    break
                k = page.find(stop[0], stop.end()) + 1
                if not k:
                    break
        if end < 0:
            vain += size - at
            end = page.find("<", at)
            end = size if end < 0 else end
        attributes, at = page[at : max(at, end - 1)] if m[2] else "", end
        skip = yield m.start(), end, bool(m[1]), (m[2] or "").lower(), attributes
        if skip is not None:
            at = skip
            yield at, at, False, "", ""  # the answer to send


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; malformed markup is taken as browsers do where that is simple."""
    out: list[Block] = []
    opened: list[tuple[str, float, int]] = [("", 0.0, 0)]  # tag, log-odds from here up, number
    parts: list[str] = []
    links = number = linked = 0

    open_now: Counter[str] = Counter()

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip() if parts else ""
        if text:
            tag, odds, own = opened[-1]
            leaf = tag in LEAF_ODDS and len(opened) > 1
            out.append(Block(text, linked, tag, odds, opened[-2][2] if leaf else own, opened[-3][2] if leaf and len(opened) > 2 else opened[-2][2] if len(opened) > 1 else 0))
        parts.clear()
        linked = 0

    def close(k: int) -> None:
        flush()
        open_now.subtract(x[0] for x in opened[k:])
        del opened[k:]

    at, tags = 0, _tags(page)
    for start, end, closing, tag, attributes in tags:
        if start > at:
            text = page[at:start]
            parts.append(text)
            linked += len(text) if links else 0
        at = end
        if not tag:
            continue
        if closing:
            if tag == "a":
                links = 0
            elif tag in BLOCKS:
                if open_now[tag] > 0:
                    close(next(k for k in range(len(opened) - 1, 0, -1) if opened[k][0] == tag))
            elif tag in ("td", "th"):
                parts.append(" ")
            continue
        if tag in RAW:
            raw = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = raw.end() if raw else len(page)
            tags.send(at)
            continue
        if tag == "a":
            links = 1
        elif tag in ("br", "td", "th", "img"):
            parts.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCKS:
            flush()
            if opened[-1][0] == "p" or opened[-1][0] in HEADINGS and tag in (*HEADINGS, "p"):
                close(len(opened) - 1)
            ends = CLOSES.get(tag, ())
            if any(open_now[x] > 0 for x in ends):
                for k in range(len(opened) - 1, 0, -1):
                    if opened[k][0] in ends:
                        close(k)
                        break
                    if opened[k][0] in SCOPES:
                        break
            number += 1
            up = opened[-1][1]
            opened.append((tag, max(-CAP, min(CAP, up + _container_odds(tag, attributes, up))), number))
            open_now[tag] += 1
            links = 0
    parts.append(page[at:])
    flush()
    return out


def log_odds(b: Block) -> float:
    """The classifier: log-odds that a block is content, from its length, sentences, links, tag and containers."""
    n = len(b.text)
    ends = sum(b.text.count(c) for c in ".!?。！？")
    return -1.5 + min(n, 400) / 133 + 0.4 * min(ends, 5) - 6.0 * min(1.0, b.linked / n) + LEAF_ODDS.get(b.tag, 0.0) + b.odds


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Which nodes stay with the source when source and sink are cut apart at least cost.

    Labelling node k boilerplate costs log(1 + e^odds), content log(1 + e^-odds); an edge costs its weight if
    its ends differ. A node whose own difference of costs outweighs its edges has that label in some minimum
    cut, so such nodes are settled first and their edges folded into their neighbours' costs; Dinic's algorithm cuts the rest.
    """
    n = len(odds)
    bias, near = list(odds), [dict() for _ in range(n)]  # log(1+e^z) - log(1+e^-z) = z
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if label[k] is None and abs(bias[k]) >= sum(near[k].values()):
            label[k] = bias[k] > 0
            for j, w in near[k].items():
                bias[j] += w if label[k] else -w
                del near[j][k]
                queue.append(j)
    rest = [k for k in range(n) if label[k] is None]
    if rest:
        content = _dinic(rest, bias, near)
        for k in rest:
            label[k] = k in content
    return [bool(x) for x in label]


def _dinic(nodes: list[int], bias: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side of a minimum cut."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {k: dict(near[k]) for k in nodes} | {s: {}, t: {}}
    for k in nodes:
        a, b = (s, k) if bias[k] > 0 else (k, t)
        cap[a][b] = abs(bias[k])
        cap[b].setdefault(a, 0.0)
    tiny = 1e-9
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            return {k for k in level if k >= 0}
        rest = {u: list(cap[u]) for u in level}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))  # noqa: B905
                for a, b in zip(path, path[1:]):  # noqa: B905
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                path = [s]
                continue
            while rest[u]:
                v = rest[u][-1]
                if cap[u][v] > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
                rest[u].pop()
            else:
                path.pop()
                if path:
                    rest[path[-1]].pop()


def extract(page: str) -> str:
    """The main text of a page: content blocks in page order, joined by an empty line."""
    found = blocks(page)
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if k:
            edges[k - 1, k] = SAME if found[k - 1].parent == b.parent else NEXT
        if b.grand in last and last[b.grand] < k - 1:
            edges[last[b.grand], k] = NEAR
        last[b.grand] = k
    keep = minimum_cut([max(-30.0, min(30.0, log_odds(b))) for b in found], edges)
    return "\n\n".join(b.text for b, kept in zip(found, keep, strict=True) if kept)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Every row of pages with text and n_chars (code points), html_col left out.

    Null and empty pages, and pages without content, have an empty text. Other columns pass through, repeated rows too; columns named
    text or n_chars are replaced. An empty table gives an empty result. Rows are independent: no shuffle; memory follows the longest page.
    """
    rest = [c for c in pages.columns if c.lower() not in ("text", "n_chars", html_col.lower())]
    schema = T.StructType([*(pages.schema[c] for c in rest), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "") for x in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return pages.select(*rest, html_col).mapInArrow(run, schema)
