"""Main-text extraction by minimum cut.

A page becomes its text blocks in page order. A classifier gives each block a cost from its text: length, end of a
sentence and link share, towards content (capacity from the source) or boilerplate (to the sink). Telling ancestors
(article or main against menus, headers, footers, sidebars, notices, adverts, forms and reader comments) form regions, nodes
of their own with graded costs by element and by words of class, id and role. Smoothness edges tie blocks to their region,
neighbours on the page, blocks of one parent, and regions to the region around them (DOM proximity). The minimum cut, found by
maximum flow (Dinic), separates content from boilerplate: a short heading stays with its article, a long reader's
comment goes with its section, and a region with a weak name but running text is kept.

Where a tie is worth more than all else that a block has, both have the same label in a minimum cut, so such blocks are merged
with their region before the flow (``_merged``); a part of the graph whose costs all have one sign is cut for nothing.

A map over partitions: no shuffle; a worker holds one batch.

Defined cases. A null html is empty and gives an empty text. Unclosed elements end with their parent, unclosed
comments, scripts and styles with the page; an unclosed embedded object (audio, video and the like) hides nothing. Hidden
elements, and adverts, notices and the like inside a paragraph, are left out of its text. White space of any kind inside a block becomes one space. Repeated rows are
extracted one by one; an empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<!--|<!\[CDATA\[|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")

#: Raw to the end of the page if they aren't closed.
_ENDLESS = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes"}
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "object", "noembed", "noframes", "math", "canvas", "audio", "video"}
_RCDATA = {"title", "textarea"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "picture", "nobr",
}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_CLOSED_BY_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Elements that decide alone, and words of class, id or role that do.
_BAD_TAGS = {"nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "fieldset", "textarea", "input", "title", "head", "label"}
_GOOD_TAGS = {"article", "main"}
_BAD_WORDS = {
    "aside", "complementary", "contentinfo", "topbar", "toolbar", "ad", "ads", "banner", "consent", "notice", "notices", "alert", "overlay", "subscription", "signup", "login", "share", "sharing",
    "social", "related", "recommended", "recommendations", "widget", "pagination", "pager", "copyright", "legal", "disclaimer", "search", "form", "hidden", "header", "dialog",
}
#: These tell in any company ("user-comments"), the others above only by themselves or beside their like ("search-box").
_TELLING = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "advert", "advertisement", "adverts", "adsense", "promo", "promotion", "sponsor", "sponsored",
    "cookie", "cookies", "gdpr", "popup", "modal", "newsletter", "subscribe", "comment", "comments", "reply", "replies", "disqus", "respond",
}
_SUFFIXES = {"", "box", "bar", "list", "section", "container", "wrapper", "wrap", "block", "area", "links", "link", "inner", "outer", "top", "bottom", "left", "right", "site", "page", "main", "global", "panel", "row", "item", "items", "buttons", "button", "slot", "unit"}
_GOOD_WORDS = {"article", "articlebody", "entry", "story", "post", "main", "content", "body", "text", "prose"}
_EXEMPT = {"html", "body", "article", "main"}

#: Costs a block: regions by element or clear words, by unclear words; text.
CLEAR, UNCLEAR, LINKED, LONG, SHORT = 3.0, 0.75, 2.0, 1.5, 0.5
#: Edges: a block and its region, neighbours and siblings outside of regions, neighbours across regions, a region and the one around it.
TIE, NEIGHBOUR, SIBLING, ACROSS, AROUND = 12.0, 0.75, 1.0, 0.25, 0.5


@dataclass
class Block:
    text: str
    linked: int
    parent: int
    region: int
    cue: float  # a block of the region's cost
    around: int


@dataclass
class _Element:
    tag: str
    number: int
    region: int  # nearest telling ancestor or self; 0: none
    cue: float
    around: int  # the region around that
    in_link: bool = False
    in_article: bool = False
    dropped: bool = False


@dataclass
class _Pending:
    parts: list[str] = field(default_factory=list)
    linked: int = 0


def _own_cue(tag: str, attributes: str, inside_article: bool) -> tuple[float, bool, bool]:
    """Cost that an element speaks for (0: nothing), whether it is hidden, and whether its words are clearly boilerplate's."""
    words: set[str] = set()
    hidden = False
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            words.update(_SPLIT.split(_CAMEL.sub(r"\1 \2", value).lower()))
    words.discard("")
    bad = words & _BAD_WORDS
    if inside_article:
        bad.discard("header")
    clear = tag not in _EXEMPT - _GOOD_TAGS and (bool(words & _TELLING) or bool(bad) and words <= _BAD_WORDS | _SUFFIXES)
    if hidden or clear:
        return -CLEAR, hidden, clear
    if tag in _GOOD_TAGS:
        return CLEAR, False, False
    if tag in _BAD_TAGS or (tag == "header" and not inside_article):
        return -CLEAR, False, False
    if tag in _EXEMPT or tag in _INLINE:
        return 0.0, False, False
    good = words & _GOOD_WORDS
    if bad:
        return (UNCLEAR if good and bad == {"header"} else -UNCLEAR), False, False  # "post-header" holds the title
    return CLEAR * bool(good), False, False


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order; scripts, styles, comments and markup are left out."""
    out: list[Block] = []
    stack = [_Element("", 0, 0, 0.0, 0)]
    pending, numbers, at, last = _Pending(), 0, 0, html.rfind(">") + 1
    open_: dict[str, int] = {}

    def text(raw: str) -> None:
        if raw and not stack[-1].dropped:
            pending.parts.append(raw)
            if not raw.isspace() and stack[-1].in_link:
                pending.linked += len(raw)

    def flush() -> None:
        nonlocal pending
        if pending.parts:
            if joined := " ".join(unescape("".join(pending.parts)).split()):
                holder = next(e for e in reversed(stack) if e.tag not in _INLINE)
                out.append(Block(joined, pending.linked, holder.number, holder.region, holder.cue, holder.around))
            pending = _Pending()

    def close(index: int) -> None:
        if any(e.tag not in _INLINE for e in stack[index:]):
            flush()
        for e in stack[index:]:
            open_[e.tag] -= 1
        del stack[index:]

    while m := _TOKEN.search(html, at, last):
        text(html[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = html.find("-->", at)
            at = len(html) if end < 0 else end + 3
            continue
        if m[0] == "<![CDATA[":
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            found = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if open_.get(tag) else 0
            if found and not (tag in _INLINE and any(e.tag not in _INLINE for e in stack[found:])):
                close(found)
            elif tag == "p" or tag in _CLOSES_P:
                flush()
            continue
        attributes = m[3] or m[6] or ""
        if tag in _RAW or tag in _RCDATA:
            if not attributes.endswith("/"):
                end = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.I).search(html, at)
                if end is not None:
                    at = end.end()
                elif tag in _ENDLESS:
                    at = len(html)
            continue
        if tag == "br":
            pending.parts.append("\n")
            continue
        if tag == "hr":
            flush()
        if tag in _VOID:
            continue
        if tag not in _INLINE:
            if tag in _CLOSES_P and open_.get("p"):
                open_p = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in ("p", "table", "button")), 0)
                if open_p and stack[open_p].tag == "p":
                    close(open_p)
            kin = {"dt": "dd", "dd": "dt", "td": "th", "th": "td"}.get(tag, tag)
            if tag in _CLOSED_BY_SAME and (open_.get(tag) or open_.get(kin)):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in _CLOSED_BY_SAME[tag]:
                        break
                    if stack[k].tag in (tag, kin):
                        close(k)
                        break
            flush()
        if attributes.endswith("/") and tag not in _INLINE and tag not in _CLOSES_P:
            continue
        numbers += 1
        top = stack[-1]
        cue, hidden, clear = _own_cue(tag, attributes, top.in_article)
        dropped = top.dropped or hidden or (clear and tag in _INLINE)
        own = cue and tag not in _INLINE
        region = (numbers, cue, top.region) if own else (top.region, top.cue, top.around)
        stack.append(_Element(tag, numbers, *region, top.in_link or tag == "a", top.in_article or tag in _GOOD_TAGS, dropped))
        open_[tag] = open_.get(tag, 0) + 1
    text(html[at:])
    flush()
    return out


def score(b: Block) -> float:
    """The text's evidence; above 0: content."""
    s = min(LONG, len(b.text) / 80 * LONG) - SHORT
    s += 0.5 if b.text[-1:] in ".!?…\"'”»" else -0.25
    if b.linked:
        s -= LINKED * min(1.0, b.linked / len(b.text))
    return s


def graph(page: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Costs of the blocks, then of their regions, and the edges."""
    costs, links, number, last = [score(b) for b in page], [], {}, {}
    for b in page:
        if b.region and b.region not in number:
            number[b.region] = len(page) + len(number)
    costs += [0.0] * len(number)
    for i, b in enumerate(page):
        if b.region:
            costs[number[b.region]] += b.cue
            links.append((i, number[b.region], TIE))
            if b.around in number and (b.region, b.around) not in last:
                last[b.region, b.around] = i
                links.append((number[b.region], number[b.around], AROUND))
        if i and page[i - 1].region != b.region:
            links.append((i - 1, i, ACROSS))
        elif not b.region:
            if i:
                links.append((i - 1, i, NEIGHBOUR))
            if (j := last.get(b.parent)) is not None:
                links.append((j, i, SIBLING))
        if not b.region:
            last[b.parent] = i
    return costs, links


def _merged(n: int, costs: list[float], links: list[tuple[int, int, float]]) -> tuple[list[int], list[float], list[tuple[int, int, float]]]:
    """The graph with blocks (the first ``n`` nodes) merged into a node to which their tie is worth all their other edges and their
    cost: then moving a block to that node's side never costs, so a minimum cut has both on one side."""
    weight = [abs(x) for x in costs]
    strongest: list[tuple[float, int]] = [(0.0, -1)] * len(costs)
    for a, b, w in links:
        weight[a] += w
        weight[b] += w
        if a < n <= b:
            strongest[a] = (w, b)
    to = [b if b >= 0 and 2 * w >= weight[i] else i for i, (w, b) in enumerate(strongest)]
    names = {x: k for k, x in enumerate(dict.fromkeys(to))}
    place = [names[x] for x in to]
    merged, sums = [0.0] * len(names), {}
    for k, x in zip(place, costs, strict=True):
        merged[k] += x
    for a, b, w in links:
        a, b = place[a], place[b]
        if a != b:
            key = (a, b) if a < b else (b, a)
            sums[key] = sums.get(key, 0.0) + w
    return place, merged, [(a, b, w) for (a, b), w in sums.items()]


def max_flow_side(n: int, scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which of ``n`` nodes a minimum cut leaves with the source; a node's score is its capacity from the source, or to the sink if below 0."""
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, s in enumerate(scores):
        if s > 0:
            add(source, i, s, 0.0)
        elif s < 0:
            add(i, sink, -s, 0.0)
    for a, b, w in links:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at, path, u = [0] * (n + 2), [], source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-12)
                u = to[path[k] ^ 1]
                del path[k:]
            while at[u] < len(head[u]):
                e = head[u][at[u]]
                if room[e] > 1e-12 and level[to[e]] == level[u] + 1:
                    break
                at[u] += 1
            if at[u] < len(head[u]):
                path.append(head[u][at[u]])
                u = to[path[-1]]
            elif path:
                level[u] = -1
                u = to[path.pop() ^ 1]
            else:
                break


def label(page: list[Block]) -> list[bool]:
    """True for content."""
    place, costs, links = _merged(len(page), *graph(page))
    if min(costs, default=0.0) > 0 or max(costs, default=0.0) <= 0:
        return [costs[k] > 0 for k in place[: len(page)]]
    side = max_flow_side(len(costs), costs, links)
    return [side[k] for k in place[: len(page)]]


def extract(html: str) -> str:
    page = blocks(html)
    return "\n\n".join(b.text for b, keep in zip(page, label(page), strict=True) if keep)


def extract_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` per input row."""
    pages = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string").withColumn("n_chars", F.length("text").cast("long"))
