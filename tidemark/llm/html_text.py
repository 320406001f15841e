"""Main text of HTML pages by minimum-cut labelling of their blocks.

A page is read to text blocks, each with what stands around it (elements, roles, classes) and how much of it is links.
A linear classifier turns these into evidence for content or boilerplate, the terminal capacities. What wraps the page's
article, or nearly all text of a page without one, is not told by its class: wrappers are named after what else they hold. An article
within an article that has text of its own is a reader's comment. Links count less in an article, which has its own lists of
them, and where nothing of a page is content by this, its short texts are taken without the bias against them. Smoothness edges
join blocks in page order, weaker the further apart they are in the tree, and next siblings below one parent. The
minimum cut gives the labels. A block whose evidence outweighs all its edges keeps its sign in every minimum cut;
such blocks are settled first and their edges folded into their neighbours, and a maximum flow decides the rest.

Defined results: null and empty pages have an empty text; pages cut off anywhere and elements never closed are read as
far as they go; repeated rows have equal results; an empty table gives an empty result. Columns beyond the named ones
are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Elements of HTML.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style iframe textarea title noembed noframes xmp".split())
#: Not raw text: what they hold is read, with evidence against it, up to their own end tag; without one they end nothing.
EMBEDDED = frozenset("template noscript svg object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"button", "option", "select"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

ELEMENT_EVIDENCE = {"article": 4.0, "main": 3.0, "p": 0.8, "pre": 0.8, "blockquote": 0.8, "h1": 0.8, "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "button": -9.0, "select": -9.0, "option": -9.0, "menu": -9.0, "dialog": -9.0, "fieldset": -9.0, "search": -9.0, "head": -20.0} | dict.fromkeys(EMBEDDED, -20.0) | {"noscript": -3.6}
ROLE_EVIDENCE = {"main": 3.0, "article": 4.0, "navigation": -9.0, "banner": -9.0, "contentinfo": -9.0, "complementary": -9.0, "search": -9.0, "dialog": -9.0, "alert": -9.0, "alertdialog": -9.0, "menu": -9.0, "menubar": -9.0, "form": -9.0}
BAD_WORDS = frozenset("ad ads adv advert advertisement advertising adbox adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header legal masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toc toolbar topbar widget".split())
GOOD_WORDS = frozenset("article articlebody body content entry main maincontent post postbody story text".split())
#: Said of an element by class or id, these speak against it only outside an article: there, they name its own head or matter.
OUTSIDE_WORDS = frozenset("banner copyright disclaimer header legal masthead".split())
#: A name is a bad word's only if nothing but these, digits and GOOD_WORDS stand beside it: related-posts is, related-work isn't.
FILLER_WORDS = frozenset("area articles bar block bottom box button buttons card col column container form group head inner item items left line link links list module outer page pane panel posts primary right row secondary section side site stories title top unit wrap wrapper zone".split())
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
#: Evidence against what a class calls boilerplate, or what a form or a reader's comment holds.
AGAINST = -9.0
#: A page's share of text without links that a wrapper may leave outside.
OUTSIDE_SHARE = 0.1
LINK_EVIDENCE = {"article": -1.0, "main": -2.5, "": -5.0}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_EMBEDDED_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<(script|style|iframe|textarea|title|xmp)\b.*?(?:</\1\b|\Z)|<(/?)({"|".join(sorted(EMBEDDED))})(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*+>""", re.I | re.S)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Element:
    """above: its parent's number; plain: evidence of its name, role and state; marked: its class or kind speaks against it; comment: as a reader's comment;
    place: article, main or nothing, by what it stands in; outer: the number of the article around it; top: of the outermost one, itself included; chars: text without links in it."""

    __slots__ = ("above", "name", "plain", "marked", "good", "comment", "place", "outer", "top", "chars", "evidence")

    def __init__(self, above: int, name: str):
        self.above, self.name, self.plain, self.marked, self.good, self.comment = above, name, 0.0, False, False, False
        self.place, self.outer, self.top, self.chars, self.evidence = "", -1, -1, 0, 0.0


class Block:
    """element: the number of the element that holds it; above: that one's parent's; depth: how many elements stand open; shared: how many of them stand open since the block before."""

    __slots__ = ("element", "above", "depth", "shared", "pieces", "link_chars", "evidence", "place")

    def __init__(self, element: int, above: int, depth: int, shared: int):
        self.element, self.above, self.depth, self.shared, self.pieces, self.link_chars, self.evidence, self.place = element, above, depth, shared, [], 0, 0.0, ""


def class_marks(value: str, within: bool) -> tuple[bool, bool, bool]:
    """What names in a class or an id say: bad, good, comment. within: the element stands in an article or the page's main part."""
    bad = good = comment = False
    for name in value.split():
        parts = {p.lower() for p in _PARTS.findall(name) if not p.isdigit()}
        said = parts & BAD_WORDS
        if within or parts & GOOD_WORDS:
            said -= OUTSIDE_WORDS
        if said and parts <= BAD_WORDS | FILLER_WORDS | GOOD_WORDS:
            bad, comment = True, comment or bool(said & COMMENT_WORDS)
        elif parts & GOOD_WORDS:
            good = True
    return bad, good, comment


def read_element(name: str, attributes: str, above: int, elements: list[Element], within: bool) -> Element:
    """within: it stands in an article or the page's main part."""
    own = Element(above, name)
    own.plain = ELEMENT_EVIDENCE.get(name, 0.0)
    if above >= 0:
        around = elements[above]
        own.place, own.outer, own.top = around.place, above if around.name == "article" else around.outer, around.top
    if name in ("article", "main"):
        own.place = "article" if "article" in (name, own.place) else name
    if name == "article" and own.top < 0:
        own.top = len(elements)
    if name == "header" and not within:
        own.plain = AGAINST
    if name == "form":
        own.plain, own.marked = 0.0, True
    if not attributes:
        return own
    names = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)}
    role = names.get("role", "").lower()
    own.plain += ROLE_EVIDENCE.get(role, 0.0)
    if role in ("article", "main"):
        own.place = "article" if "article" in (role, own.place) else role
    if "hidden" in names or names.get("aria-hidden", "").lower() == "true" or "display:none" in names.get("style", "").lower().replace(" ", ""):
        own.plain -= 20.0
    if name not in ("html", "body"):
        for value in (names.get("class", ""), names.get("id", "")):
            bad, good, comment = class_marks(html.unescape(value), within)
            own.marked, own.good, own.comment = own.marked or bad, own.good or good, own.comment or comment
    return own


def settle(elements: list[Element], blocks: list[tuple[str, Block]]) -> None:
    """Gives every block the evidence of the elements around it."""
    plainly = lambda e: e.plain <= AGAINST
    below: list[tuple[bool, bool]] = []  # by element: whether its name, or its name or class, or those of what is around it speak against it
    for e in elements:
        by_name, by_any = below[e.above] if e.above >= 0 else (False, False)
        below.append((by_name or plainly(e), by_any or plainly(e) or e.marked))
    own_text: set[int] = set()  # articles with text of their own that isn't a heading's
    total = 0
    for text, block in blocks:
        if block.element < 0:
            total += max(0, len(text) - block.link_chars)
        elif not below[block.element][0]:
            e = elements[block.element]
            e.chars += max(0, len(text) - block.link_chars)
            total += max(0, len(text) - block.link_chars)
            if e.name not in HEADINGS:
                own_text.add(block.element if e.name == "article" else e.outer)
    for e in reversed(elements):
        if e.above >= 0:
            elements[e.above].chars += e.chars
    articles = [i for i, e in enumerate(elements) if e.name in ("article", "main") and e.outer < 0]
    wraps: set[int] = set()
    if all(below[i][1] for i in articles):  # then classes of them and around them can't be meant
        for i in articles:
            while i >= 0 and i not in wraps:
                wraps.add(i)
                i = elements[i].above
    for i, e in enumerate(elements):
        around = elements[e.above] if e.above >= 0 else None
        named, e.comment = e.comment, bool(around and around.comment)
        e.evidence = e.plain + (around.evidence if around else 0.0)
        if around and around.place and e.name in ("article", "main"):  # what speaks for a place doesn't add up
            e.evidence -= min(ELEMENT_EVIDENCE[e.name], ELEMENT_EVIDENCE[around.place])
        praised = bool(around and (around.good or around.place))
        if e.name == "article" and e.outer >= 0 and e.outer in own_text:
            e.evidence, e.comment = e.evidence - ELEMENT_EVIDENCE["article"] + AGAINST, True
        if e.marked and i not in wraps and (e.place or articles or e.chars < (1 - OUTSIDE_SHARE) * total):
            e.evidence, e.comment = e.evidence + AGAINST, e.comment or named
        elif e.good and not praised:
            e.evidence += 1.5
        e.good = e.good or praised
    for _, block in blocks:
        if block.element >= 0:
            block.evidence, block.place = elements[block.element].evidence, elements[block.element].place
    _headings_of_comments(elements, blocks)


def _headings_of_comments(elements: list[Element], blocks: list[tuple[str, Block]]) -> None:
    """A heading in an article goes with its section, if that has comments and nothing but boilerplate."""
    article, bare, comments = -1, True, False  # from the end: the article, and what the section holds so far
    for _, block in reversed(blocks):
        if block.element < 0:
            continue
        e = elements[block.element]
        if e.top != article:
            article, bare, comments = e.top, True, False
        if e.comment or block.evidence < 0:
            comments = comments or e.comment
        elif e.name in HEADINGS:
            if e.name != "h1" and article >= 0 and bare and comments:
                block.evidence += AGAINST
            bare, comments = True, False
        else:
            bare = False


def closed_elements(page: str) -> set[int]:
    """Where the EMBEDDED elements start that an end tag of their own closes."""
    found: set[int] = set()
    open_at: dict[str, list[int]] = {}
    for m in _EMBEDDED_TAG.finditer(page):
        if not m[3] or m[0].endswith("/>"):
            continue
        at = open_at.setdefault(m[3].lower(), [])
        if not m[2]:
            at.append(m.start())
        elif at:
            found.add(at.pop())
    return found


def read_blocks(page: str) -> list[tuple[str, Block]]:
    """Texts of blocks in page order, white space already single."""
    out: list[tuple[str, Block]] = []
    elements: list[Element] = []
    stack: list[tuple[str, int]] = []  # open block elements: name and number
    state = {"block": None, "link": False, "shared": 0}
    open_names: Counter[str] = Counter()

    def end_block() -> None:
        block = state["block"]
        if block is not None:
            text = " ".join("".join(block.pieces).split())
            if text:
                out.append((text, block))
        state["block"], state["link"] = None, False

    def add(data: str) -> None:
        if not data:
            return
        if state["block"] is None:
            if data.isspace():
                return
            state["block"] = Block(stack[-1][1] if stack else -1, stack[-2][1] if len(stack) > 1 else -1, len(stack), state["shared"])
            state["shared"] = len(stack)
        state["block"].pieces.append(html.unescape(data))
        if state["link"]:
            state["block"].link_chars += len(data.strip())

    def close(names: frozenset[str] | set[str], within: frozenset[str]) -> None:
        if not any(open_names[n] for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                open_names.subtract(n for n, _ in stack[i:])
                del stack[i:]
                state["shared"] = min(state["shared"], i)
                return
            if stack[i][0] in within:
                return

    scopes = frozenset("article aside body button dialog div fieldset figure footer form header main nav section table td th ul ol dl menu".split())
    closed = closed_elements(page)
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
        elif nxt in ("!", "?"):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
        elif nxt == "/" and (m := _NAME.match(page, lt + 2)):
            end = page.find(">", m.end())
            at, name = (size if end < 0 else end + 1), m[0].lower()
            if name in BLOCKS or (name in EMBEDDED and open_names[name]):
                end_block()
                if name == "p":
                    close({"p"}, scopes)
                else:
                    close({name}, frozenset())
            elif name == "a":
                state["link"] = False
        elif m := _NAME.match(page, lt + 1):
            name = m[0].lower()
            whole = _TAG_END.match(page, m.end())
            end = whole.end() if whole else page.find(">", m.end()) + 1 or size
            attributes, at = page[m.end() : end - 1], end
            if name in RAW and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                end = page.find(">", stop.end()) if stop else -1
                at = size if end < 0 else end + 1
            elif name in BLOCKS or (name in EMBEDDED and lt in closed):
                end_block()
                if name in CLOSES_P:
                    close({"p"}, scopes)
                if name == "li":
                    close({"li"}, frozenset(("ul", "ol", "menu")))
                elif name in ("dt", "dd"):
                    close({"dt", "dd"}, frozenset(("dl",)))
                elif name in ("td", "th"):
                    close({"td", "th"}, frozenset(("tr", "table")))
                elif name == "tr":
                    close({"tr"}, frozenset(("table",)))
                elif name == "option":
                    close({"option"}, frozenset(("select",)))
                elif name in HEADINGS:
                    close(HEADINGS, scopes)
                if name not in VOID:
                    elements.append(read_element(name, attributes, stack[-1][1] if stack else -1, elements, bool(open_names["article"] or open_names["main"])))
                    stack.append((name, len(elements) - 1))
                    open_names[name] += 1
            elif name == "br":
                add(" ")
            elif name == "a":
                state["link"] = True
        else:
            add("<")
            at = lt + 1
    end_block()
    settle(elements, out)
    return out


def evidence(text: str, block: Block, bias: float = 1.5) -> float:
    """Positive for content."""
    words, linked = len(text.split()), min(1.0, block.link_chars / len(text))
    return block.evidence + 0.6 * math.log1p(words) - bias + LINK_EVIDENCE[block.place] * linked


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page and next siblings, by closeness in the tree."""
    edges: list[tuple[int, int, float]] = []
    last_of: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, 1.0 / (1 + blocks[i - 1].depth + block.depth - 2 * block.shared)))
        if block.above in last_of:
            edges.append((last_of[block.above], i, 0.3))
        last_of[block.above] = i
    return edges


def minimum_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source: minimises the sum of what disagrees with score's signs and of edges cut."""
    n = len(score)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        around[a][b] = around[a].get(b, 0.0) + w
        around[b][a] = around[b].get(a, 0.0) + w
    left, label = list(score), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(left[i]) > sum(around[i].values()):
            label[i] = left[i] > 0
            for j, w in around[i].items():
                del around[j][i]
                left[j] += w if label[i] else -w
                todo.append(j)
            around[i] = {}
    open_nodes = [i for i in range(n) if label[i] is None]
    if open_nodes:
        kept = _max_flow(open_nodes, left, around)
        for i in open_nodes:
            label[i] = i in kept
    return label


def _max_flow(nodes: list[int], left: list[float], around: list[dict[int, float]]) -> set[int]:
    """Dinic's algorithm; the source side of the cut. -1 is the source, -2 the sink."""
    room: dict[int, dict[int, float]] = {i: dict(around[i]) for i in nodes} | {-1: {}, -2: {}}
    for i in nodes:
        a, b = (-1, i) if left[i] > 0 else (i, -2)
        room[a][b] = abs(left[i])
        room[b].setdefault(a, 0.0)
    while True:
        level, queue = {-1: 0}, deque([-1])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if -2 not in level:
            return set(level) - {-1}
        ways = {u: iter(list(room[u])) for u in level}
        path = [-1]
        while path:
            u = path[-1]
            if u == -2:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                cut = 0
                for k in range(len(path) - 2, -1, -1):
                    a, b = path[k], path[k + 1]
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                    if room[a][b] <= 1e-12:
                        cut = k
                del path[cut + 1 :]
                ways[path[-1]] = iter([v for v in room[path[-1]] if room[path[-1]][v] > 1e-12])
                continue
            step = next((v for v in ways[u] if room[u][v] > 1e-12 and level.get(v, -1) == level[u] + 1), None)
            if step is None:
                path.pop()
            else:
                path.append(step)


def main_text(page: str) -> str:
    found = read_blocks(page)
    blocks = [b for _, b in found]
    content = minimum_cut([evidence(t, b) for t, b in found], smoothness(blocks))
    if not any(content):
        content = minimum_cut([evidence(t, b, bias=0.0) for t, b in found], smoothness(blocks))
    return "\n".join(t for (t, _), keep in zip(found, content, strict=True) if keep)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(extract, schema)
