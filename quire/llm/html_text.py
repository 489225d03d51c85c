"""Main text of web pages by minimum cut.

A page's blocks (the runs of text between block-level tags) and the elements around them are the nodes of a graph. A linear
classifier gives each block a score from its ancestors' tags, roles and names and from its own text; a positive score is the
capacity from the source (content), a negative one that to the sink (boilerplate). Neighbours in page order and parents in the
tree are joined by edges that a cut must pay for, so a short line between two paragraphs goes with them. The cut of least cost
(maximum flow by layered augmenting paths) labels all blocks at once. There are no labelled blocks to fit on, so the weights of
the classifier are stated below.

A page is read and cut where its row lies: nothing is exchanged, memory is that of a page. Defined cases: null html is empty and
gives an empty text; unclosed, crossed and truncated tags end where the next block or enclosing end tag does; character
references are decoded once; repeated rows give repeated results; extra columns stay, results stand in one struct column."""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire.llm.common import table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template svg math iframe object canvas audio video select textarea button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: An opening tag ends an open element of these, up to the tags that bound the search.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
CELL = frozenset(("td", "th", "table"))
#: What these hold is never content.
FRAME = frozenset("nav aside footer form menu dialog fieldset".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
MAIN, MAIN_ROLES = frozenset(("article", "main")), frozenset(("article", "main"))
#: Words of class names and ids.
BAD_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus dropdown flash footer footnav gdpr header legal login masthead menu meta modal nav navbar navigation newsletter notice notification overlay pager pagination popup print privacy promo promotion rail recommend recommended recommendations related reply replies respond rss search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar tracking warning widget widgets".split()
)
GOOD_NAMES = frozenset("article articlebody body content entry main post prose story text".split())
#: With one of these a name of good and bad words ("content-sidebar-wrap") tells nothing.
AROUND = frozenset("wrap wrapper container layout grid columns page site".split())
MODIFIERS = ("has-", "no-", "with-", "without-", "is-", "js-")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
CUES = re.compile(r"\bcookies?\b|privacy policy|all rights reserved|\bsubscribe\b|\bsign (?:up|in)\b|\blog ?in\b|advertisement|\bsponsored\b|©|\(c\) \d{4}", re.I)

#: Weights of the classifier, and capacities, in whole units so that cuts are exact.
IN_MAIN, BAD, GOOD, HEADER, BESIDE_MAIN, NO_MAIN = 800, -2400, 400, -300, -600, -100
LINKS, SOME_LINKS, SHORT, LONG, LONGER, SENTENCE, HEADING, PARAGRAPH, ITEM, CUE = -400, -150, -100, 150, 300, 100, 50, 100, -50, -400
NEXT_TO, WITHIN, PARENT, ALWAYS = 1200, 300, 150, 1 << 40


class Element:
    __slots__ = ("bad", "depth", "frame", "good", "header", "main", "names", "parent", "silent", "tag")

    def __init__(self, tag: str, parent: Element | None, attributes: dict[str, str | None]):
        self.tag, self.parent, self.depth, self.good, self.bad = tag, parent, parent.depth + 1 if parent else 0, 0, False
        role = (attributes.get("role") or "").strip().lower()
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in (attributes.get("style") or "").replace(" ", "").lower()
        self.silent, self.frame = tag in SILENT, tag in FRAME or role in FRAME_ROLES or hidden
        self.main = tag in MAIN or role in MAIN_ROLES or attributes.get("itemprop") == "articleBody"
        self.header = tag == "header"
        named = f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split() if tag not in ("html", "body") else ()
        self.names = {w.lower() for name in named if not name.lower().startswith(MODIFIERS) for w in NAME_PART.findall(name)}
        if self.names:
            self.bad, self.good = not self.names.isdisjoint(BAD_NAMES), not self.names.isdisjoint(GOOD_NAMES)
            if self.bad and self.good and not self.names.isdisjoint(AROUND):
                self.bad = self.good = False


class Page(HTMLParser):
    """blocks: [text, characters in links, element]; elements that hold the page's main element keep no bad name."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Element("", None, {})
        self.open, self.silent, self.links = [self.root], 0, 0
        self.blocks: list[tuple[str, int, Element]] = []
        self.has_main = False
        self.text: list[str] = []
        self.linked, self.place = 0, self.root
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((text, self.linked, self.place))
        self.text, self.linked = [], 0

    def pop(self, to: int) -> None:
        """Close all elements from this place of the stack."""
        for e in self.open[to:]:
            self.silent -= e.silent
            self.links -= e.tag == "a"
        del self.open[to:]

    def find(self, tags, until) -> int | None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in until:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.text.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if (i := self.find({"p"}, CELL)) is not None:
                self.pop(i)
            if tag in ENDS and (i := self.find(*ENDS[tag])) is not None:
                self.pop(i)
            if tag == "body" or (self.silent and self.open[-1].tag == "head"):
                if (i := self.find({"head"}, ())) is not None and tag not in SILENT and tag not in ("title",):
                    self.pop(i)
        elif tag == "a" and (i := self.find({"a"}, CELL)) is not None:
            self.pop(i)
        e = Element(tag, self.open[-1], dict(attrs))
        self.has_main |= e.main and not e.bad
        if tag == "main":
            up = e.parent
            while up is not None:
                up.bad, up = False, up.parent
        self.open.append(e)
        self.silent += e.silent
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in SILENT:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag not in INLINE:
            self.flush()
        until = () if tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "body", "html") else CELL
        if (i := self.find({tag}, until)) is not None:
            if tag in INLINE and any(e.tag not in INLINE for e in self.open[i + 1 :]):
                return  # crossed: the block between goes on
            self.pop(i)

    def handle_data(self, data):
        if self.silent or not data:
            return
        if not self.text or not "".join(self.text).strip():
            self.place = next(e for e in reversed(self.open) if e.tag not in INLINE)
        self.text.append(data)
        if self.links:
            self.linked += len("".join(data.split()))


def score(text: str, linked: int, place: Element, has_main: bool) -> int:
    """The classifier: above zero for content."""
    chain, e = [], place
    while e is not None:
        chain.append(e)
        e = e.parent
    if any(e.frame for e in chain):
        return -ALWAYS
    total, bad, inside, good = 0, False, False, False
    for e in reversed(chain):
        if e.header and not inside:
            return -ALWAYS
        total += HEADER if e.header and e.parent is not None else 0
        if e.bad and not bad:
            bad, total = True, total + BAD
        if not bad and e.main and not inside:
            inside, total = True, total + IN_MAIN
        if not bad and not inside and e.good and not good:
            good, total = True, total + GOOD
    if not inside:
        total += BESIDE_MAIN if has_main else NO_MAIN
    words, solid = text.count(" ") + 1, len(text) - text.count(" ")
    total += LINKS if 2 * linked > solid else SOME_LINKS if 4 * linked > solid else 0
    total += LONGER if words > 40 else LONG if words > 15 else SHORT if words < 5 else 0
    total += SENTENCE if text[-1] in ".!?…。！？\"»”" else 0
    total += HEADING if re.fullmatch("h[1-6]", place.tag) else PARAGRAPH if place.tag in ("p", "pre", "blockquote", "figcaption") else ITEM if place.tag == "li" else 0
    return total + (CUE if not inside and words < 60 and CUES.search(text) else 0)


def closeness(a: Element, b: Element) -> int:
    """Capacity between neighbours: less with the square of the steps of the tree between them, a quarter over a named or framed border."""
    steps, border = 0, False
    while a is not b:
        lower = a if a.depth >= b.depth else b
        border |= lower.bad or lower.frame
        if lower is a:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return NEXT_TO // max(steps, 1) ** 2 // (4 if border else 1)


class Flow:
    """Maximum flow by layers of shortest paths; capacities are whole numbers."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def join(self, a: int, b: int, there: int, back: int = 0) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def layers(self, source: int) -> list[int]:
        depth = [-1] * len(self.arcs)
        depth[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for arc in self.arcs[a]:
                if self.room[arc] and depth[self.to[arc]] < 0:
                    depth[self.to[arc]] = depth[a] + 1
                    queue.append(self.to[arc])
        return depth

    def cut(self, source: int, sink: int) -> list[bool]:
        """Whether each node stays on the source's side of a least cut."""
        while (depth := self.layers(source))[sink] >= 0:
            next_arc = [0] * len(self.arcs)
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    least = min(self.room[arc] for arc in path)
                    for arc in path:
                        self.room[arc] -= least
                        self.room[arc ^ 1] += least
                    first = next(i for i, arc in enumerate(path) if not self.room[arc])
                    at = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                arcs = self.arcs[at]
                while next_arc[at] < len(arcs) and not (self.room[arcs[next_arc[at]]] and depth[self.to[arcs[next_arc[at]]]] == depth[at] + 1):
                    next_arc[at] += 1
                if next_arc[at] < len(arcs):
                    path.append(arcs[next_arc[at]])
                    at = self.to[path[-1]]
                elif path:
                    arc = path.pop()
                    at = self.to[arc ^ 1]
                    next_arc[at] += 1
                else:
                    break
        return [d >= 0 for d in depth]


def labelled(page: Page) -> list[tuple[str, int, bool]]:
    """(text, score, whether it is content) of every block, in page order."""
    scores = [score(text, linked, place, page.has_main) for text, linked, place in page.blocks]
    if not any(s > 0 for s in scores):
        return [(b[0], s, False) for b, s in zip(page.blocks, scores)]
    number: dict[int, int] = {}
    edges: list[tuple[int, int, int]] = []
    n = len(scores)
    for i, (_, _, place) in enumerate(page.blocks):
        child, e, border, room = i, place, False, WITHIN
        while e is not None and e.parent is not None:
            known = id(e) in number
            node = number.setdefault(id(e), n + len(number))
            edges.append((child, node, room // 4 if border else room))
            border, room = e.bad or e.frame, PARENT if child == i else PARENT // 4
            if known:
                break
            child, e = node, e.parent
        if i:
            edges.append((i - 1, i, closeness(page.blocks[i - 1][2], place)))
    source, sink = n + len(number), n + len(number) + 1
    flow = Flow(sink + 1)
    for i, s in enumerate(scores):
        flow.join(*((source, i, s) if s > 0 else (i, sink, -s)))
    for a, b, c in edges:
        flow.join(a, b, c, c)
    side = flow.cut(source, sink)
    return [(b[0], s, side[i]) for i, (b, s) in enumerate(zip(page.blocks, scores))]


def main_text(html: str | None) -> str:
    return "\n".join(text for text, _, content in labelled(Page(html)) if content) if html else ""


def extracted(pages: DataFrame, html: str = "html", out: str = "extracted") -> DataFrame:
    """The rows with one more struct column: text (blocks of content, newline-joined), blocks (number of all), kept."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = "text string, blocks long, kept long"
    schema = StructType([*pages.schema.fields, StructField(out, pages.sparkSession.createDataFrame([], kind).schema)])
    column = to_arrow_schema(schema).field(len(schema) - 1)
    at = pages.columns.index(html)

    def run(batches):
        for b in batches:
            rows = []
            for page in b.column(at):
                found = labelled(Page(page.as_py())) if page.is_valid else []
                texts = [text for text, _, content in found if content]
                rows.append({"text": "\n".join(texts), "blocks": len(found), "kept": len(texts)})
            yield b.append_column(column, pa.array(rows, column.type))

    return pages.mapInArrow(run, schema)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", F.col("extracted.text").alias("text"), F.length("extracted.text").cast("long").alias("n_chars"))


#: The tables' pages hold one article of h1 and p, which SQL can cut out by patterns.
OP11_SQL = """
with block as (
  select page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '</?(?:h1|p)>') as parts from pages
),
clean as (
  select page_id, url, list_filter(
    [trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) for x in parts],
    lambda x: x <> '') as parts
  from block
)
select page_id, url, coalesce(array_to_string(parts, chr(10)), '') as text, length(coalesce(array_to_string(parts, chr(10)), '')) as n_chars from clean
"""
