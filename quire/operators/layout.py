"""Structure of a document from its positioned elements: heading paths, captions, near text, continued tables, figures and
retrieval units. Everything is keyed by document, so documents spread over tasks; steps that are sequential by nature run
once per document in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions import geometry as G
from quire.functions import ids as I
from quire.functions import text as T
from quire.sources.scratch import materialize

NEAR_POINTS, MAX_TOKENS = 72.0, 480
#: Documents whose rows a sequential step holds as Python objects at once.
DOCUMENTS = 64
DECORATIVE_PAGES, DECORATIVE_SHARE, DESCRIBED_SHARE = 3, 0.2, 0.05
CONTINUED_SCORE, CONTINUES_SCORE = 1.0, 0.9
# Labels of a figure classifier that mark decoration, and kinds of elements: fixed values of the data model.
DECORATIVE_CLASSES = ("logo", "icon", "signature", "stamp", "bar_code", "qr_code", "full_page_image", "page_thumbnail")
TEXT_KINDS = ("heading", "paragraph", "list_item", "caption")
FLOWING_KINDS = ("paragraph", "list_item", "caption")


def element_box(prefix: str = "") -> Column:
    return G.box(*(F.col(f"{prefix}bbox_{s}") for s in ("left", "top", "right", "bottom")))


def is_(kind: str) -> Column:
    return F.col("kind") == kind


def per_document(rows: DataFrame, order: str, run: Callable[[str, list[dict]], Iterable[tuple]], schema: str) -> DataFrame:
    """A sequential step over the ordered rows of each document: rows are grouped into one array per document and handed on in
    Arrow batches, of which DOCUMENTS documents at a time become Python objects."""
    fields = [order, *(c for c in rows.columns if c not in (order, "document_id"))]
    lists = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)).alias("rows"))
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def batches(parts):
        for b in (whole.slice(at, DOCUMENTS) for whole in parts for at in range(0, whole.num_rows, DOCUMENTS)):
            out = [t for doc, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for t in run(doc, members)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*zip(*out)] or [()] * len(arrow), arrow)], schema=arrow)

    return lists.mapInArrow(batches, schema)


# Headings -------------------------------------------------------------------------------------------------------------


def heading_path(elements: DataFrame) -> DataFrame:
    """Adds heading_path: per level the last heading at or above it is in the path if it is of just that level. One window
    sort per document for all levels."""
    w = W.partitionBy("document_id").orderBy("reading_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    level = F.coalesce("heading_level", F.lit(1))
    last = [F.last(F.when(is_("heading") & (level <= n), F.struct(level.alias("l"), F.coalesce("text", F.lit("")).alias("t"))), ignorenulls=True).over(w) for n in range(1, T.MAX_HEADING_LEVEL + 1)]
    steps = F.array(*(F.when(c["l"] == n, c["t"]) for n, c in enumerate(last, 1)))
    return elements.withColumn("heading_path", F.filter(steps, lambda x: x.isNotNull()))


def outline_levels(outline: DataFrame) -> DataFrame:
    """outline(document_id, position, depth, title, page) -> document_id, position, key, page, level. A title that repeats
    its parent's adds no level; a single root is a wrapper; levels end at six.

    One fold over a document's bookmarks in order: its state is the stack of ancestors, from which each bookmark drops those of
    its own depth or more; its level is its parent's, one more if the titles differ. The plan is the same for every depth. An
    outline belongs to one document and is held in one row, without its other columns."""
    keyed = outline.withColumn("key", T.title_key(F.col("title"))).select("document_id", "position", "depth", "key", "page")
    kinds = keyed.schema
    key, depth, position = (kinds[c].dataType.simpleString() for c in ("key", "depth", "position"))
    rows = F.array_sort(F.collect_list(F.struct("position", "depth", "key")))
    none = F.expr(f"named_struct('stack', cast(array() as array<struct<depth:{depth},key:{key},real:int>>), 'out', cast(array() as array<struct<position:{position},real:int>>))")

    def step(state, row):
        above = F.filter(state["stack"], lambda e: e["depth"] < row["depth"])
        parent = F.try_element_at(above, F.lit(-1))
        real = F.coalesce(parent["real"] + F.coalesce(parent["key"] != row["key"], F.lit(False)).cast("int"), F.lit(0))
        own = F.struct(row["depth"].alias("depth"), row["key"].alias("key"), real.alias("real"))
        return F.struct(F.concat(above, F.array(own)).alias("stack"), F.concat(state["out"], F.array(F.struct(row["position"].alias("position"), real.alias("real")))).alias("out"))

    folded = keyed.groupBy("document_id").agg(F.aggregate(rows, none, step, lambda s: s["out"]).alias("out"))
    d = keyed.join(folded.select("document_id", F.inline("out")), ["document_id", "position"])
    whole = W.partitionBy("document_id")
    d = d.withColumn("top", F.min("real").over(whole)).withColumn("tops", F.sum((F.col("real") == F.col("top")).cast("int")).over(whole)).withColumn("all", F.count("*").over(whole))
    level = F.col("real") - F.col("top") - F.when((F.col("all") > 1) & (F.col("tops") == 1), 1).otherwise(0) + 1
    return d.withColumn("level", F.least(level, F.lit(T.MAX_HEADING_LEVEL))).where("level > 0").select("document_id", "position", "key", "page", "level")


def heading_levels(headings: DataFrame, outline: DataFrame) -> DataFrame:
    """headings(document_id, id, text, page) with level: of the bookmark of that title and page (the shallowest), else the
    only level that title has, else the depth of its section number, else 1."""
    levels = outline_levels(outline)
    here = levels.groupBy("document_id", "page", "key").agg(F.min("level").alias("here"))
    sole = levels.groupBy("document_id", "key").agg(F.min("level").alias("sole"), F.max("level").alias("_most")).where("sole = _most").drop("_most")
    h = headings.withColumn("key", T.title_key(F.col("text")))
    h = h.join(here, ["document_id", "page", "key"], "left").join(sole, ["document_id", "key"], "left")
    return h.withColumn("level", F.coalesce("here", "sole", T.section_level(F.col("text")), F.lit(1))).drop("here", "sole", "key")


# Links ----------------------------------------------------------------------------------------------------------------


def _slim(elements: DataFrame) -> DataFrame:
    return elements.select("document_id", "id", "kind", "page", "reading_order", "text", "table_rows", element_box().alias("box"))


def caption_links(elements: DataFrame, links: DataFrame, most: float = NEAR_POINTS) -> DataFrame:
    """Captions that the extractor left alone, in reading order, each to the closest image or table that is still free:
    on its page within `most` points, else the one that closes the page before, if the caption opens its own. Each choice
    depends on those before it, so it runs once per document."""

    known = links.where(F.col("kind").isin("caption_of", "title_of"))
    sources = known.select("document_id", F.col("source_id").alias("id"), F.lit(True).alias("linked")).distinct()
    targets = known.select("document_id", F.col("target_id").alias("id"), F.lit(True).alias("captioned")).distinct()
    rows = elements.where(F.col("kind") != "page_furniture").select("document_id", "id", "kind", "page", "reading_order", *(F.col(f"bbox_{s}").alias(s) for s in ("left", "top", "right", "bottom")))
    rows = rows.join(sources, ["document_id", "id"], "left").join(targets, ["document_id", "id"], "left")
    names = {"image": "caption_of", "table": "title_of"}

    def run(document: str, rows: list[dict]):
        used = {r["id"] for r in rows if r["captioned"]}
        on_page: dict[int, list[dict]] = {}
        for r in rows:
            if r["kind"] in names:
                on_page.setdefault(r["page"], []).append(r)
        before = None
        for r in rows:
            if r["kind"] == "caption" and not r["linked"]:
                near = []
                for t in on_page.get(r["page"], []):
                    gap = max(0.0, max(r["top"], t["top"]) - min(r["bottom"], t["bottom"]))
                    if t["id"] not in used and gap <= most and min(r["right"], t["right"]) > max(r["left"], t["left"]):
                        near.append((gap, t["reading_order"], t))
                target = min(near, key=lambda x: x[:2])[2] if near else None
                if target is None and before is not None and before["page"] == r["page"] - 1 and before["kind"] in names and before["id"] not in used:
                    target = before
                if target is not None:
                    used.add(target["id"])
                    yield document, r["id"], target["id"], names[target["kind"]], None
            before = r

    return per_document(rows, "reading_order", run, "document_id string, source_id string, target_id string, kind string, score double")


def near_links(elements: DataFrame, links: DataFrame, most: float = NEAR_POINTS) -> DataFrame:
    """The closest paragraph or list item of each image, measured from the image and from its captions on the next page: an
    equi-join on document and page, a range predicate, and the least (gap, reading order) in a partial aggregation."""
    e = _slim(elements)
    image = e.where(is_("image")).select("document_id", F.col("id").alias("image"), "page", F.col("box").alias("anchor"))
    caption = links.where("kind = 'caption_of'").select("document_id", F.col("source_id").alias("id"), F.col("target_id").alias("image"))
    spot = e.select("document_id", "id", F.col("page").alias("caption_page"), F.col("box").alias("anchor"))
    below = caption.join(spot, ["document_id", "id"]).join(image.select("document_id", "image", "page"), ["document_id", "image"]).where("caption_page = page + 1")
    anchors = image.unionByName(below.select("document_id", "image", F.col("caption_page").alias("page"), "anchor"))
    texts = e.where(F.col("kind").isin("paragraph", "list_item")).select("document_id", "page", F.col("id").alias("text_id"), "reading_order", "box")
    pairs = anchors.join(texts, ["document_id", "page"]).withColumn("gap", G.column_gap(F.col("anchor"), F.col("page"), F.col("box"), F.col("page"))).where(F.col("gap") <= most)
    best = pairs.groupBy("document_id", "image").agg(F.min(F.struct("gap", "reading_order", "text_id")).alias("b"))
    return best.select("document_id", F.col("b.text_id").alias("source_id"), F.col("image").alias("target_id"), F.lit("near").alias("kind"), G.near_score(F.col("b.gap"), most).alias("score"))


def continuation_links(elements: DataFrame, links: DataFrame, page_sizes: DataFrame) -> DataFrame:
    """Tables that continue on the next page: consecutive tables of as many columns, the first ending in the lower half, the
    second starting in the upper half, and only furniture, images and their own titles between. Interruptions are counted by
    running sums over reading order, so there is no join of tables with what lies between."""
    titles = links.where("kind = 'title_of'").groupBy("document_id", F.col("source_id").alias("id")).agg(F.max("target_id").alias("titled"))
    columns = lambda rows: F.when(F.size(rows) > 0, F.size(F.get(rows, F.lit(0)))).otherwise(0)
    table = is_("table")
    # what is sorted carries facts about texts and cells, not these
    slim = elements.select("document_id", "id", "kind", "page", "reading_order", F.when(~table, T.is_continued(F.col("text"))).alias("continued"), F.when(table, columns(F.col("table_rows"))).alias("columns"), F.when(table, F.struct(F.col("bbox_top").alias("top"), F.col("bbox_bottom").alias("bottom"))).alias("box"))
    e = slim.join(titles, ["document_id", "id"], "left")
    order = W.partitionBy("document_id").orderBy("reading_order")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    e = e.withColumn("nth", F.sum(F.when(table, 1).otherwise(0)).over(upto))
    blocking = ~F.col("kind").isin("page_furniture", "image", "table")
    # between tables n and n + 1: rows that block at all, and those that title one of the two
    at = F.struct("id", "page", "box", "columns")
    first = F.when(table, at)
    e = e.withColumn("before", F.last(first, ignorenulls=True).over(upto)).withColumn("next", F.first(first, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)))
    between = e.where(~table & F.col("before").isNotNull() & F.col("next").isNotNull())
    own = F.col("titled").isin(F.col("before.id"), F.col("next.id"))
    gaps = between.groupBy("document_id", "nth").agg(
        F.coalesce(F.bool_or(blocking & ~F.coalesce(own, F.lit(False))), F.lit(False)).alias("interrupted"),
        F.coalesce(F.bool_or((F.col("titled") == F.col("next.id")) & F.col("continued")), F.lit(False)).alias("said"),
    )
    pairs = e.where(table & F.col("next").isNotNull()).select("document_id", "nth", "id", "page", "box", "columns", "next").join(gaps, ["document_id", "nth"], "left")
    h = page_sizes.select("document_id", "page", "height")
    pairs = pairs.where((F.col("next.page") == F.col("page") + 1) & (F.col("columns") > 0) & (F.col("columns") == F.col("next.columns")) & ~F.coalesce("interrupted", F.lit(False)))
    pairs = pairs.join(h, ["document_id", "page"], "left").join(h.select("document_id", (F.col("page") - 1).alias("page"), F.col("height").alias("next_height")), ["document_id", "page"], "left")
    known = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("a page has no size")).cast("double"))
    pairs = pairs.where((F.col("box.bottom") > known("height") / 2) & (F.col("next.box.top") < known("next_height") / 2))
    return pairs.select("document_id", F.col("next.id").alias("source_id"), F.col("id").alias("target_id"), F.lit("continues").alias("kind"), F.when(F.col("said"), CONTINUED_SCORE).otherwise(CONTINUES_SCORE).alias("score"))


def link_elements(elements: DataFrame, extracted: DataFrame, page_sizes: DataFrame, most: float = NEAR_POINTS) -> DataFrame:
    """All links: the extractor's (once each), then captions, near text, continuations; each step sees those before."""
    links = extracted.groupBy("document_id", "source_id", "target_id", "kind").agg(F.max("score").alias("score"))
    # the captions are matched one after the other: done once, as both later steps look at them
    links = materialize(links.unionByName(caption_links(elements, links, most)), "captions")
    return links.unionByName(near_links(elements, links, most)).unionByName(continuation_links(elements, links, page_sizes))


def table_chains(elements: DataFrame, links: DataFrame) -> DataFrame:
    """Tables with the head and the place in their chain: islands over reading order, as links join consecutive tables."""
    parts = links.where("kind = 'continues'").select("document_id", F.col("source_id").alias("id"), F.lit(1).alias("part"))
    t = elements.where(is_("table")).select("document_id", "id", "reading_order").join(parts, ["document_id", "id"], "left")
    order = W.partitionBy("document_id").orderBy("reading_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("chain", F.sum(F.when(F.col("part").isNull(), 1).otherwise(0)).over(order))
    chain = W.partitionBy("document_id", "chain").orderBy("reading_order")
    return t.select("document_id", "id", "chain", F.first("id").over(chain).alias("head_id"), (F.row_number().over(chain) - 1).alias("place"))


# Figures --------------------------------------------------------------------------------------------------------------


def repeated_images(elements: DataFrame, hashes: DataFrame, pages: DataFrame) -> DataFrame:
    """Images whose crop is on several pages of their document: at least three, or a fifth of all. pages(document_id, total)."""
    h = elements.where(is_("image")).select("document_id", "id", "page").join(hashes.select(F.col("element_id").alias("id"), "sha256"), "id")
    per = h.groupBy("document_id", "sha256").agg(F.countDistinct("page").alias("on")).where("on > 1").join(pages, "document_id")
    often = per.where((F.col("on") >= DECORATIVE_PAGES) | (F.col("on") / F.greatest(F.col("total"), F.lit(1)) >= DECORATIVE_SHARE))
    return h.join(often, ["document_id", "sha256"], "left_semi").select("id")


def triage(elements: DataFrame, hashes: DataFrame, page_sizes: DataFrame, pages: DataFrame, describe: bool = True) -> DataFrame:
    """Elements with decorative images flagged and figures that are not described marked as skipped; to_describe tells those
    that are: not decorative, with a crop, and covering enough of their page."""
    repeated = repeated_images(elements, hashes, pages).withColumn("_repeated", F.lit(True))
    crops = hashes.select(F.col("element_id").alias("id")).distinct().withColumn("_crop", F.lit(True))
    size = page_sizes.select("document_id", "page", (F.col("width") * F.col("height")).alias("_page_area"))
    e = elements.join(repeated, "id", "left").join(crops, "id", "left").join(size, ["document_id", "page"], "left")
    image = is_("image")
    decorative = image & (F.coalesce(F.col("image_class").isin(*DECORATIVE_CLASSES), F.lit(False)) | F.col("_repeated").isNotNull() | F.coalesce("is_decorative", F.lit(False)))
    e = e.withColumn("is_decorative", decorative)
    known = F.coalesce("_page_area", F.raise_error(F.lit("a page has no size")).cast("double"))
    worth = image & ~F.col("is_decorative") & F.col("_crop").isNotNull() & F.lit(describe)
    e = e.withColumn("to_describe", F.when(worth, G.area(element_box()) / known >= DESCRIBED_SHARE).otherwise(False))
    status = F.when(image & ~F.col("to_describe"), "skipped").otherwise(F.col("description_status"))
    return e.withColumn("description_status", status).select(*elements.columns, "to_describe")


def description_context(elements: DataFrame, links: DataFrame) -> DataFrame:
    """image_id, caption, context: texts linked to each image, in reading order, null where there are none."""
    e = elements.select("document_id", F.col("id").alias("source_id"), "reading_order", "text").where("text <> ''")
    got = links.where(F.col("kind").isin("caption_of", "near")).join(e, ["document_id", "source_id"])
    joined = lambda kind: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("reading_order", "text")))), lambda x: x["text"]), "\n"), F.lit(""))
    return got.groupBy("document_id", F.col("target_id").alias("image_id")).agg(joined("caption_of").alias("caption"), joined("near").alias("context"))


# Units ----------------------------------------------------------------------------------------------------------------

def packing_plan(texts: list[str], sentences: list[list[str]], path: list[str], max_tokens: int, count: Callable[[str], int]) -> list[tuple[int, int, int]]:
    """How a run of texts under one heading path becomes units: (first, end, 0) takes whole texts; (text, begin, end) with
    end > 0 takes these sentences of one text that alone is too long."""

    def room(parts: list[str], join: str) -> bool:
        return count("\n".join([*path, join.join(parts)])) <= max_tokens

    plan, first = [], 0
    for i, text in enumerate(texts):
        if room(texts[first : i + 1], "\n"):
            continue
        if first < i:
            plan.append((first, i, 0))
        first = i
        if not room([text], "\n"):
            begin = 0
            for n in range(1, len(sentences[i])):
                if not room(sentences[i][begin : n + 1], " "):
                    plan.append((i, begin, n))
                    begin = n
            plan.append((i, begin, len(sentences[i])))
            first = i + 1
    return plan + ([(first, len(texts), 0)] if first < len(texts) else [])


def text_members(flowing: DataFrame, max_tokens: int, count: Callable[[str], int]) -> DataFrame:
    """flowing(document_id, run, id, reading_order, text, heading_path) -> document_id, unit_key, id, part, nth: which text, or
    piece of one, goes to which unit, and its reading order. The plan of a run is made in one step, as each choice depends on those before."""
    rows = flowing.withColumn("sentences", T.split_sentences(F.col("text")))

    def run(document: str, members: list[dict]):
        runs: dict[int, list[dict]] = {}
        for m in members:
            runs.setdefault(m["run"], []).append(m)
        for ms in runs.values():
            pieces: dict[str, int] = {}
            for first, end, stop in packing_plan([m["text"] for m in ms], [m["sentences"] for m in ms], ms[0]["heading_path"], max_tokens, count):
                lead = ms[first]["id"]
                if not stop:
                    yield from ((document, f"text:{lead}", m["id"], m["text"], m["reading_order"]) for m in ms[first:end])
                    continue
                pieces[lead] = pieces.get(lead, -1) + 1
                yield document, f"text:{lead}:{pieces[lead]}", lead, " ".join(ms[first]["sentences"][end:stop]), ms[first]["reading_order"]

    return per_document(rows.select("document_id", "reading_order", "run", "id", "text", "heading_path", "sentences"), "reading_order", run, "document_id string, unit_key string, id string, part string, nth int")


def build_units(elements: DataFrame, links: DataFrame, max_tokens: int = MAX_TOKENS, count=None) -> DataFrame:
    """Retrieval units: free text merged up to a ceiling that counts the heading path, an oversize paragraph cut at sentence
    ends, one unit per chain of tables (titles first), one per content figure that has any text.

    Each element is first dealt to its unit as a member with its part of the text: tables and figures by joins on chains and
    captions, free text by windows that number its runs and a plan per run. Units are then one aggregation of their members.
    count: tokens of a text, white-space words by default."""
    count = count or (lambda text: len(text.split()))
    e = heading_path(elements).withColumn("text", F.coalesce("text", F.lit("")))
    captions = links.where(F.col("kind").isin("caption_of", "title_of")).groupBy("document_id", F.col("source_id").alias("id")).agg(F.min("target_id").alias("captioned"))
    e = e.join(captions, ["document_id", "id"], "left").join(table_chains(elements, links).select("document_id", "id", "head_id", "place"), ["document_id", "id"], "left")
    content = is_("image") & ~F.coalesce("is_decorative", F.lit(False))
    # free text: what lies between headings, tables and content figures is a run
    ends = is_("heading") | is_("table") | content
    upto = W.partitionBy("document_id").orderBy("reading_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = materialize(e.withColumn("run", F.sum(ends.cast("int")).over(upto)), "elements")
    flowing = e.where(F.col("kind").isin(*FLOWING_KINDS) & F.col("captioned").isNull() & (F.col("text") != ""))
    at = F.col("reading_order")
    free = text_members(flowing, max_tokens, count).select("document_id", "unit_key", F.lit("text").alias("unit_type"), "id", "part", F.lit(0).alias("rank"), "nth")
    # a chain of tables: the titles of its parts in order, then the parts, each without a repeated header
    tables = e.where(is_("table"))
    heads = tables.where("place = 0").select("document_id", F.col("id").alias("head_id"), F.col("table_rows").alias("head_rows"))
    tables = tables.join(heads, ["document_id", "head_id"])
    shown = F.when((F.col("place") > 0) & T.repeats_header(F.col("head_rows"), F.col("table_rows")), T.strip_header(F.col("text"))).otherwise(F.col("text"))
    key = F.concat(F.lit("table:"), "head_id").alias("unit_key")
    parts = tables.select("document_id", key, F.lit("table").alias("unit_type"), "id", shown.alias("part"), F.lit(1).alias("rank"), at.alias("nth"))
    told = e.where("captioned is not null").select("document_id", "id", "text", "captioned", at.alias("nth"))
    title = told.join(tables.select("document_id", F.col("id").alias("captioned"), "head_id"), ["document_id", "captioned"])
    titles = title.select("document_id", key, F.lit("table").alias("unit_type"), "id", F.col("text").alias("part"), F.lit(0).alias("rank"), "nth")
    # a content figure: its captions, then its labels and description
    figures = e.where(content)
    key = F.concat(F.lit("figure:"), F.col("image_id")).alias("unit_key")
    own = T.figure_text(F.array().cast("array<string>"), F.coalesce("labels", F.array().cast("array<string>")), F.col("description"))
    figure = figures.withColumn("image_id", F.col("id")).select("document_id", key, F.lit("figure").alias("unit_type"), "id", F.coalesce(own, F.lit("")).alias("part"), F.lit(1).alias("rank"), at.alias("nth"))
    named = told.join(figures.select("document_id", F.col("id").alias("captioned")), ["document_id", "captioned"]).withColumn("image_id", F.col("captioned"))
    named = named.select("document_id", key, F.lit("figure").alias("unit_type"), "id", F.col("text").alias("part"), F.lit(0).alias("rank"), "nth")
    members = free.unionByName(parts).unionByName(titles).unionByName(figure).unionByName(named)
    # what a unit takes from its members
    near = links.where("kind = 'near'").join(figures.select("document_id", F.col("id").alias("target_id"), at.alias("_at")), ["document_id", "target_id"])
    near = near.groupBy("document_id", F.col("source_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "target_id"))), lambda x: x["target_id"]).alias("near_figures"))
    box = F.struct("page", *(F.col(f"bbox_{s}").alias(s) for s in ("left", "top", "right", "bottom")))
    facts = e.select("document_id", "id", "page", box.alias("box"), "heading_path", "image_key").join(near, ["document_id", "id"], "left")
    members = members.join(facts, ["document_id", "id"])
    listed = lambda *columns: F.array_sort(F.collect_list(F.struct(*columns)))
    # the member that names a unit gives its path: the first text, the head of a chain, the figure
    leads = F.min_by(F.struct("heading_path", "image_key"), F.struct(F.when(F.col("unit_type") == "text", F.lit(0)).otherwise(1 - F.col("rank")), "nth"))
    units = members.groupBy("document_id", "unit_type", "unit_key").agg(listed("rank", "nth", "part").alias("texts"), F.array_sort(F.collect_set("page")).alias("pages"), listed("nth", "id", "box", "near_figures").alias("of"), leads.alias("lead"))
    text = F.array_join(F.filter(F.transform("texts", lambda x: x["part"]), lambda t: (t != "") | (F.col("unit_type") != "figure")), "\n")
    figure_ids = F.array_distinct(F.flatten(F.transform("of", lambda x: F.coalesce(x["near_figures"], F.array().cast("array<string>")))))
    units = units.select("document_id", "unit_type", "unit_key", text.alias("text"), F.col("lead.heading_path").alias("heading_path"), "pages", F.transform("of", lambda x: x["id"]).alias("element_ids"), F.transform("of", lambda x: x["box"]).alias("boxes"), figure_ids.alias("figure_ids"), F.when(F.col("unit_type") == "figure", F.col("lead.image_key")).alias("image_key"))
    return units.where("unit_type <> 'figure' or text <> ''")


def identified(units: DataFrame, documents: DataFrame) -> DataFrame:
    """Units with their stable id, from the document's fingerprint and the unit's key."""
    d = documents.select(F.col("id").alias("document_id"), "sha256")
    return units.join(d, "document_id").withColumn("id", I.unit_id(F.col("sha256"), F.col("unit_key"))).drop("sha256")


# Summary --------------------------------------------------------------------------------------------------------------


def has_text() -> Column:
    return ~F.col("kind").isin("image", "page_furniture") & F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))


def job_summary(elements: DataFrame, links: DataFrame, units: DataFrame) -> DataFrame:
    """One row per document: counts of what a job produced."""
    image = is_("image")
    per = elements.groupBy("document_id").agg(
        F.countDistinct("page").alias("pages"),
        F.count_if(F.col("kind").isin(*TEXT_KINDS)).alias("text_elements"),
        F.count_if(is_("table")).alias("tables"),
        F.count_if(image).alias("images"),
        *(F.count_if(image & (F.col("description_status") == s)).alias(f"figures_{s}") for s in ("described", "skipped", "not_described")),
        F.countDistinct(F.when(F.col("origin") == "recognized", F.col("page"))).alias("recognized_pages"),
    )
    edges = links.where("kind = 'continues'")
    heads = edges.select("document_id", F.col("target_id").alias("id")).distinct().join(edges.select("document_id", F.col("source_id").alias("id")), ["document_id", "id"], "left_anti")
    chains = heads.groupBy("document_id").agg(F.count("*").alias("table_chains"))
    made = units.groupBy("document_id").agg(F.count("*").alias("retrieval_units"))
    out = per.join(chains, "document_id", "left").join(made, "document_id", "left")
    return out.na.fill(0, ["table_chains", "retrieval_units"])
