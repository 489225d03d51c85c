"""Elements from plain text and web pages.

Text lines become elements in reading order. Their kinds and boxes follow a fixed rule over line numbers, as plain text has
no layout: twelve lines a page of 612 x 792 points; furniture at either end, one heading, one image with a caption below,
and tables at the foot of a page that may go on at the head of the next. SYNTHETIC: it exercises the layout operators and
says nothing about real documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES, WIDTH, HEIGHT = 12, 612.0, 792.0


def line_elements(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> elements with document_id (text of doc_id) and id (document:line)."""
    rows = documents.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
    slot, page = F.col("n") % LINES, F.floor(F.col("n") / LINES).cast("int") + 1
    goes_on = (F.col("doc_id") + page) % 3 != 0
    kind = (
        F.when(slot.isin(0, 11), "page_furniture")
        .when((slot == 10) | ((slot == 1) & (page > 1) & goes_on), "table")
        .when(slot == 3, "heading")
        .when(slot == 5, "image")
        .when(slot == 6, "caption")
        .otherwise("paragraph")
    )
    right_half = ((F.col("doc_id") + F.col("n")) % 5 == 0) & ~slot.isin(5, 6)
    top = (slot * 60 + 30).cast("double")
    document = F.col("doc_id").cast("string")
    return rows.select(
        F.concat_ws(":", document, F.col("n").cast("string")).alias("id"),
        document.alias("document_id"),
        kind.alias("kind"),
        page.alias("page"),
        F.when(right_half, 320.0).otherwise(72.0).alias("bbox_left"),
        top.alias("bbox_top"),
        F.when(right_half, 540.0).otherwise(290.0).alias("bbox_right"),
        (top + 40).alias("bbox_bottom"),
        F.col("n").cast("int").alias("reading_order"),
        F.lit("text_layer").alias("origin"),
        F.when(kind == "heading", ((F.col("n") + F.col("doc_id")) % 4 + 1).cast("int")).alias("heading_level"),
        F.when(kind != "image", F.col("line")).alias("text"),
        F.when(kind == "table", F.array(F.array(F.lit("Part"), F.lit("Code")), F.array(F.col("line"), F.lit("A-1")))).alias("table_rows"),
        F.lit(None).cast("double").alias("confidence"),
        F.when(kind == "image", F.concat(F.lit("figures/"), document, F.lit("/"), F.col("n").cast("string"), F.lit(".png"))).alias("image_key"),
        F.when(kind == "image", F.when(F.length("line") % 7 == 0, "logo").otherwise("diagram")).alias("image_class"),
        F.when(kind == "image", F.slice(F.split("line", " "), 1, 3)).otherwise(F.array().cast("array<string>")).alias("labels"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("description_status"),
        F.array().cast("array<string>").alias("unverified_identifiers"),
        F.lit(False).alias("is_decorative"),
    )


def page_sizes(elements: DataFrame) -> DataFrame:
    return elements.select("document_id", "page").distinct().select("document_id", "page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def no_links(elements: DataFrame) -> DataFrame:
    return elements.select("document_id", F.col("id").alias("source_id"), F.col("id").alias("target_id"), F.lit("near").alias("kind"), F.lit(0.0).alias("score")).limit(0)


# Web pages --------------------------------------------------------------------------------------------------------------

KINDS = "h[1-6]|p|li|td|th|figcaption|footer"
#: A tag of any block element ends the block before it, so unclosed ones end where the next begins.
BLOCK_TAG = f"(?i)(</?(?:{KINDS}|nav|article|section|header|main|aside|div|ul|ol|table|tr|body|html)\\b[^>]*>)"
IGNORED = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"


def unescape(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain(html: Column) -> Column:
    """Text of a fragment: no tags, entities resolved, white space collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, r"<[^>]*>", " ")), r"\s+", " "))


def web_elements(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) -> document_id, reading_order, kind, heading_level, text: blocks in document order; what stands in
    nav or footer is furniture, scripts, styles and comments are dropped, unclosed blocks end at the next one."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), IGNORED, "")
    # navigation is marked first, so that its list items are told apart
    html = F.regexp_replace(html, r"(?is)<nav\b.*?</nav\s*>", "<footer>nav</footer>")
    blocks = F.split(F.regexp_replace(html, BLOCK_TAG, "\u0001$1"), "\u0001")
    parts = F.transform(F.filter(blocks, lambda b: b.rlike(f"(?i)^<(?:{KINDS})\\b")), lambda b: F.struct(F.lower(F.regexp_extract(b, "^<([A-Za-z0-9]+)", 1)).alias("tag"), plain(b).alias("text")))
    rows = pages.select(F.col("page_id").cast("string").alias("document_id"), F.posexplode(F.filter(parts, lambda p: p["text"] != "")).alias("reading_order", "b"))
    tag = F.col("b.tag")
    kind = F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "list_item").when(tag == "figcaption", "caption").when(tag == "footer", "page_furniture").otherwise("paragraph")
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
    return rows.select("document_id", "reading_order", kind.alias("kind"), level.alias("heading_level"), F.col("b.text").alias("text"))
