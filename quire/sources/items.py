"""Items of a layout extractor to elements. items(document_id, item, parent, label, text, page, box, position, caption_of,
spans): one row per extracted item, parent naming the item that it lies in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Labels of extracted items to kinds of elements; others are paragraphs. Fixed values of the data model.
KIND_OF = {"title": "heading", "section_header": "heading", "list_item": "list_item", "caption": "caption", "table": "table", "picture": "image", "page_header": "page_furniture", "page_footer": "page_furniture"}


def kinds(items: DataFrame) -> DataFrame:
    """Adds kind: by label; what is referred to as a caption is one; items without a position are dropped."""
    table = F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])
    kind = F.when(F.col("caption_of").isNotNull(), "caption").otherwise(F.coalesce(table[F.col("label")], F.lit("paragraph")))
    return items.where("box is not null and page is not null").withColumn("kind", kind)


#: Steps up that all items of a batch take at once; those that are not at the top by then climb alone.
STEPS = 32


def _inside(item, parent, role):
    """Lists of a batch's documents, as Arrow arrays -> for each of their items the places of what it holds (an image's; others
    hold nothing), null for items that are held themselves. role: 0 goes to what holds it, 1 stays, 2 holds, 3 holds and keeps
    the list. All items climb a step at a time; a way up that leads back on itself ends where it would repeat."""
    import numpy as np
    import pyarrow as pa

    sizes = item.value_lengths().fill_null(0).to_numpy()
    names = pa.concat_arrays([item.flatten(), parent.flatten()]).dictionary_encode()
    codes = names.indices.fill_null(-1).to_numpy().astype(np.int64) + 1
    document = np.repeat(np.arange(len(sizes)), sizes)
    n, width = len(document), len(names.dictionary) + 1
    role = role.flatten().to_numpy(zero_copy_only=False)
    own, above = document * width + codes[:n], document * width + codes[n:]
    order = np.argsort(own, kind="stable")
    last = np.searchsorted(own[order], above, "right") - 1
    up = np.where((last >= 0) & (codes[n:] > 0) & (codes[:n] > 0), order[last], -1) if n else np.zeros(0, np.int64)
    up = np.where((up >= 0) & (own[up] == above), up, -1)
    who = np.flatnonzero((role == 0) & (up >= 0))
    at, held, holders = up[who], [], []
    for _ in range(STEPS):
        if not len(who):
            break
        held.append(who[role[at] > 1])
        holders.append(at[role[at] > 1])
        at = up[at]
        who, at = who[at >= 0], at[at >= 0]
    if len(who):
        alone = np.isin(held := np.concatenate(held), who)
        held, holders = [held[~alone]], [np.concatenate(holders)[~alone]]
        for i in who:
            x, seen = up[i], set()
            while x >= 0 and x not in seen:
                seen.add(x)
                x = up[x]
            ways = np.array([x for x in seen if role[x] > 1], np.int64)
            held.append(np.full(len(ways), i))
            holders.append(ways)
    held, holders = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (held, holders))
    gone = np.zeros(n, bool)
    gone[held] = True
    # a name given twice in a document: all its rows go, or hold the same
    same = order[np.searchsorted(own[order], own, "right") - 1] if n else order
    gone_names = np.zeros(n, bool)
    np.logical_or.at(gone_names, same, gone)
    listed = role[holders] == 3
    held, holders = held[listed], holders[listed]
    by = np.lexsort((held, holders))
    first = np.cumsum(sizes) - sizes
    counts = np.bincount(holders, minlength=n)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(held[by] - first[document[held[by]]], pa.int32()))
    lists = lists.take(pa.array(np.where(gone_names[same], -1, same), mask=gone_names[same]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), lists)


def owned(items: DataFrame) -> DataFrame:
    """items with kind -> without texts that belong to a table or an image they lie in, and with the labels of images: the
    non-blank texts inside, in order. Captions and footnotes stay, and so does an image inside a table.

    Ownership goes up through any depth of nesting, and a document's items are few enough for one task: they are gathered once, by
    one exchange; names and parents alone go to Python, in Arrow batches, and the places of what each item holds come back."""
    stays = F.col("kind") == "caption"
    stays = stays | F.coalesce(F.col("label") == "footnote", F.lit(False))
    role = F.when(F.col("kind") == "image", 3).when(F.col("kind") == "table", 2).when(stays, 1).otherwise(0).cast("tinyint")
    own = [c for c in items.columns if c != "document_id"]
    parent = F.when(F.col("document_id").isNotNull(), F.col("parent"))
    rows = items.select("document_id", *own, parent.alias("_parent"), role.alias("_role"))
    lists = rows.groupBy("document_id").agg(F.collect_list(F.struct(*own, "_parent", "_role")).alias("_rows"))
    inside = F.arrow_udf(_inside, "array<array<int>>")
    lists = lists.withColumn("_inside", inside("_rows.item", "_rows._parent", "_rows._role"))

    def labels(places):
        texts = F.filter(F.transform(places, lambda j: F.get("_rows", j)), lambda r: F.trim(r["text"]) != "")
        return F.transform(F.array_sort(F.transform(texts, lambda r: F.struct(r["position"].alias("position"), r["text"].alias("text")))), lambda x: x["text"])

    places = F.filter(F.sequence(F.lit(0), F.size("_rows") - 1), lambda i: F.get("_inside", i).isNotNull())
    kept = F.transform(places, lambda i: F.struct(F.get("_rows", i).alias("row"), labels(F.get("_inside", i)).alias("labels")))
    return lists.select("document_id", F.explode(kept).alias("_k")).select("document_id", *(F.col(f"_k.row.{c}").alias(c) for c in ["item", *(c for c in own if c != "item")]), F.col("_k.labels").alias("labels"))


def fragments(items: DataFrame) -> DataFrame:
    """A text merged across pages becomes one row per recorded span (page, box, start, end); spans that do not fit the text
    leave it whole."""
    n = F.length("text")
    good = (F.size("spans") > 1) & F.forall("spans", lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= n))
    whole = F.array(F.struct(F.col("page").alias("page"), F.col("box").alias("box"), F.lit(0).alias("start"), n.alias("end")))
    parts = items.select("*", F.posexplode_outer(F.when(F.coalesce(good, F.lit(False)), F.col("spans")).otherwise(whole)).alias("_n", "_s"))
    cut = F.when(F.coalesce(good, F.lit(False)), F.expr("substring(text, _s.start + 1, _s.end - _s.start)")).otherwise(F.col("text"))
    return parts.withColumns({"text": cut, "page": F.coalesce("_s.page", "page"), "box": F.coalesce("_s.box", "box"), "fragment": F.coalesce("_n", F.lit(0))}).drop("_s", "_n", "spans")


def numbered(items: DataFrame) -> DataFrame:
    """Reading order over all batches of a document, from 0."""
    order = W.partitionBy("document_id").orderBy("position", "fragment")
    return items.withColumn("reading_order", F.row_number().over(order) - 1)


def caption_links(elements: DataFrame) -> DataFrame:
    """Links of the captions that the extractor assigned: caption_of an image, title_of a table."""
    target = elements.where("kind in ('image', 'table')").select("document_id", F.col("item").alias("caption_of"), F.col("id").alias("target_id"), F.col("kind").alias("_kind"))
    source = elements.where("caption_of is not null").select("document_id", "caption_of", F.col("id").alias("source_id"))
    kind = F.when(F.col("_kind") == "image", "caption_of").otherwise("title_of").alias("kind")
    return source.join(target, ["document_id", "caption_of"]).select("document_id", "source_id", "target_id", kind, F.lit(None).cast("double").alias("score"))


# Extraction -------------------------------------------------------------------------------------------------------------

BOX = "struct<left:double,top:double,right:double,bottom:double>"
ITEM = f"item string, parent string, label string, text string, page int, box {BOX}, position int, caption_of string, spans array<struct<page:int,box:{BOX},start:int,end:int>>"


def extract(files: DataFrame, extractor: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """files(document_id, content) -> items of each document and, where the extractor fails in any way, one row with the
    error: a partial conversion counts as a corrupt document. extractor: bytes -> rows of ITEM; it runs once per file in
    Arrow batches, so a file's items stream out and no other file waits for them."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = f"document_id string, {ITEM}, error string"
    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)
    width = len(arrow) - 2

    def run(batches):
        for b in batches:
            for document, content in ((d.as_py(), c.as_py()) for d, c in zip(b.column(0), b.column(1))):
                try:
                    rows = [(document, *r, None) for r in extractor(content)]
                except Exception as e:  # whatever a parser raises makes the document corrupt
                    rows = [(document, *[None] * width, f"{type(e).__name__}: {e}")]
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    return files.select("document_id", "content").mapInArrow(run, schema)


def failures(extracted: DataFrame) -> DataFrame:
    """Documents that failed: corrupt ones, and those without any text."""
    has_text = F.coalesce(F.bool_or(F.col("text").rlike(r"(?U)\S") & ~F.coalesce(F.col("label").isin("picture", "page_header", "page_footer"), F.lit(False))), F.lit(False))
    per = extracted.groupBy("document_id").agg(F.max("error").alias("reason"), has_text.alias("_text"))
    code = F.when(F.col("reason").isNotNull(), "corrupt_document").when(~F.col("_text"), "no_extractable_text")
    return per.select("document_id", code.alias("failure_code"), "reason").where("failure_code is not null")


def succeeded(extracted: DataFrame) -> DataFrame:
    """Items of the documents that did not fail."""
    return extracted.join(failures(extracted).select("document_id"), "document_id", "left_anti").drop("error")
