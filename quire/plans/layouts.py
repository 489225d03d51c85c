"""Queries over the layout operators. Elements come from text lines under the synthetic rule of sources/lines.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout as Y
from quire.plans.library import table
from quire.plans.registry import query
from quire.sources import lines as L
from quire.sources.scratch import materialize

#: The same elements in SQL.
ELEMENTS = """
l as (select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 as n, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
s as (select *, n % 12 as slot, n // 12 + 1 as page from l),
k as (select *, case when slot in (0, 11) then 'page_furniture' when slot = 10 or (slot = 1 and page > 1 and (doc_id + page) % 3 <> 0) then 'table' when slot = 3 then 'heading' when slot = 5 then 'image' when slot = 6 then 'caption' else 'paragraph' end as kind,
  (doc_id + n) % 5 = 0 and slot not in (5, 6) as right_half from s),
e as (select doc_id::varchar as document_id, doc_id || ':' || n as id, n, page, kind, line, case when right_half then 320 else 72 end as x0, case when right_half then 540 else 290 end as x1, slot * 60 + 30 as y0, slot * 60 + 70 as y1,
  case when kind = 'heading' then (n + doc_id) % 4 + 1 end as level from k)
"""


def _elements(spark, d):
    return L.line_elements(table(spark, d, "documents"))


@query(
    "heading_path",
    f"""with {ELEMENTS}, p as (select *, {', '.join(f"last_value(case when kind = 'heading' and level <= {i} then struct_pack(l := level, t := line) end ignore nulls) over w as c{i}" for i in range(1, 7))} from e
    window w as (partition by document_id order by n rows between unbounded preceding and current row))
    select id, concat_ws(' > ', {', '.join(f"case when c{i}.l = {i} then c{i}.t end" for i in range(1, 7))}) as path from p""",
)
def heading_path(spark, d):
    return Y.heading_path(_elements(spark, d)).select("id", F.array_join("heading_path", " > ").alias("path"))


@query(
    "near_text",
    f"""with {ELEMENTS}, g as (select i.document_id, i.id as image, t.id as text_id, t.n, greatest(0, greatest(i.y0, t.y0) - least(i.y1, t.y1)) as gap from e i join e t on i.document_id = t.document_id and i.page = t.page and least(i.x1, t.x1) > greatest(i.x0, t.x0) where i.kind = 'image' and t.kind = 'paragraph')
    select document_id, text_id as source_id, image as target_id, 'near' as kind, round(1 - gap / 72.0, 6) as score from g where gap <= 72 qualify row_number() over (partition by image order by gap, n) = 1""",
)
def near_text(spark, d):
    e = _elements(spark, d)
    return Y.near_links(e, L.no_links(e)).withColumn("score", F.round("score", 6))


_CONTINUES = f"""with {ELEMENTS}, t as (select *, lead(id) over w as next_id, lead(page) over w as next_page, lead(y0) over w as next_y0, lead(n) over w as next_n from e where kind = 'table' window w as (partition by document_id order by n)),
    c as (select document_id, next_id as source_id, id as target_id from t where next_page = page + 1 and y1 > 396 and next_y0 < 396
      and not exists (select 1 from e b where b.document_id = t.document_id and b.n > t.n and b.n < t.next_n and b.kind not in ('page_furniture', 'image')))"""


@query("table_continuations", f"{_CONTINUES} select document_id, source_id, target_id, 'continues' as kind, 0.9 as score from c")
def table_continuations(spark, d):
    e = _elements(spark, d)
    return Y.continuation_links(e, L.no_links(e), L.page_sizes(e))


@query(
    "table_chains",
    f"""{_CONTINUES}, m as (select x.document_id, x.id, x.n, sum(case when c.source_id is null then 1 else 0 end) over (partition by x.document_id order by x.n) as chain from t x left join c on c.source_id = x.id)
    select document_id, id, first_value(id) over (partition by document_id, chain order by n) as head_id, (row_number() over (partition by document_id, chain order by n) - 1)::int as place from m""",
)
def table_chains(spark, d):
    e = _elements(spark, d)
    return Y.table_chains(e, Y.continuation_links(e, L.no_links(e), L.page_sizes(e))).select("document_id", "id", "head_id", "place")


@query(
    "job_summary",
    f"""{_CONTINUES} select e.document_id, count(distinct page) as pages, count(*) filter (kind in ('heading', 'paragraph', 'list_item', 'caption')) as text_elements, count(*) filter (kind = 'table') as tables, count(*) filter (kind = 'image') as images,
    (select count(distinct target_id) from c where c.document_id = e.document_id and target_id not in (select source_id from c)) as table_chains from e group by e.document_id""",
)
def job_summary(spark, d):
    e = _elements(spark, d)
    links = Y.continuation_links(e, L.no_links(e), L.page_sizes(e))
    return Y.job_summary(e, links, e.limit(0)).select("document_id", "pages", "text_elements", "tables", "images", "table_chains")


@query(
    "decorative_images",
    f"""with {ELEMENTS}, i as (select *, md5(substr(line, 1, 2)) as crop from e where kind = 'image'), t as (select document_id, max(page) as total from e group by 1),
    g as (select document_id, crop from i join t using (document_id) group by document_id, crop, total having count(distinct page) > 1 and (count(distinct page) >= 3 or count(distinct page) / greatest(total, 1) >= 0.2))
    select id, (length(line) % 7 = 0 or crop in (select crop from g where g.document_id = i.document_id)) as is_decorative,
    not (length(line) % 7 = 0 or crop in (select crop from g where g.document_id = i.document_id)) and page % 2 = 0 as to_describe from i""",
)
def decorative_images(spark, d):
    e = _elements(spark, d)
    crops = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("element_id"), F.md5(F.substring("line", 1, 2).cast("binary")).alias("sha256"))
    pages = e.groupBy("document_id").agg(F.max("page").alias("total"))
    # even pages are so small that a figure covers enough of them
    sizes = L.page_sizes(e).withColumns({c: F.when(F.col("page") % 2 == 0, F.col(c) / 2).otherwise(F.col(c)) for c in ("width", "height")})
    return Y.triage(e, crops, sizes, pages).where("kind = 'image'").select("id", "is_decorative", "to_describe")


@query("caption_matching", f"with {ELEMENTS} select document_id, id as source_id, document_id || ':' || (n - 1) as target_id, 'caption_of' as kind from e where kind = 'caption'")
def caption_matching(spark, d):
    e = _elements(spark, d)
    return Y.caption_links(e, L.no_links(e)).drop("score")


@query("retrieval_units")
def retrieval_units(spark, d):
    """Packing under a token ceiling depends on every choice before: SQL can't state it plainly; tests hold a plain version."""
    e = _elements(spark, d)
    e = materialize(e, "elements")
    return Y.build_units(e, materialize(Y.link_elements(e, L.no_links(e), L.page_sizes(e)), "links"))


@query(
    "first_on_page",
    f"with {ELEMENTS} select document_id, page, id from e where kind <> 'page_furniture' qualify row_number() over (partition by document_id, page order by n) = 1",
)
def first_on_page(spark, d):
    e = _elements(spark, d).where("kind <> 'page_furniture'")
    return e.groupBy("document_id", "page").agg(F.min_by("id", "reading_order").alias("id"))
