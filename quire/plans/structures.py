"""Queries over extracted items, stored generations, sources, citations and small rules. Inputs are made from the driver's
tables by fixed rules, the same in the query and in its SQL, so that each case of a rule occurs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.functions import vectors as V
from quire.operators import answering as A
from quire.operators import evaluation as E
from quire.operators import ingestion as N
from quire.operators import layout as Y
from quire.operators import relational as R
from quire.operators import search as S
from quire.plans.layouts import ELEMENTS
from quire.plans.library import table
from quire.plans.registry import query
from quire.sources import files as Fi
from quire.sources import items as It
from quire.sources import lines as L
from quire.sources import schemas
from quire.sources.scratch import materialize, scratch
from quire.sources.store import Store

# Geometry -------------------------------------------------------------------------------------------------------------

_BOXES = "b as (select l_orderkey, l_linenumber, l_quantity as x0, l_quantity + l_linenumber as x1, l_linenumber * 3.0 as y0, l_linenumber * 3.0 + l_quantity as y1 from lineitem)"


@query(
    "box_geometry",
    f"""with {_BOXES} select l_orderkey, l_linenumber, round((x1 - x0) * (y1 - y0), 6) as area, round(sqrt(pow(greatest(0, x0 - 20, 10 - x1), 2) + pow(greatest(0, y0 - 20, 10 - y1), 2)), 6) as gap,
    round(case when least(x1, 20) > greatest(x0, 10) then greatest(0, y0 - 20, 10 - y1) end, 6) as column_gap, round(y0, 6) as flipped_bottom_from_top, round(100 - y1, 6) as flipped_top from b""",
)
def box_geometry(spark, d):
    """Area, distance and column distance of boxes, and boxes from the other origin."""
    i = table(spark, d, "lineitem")
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber")
    b, other = G.box(q, n * 3.0, q + n, n * 3.0 + q), G.box(F.lit(10), F.lit(10), F.lit(20), F.lit(20))
    turned = G.from_bottom_left(q, n * 3.0, q + n, n * 3.0 + q, F.lit(100.0), F.lit(100.0))
    one = F.lit(1)
    return i.select("l_orderkey", "l_linenumber", F.round(G.area(b), 6).alias("area"), F.round(G.gap(b, other), 6).alias("gap"), F.round(G.column_gap(b, one, other, one), 6).alias("column_gap"), F.round(100 - turned["bottom"], 6).alias("flipped_bottom_from_top"), F.round(turned["top"], 6).alias("flipped_top"))


# Items ----------------------------------------------------------------------------------------------------------------

#: Order lines as items: lines 1 are pictures or tables, others lie in the line before (so nesting has any depth up to seven).
_ITEMS = """i as (select l_orderkey::varchar as document_id, 'i' || l_linenumber as item, case when l_linenumber > 1 then 'i' || (l_linenumber - 1) end as parent, l_linenumber as n, l_returnflag as text,
  case when l_linenumber = 1 and l_orderkey % 3 = 0 then 'image' when l_linenumber = 1 and l_orderkey % 3 = 1 then 'table' when l_linenumber = 4 and l_orderkey % 2 = 0 then 'image' when l_linenumber = 5 then 'caption' else 'paragraph' end as kind, l_linenumber = 6 as footnote from (select l_orderkey, l_linenumber, min(l_returnflag) as l_returnflag from lineitem group by all))"""


def _order_lines(spark, d, *columns):
    """One row for each order and line number, which the table may repeat."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in columns or ("l_partkey",)))


def _items(spark, d):
    # dealt out by document before anything is grouped: all that follows needs no other exchange
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("document_id"), "l_orderkey", "l_linenumber", "l_returnflag").repartition("document_id")
    i = lines.groupBy("document_id", "l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    kind = F.when((n == 1) & (o % 3 == 0), "image").when((n == 1) & (o % 3 == 1), "table").when((n == 4) & (o % 2 == 0), "image").when(n == 5, "caption").otherwise("paragraph")
    name = lambda k: F.concat(F.lit("i"), k.cast("string"))
    return i.select("document_id", name(n).alias("item"), F.when(n > 1, name(n - 1)).alias("parent"), n.alias("position"), F.col("l_returnflag").alias("text"), kind.alias("kind"), F.when(n == 6, "footnote").alias("label"))


@query(
    "nested_ownership",
    f"""with recursive {_ITEMS}, up as (select document_id, item, n, text, parent as ancestor from i where parent is not null and kind not in ('caption', 'image', 'table') and not footnote
      union all select u.document_id, u.item, u.n, u.text, p.parent from up u join i p on p.document_id = u.document_id and p.item = u.ancestor where p.parent is not null),
    held as (select u.document_id, u.item, u.n, u.text, h.item as holder, h.kind as holder_kind from up u join i h on h.document_id = u.document_id and h.item = u.ancestor where h.kind in ('image', 'table')),
    lab as (select document_id, holder as item, string_agg(text, '|' order by n) as labels from held where holder_kind = 'image' group by all)
    select i.document_id, i.item, coalesce(labels, '') as labels from i left join lab using (document_id, item) where (i.document_id, i.item) not in (select document_id, item from held)""",
)
def nested_ownership(spark, d):
    """Texts inside images and tables, at any depth, go to them; images collect them as labels."""
    return It.owned(_items(spark, d)).select("document_id", "item", F.array_join("labels", "|").alias("labels"))


@query(
    "item_fragments",
    """with f as (select doc_id::varchar as document_id, text, length(text) as n from documents), g as (select *, n >= 10 and doc_id2 % 3 <> 0 as good from (select *, document_id::bigint as doc_id2 from f)),
    p as (select document_id, unnest(case when good then [1, 2] else [1] end) as k, text, n, good from g)
    select document_id, k - 1 as fragment, case when not good then text when k = 1 then substr(text, 1, 4) else substr(text, 6) end as text, (row_number() over (partition by document_id order by k) - 1)::int as reading_order from p""",
)
def item_fragments(spark, d):
    """Texts that go on over a page break become a row for each page; spans that do not fit leave them whole."""
    docs = table(spark, d, "documents").where("text is not null")
    box = F.lit(None).cast(It.BOX)
    span = lambda page, a, b: F.struct(F.lit(page).alias("page"), box.alias("box"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    n = F.length("text")
    end = F.when(F.col("doc_id") % 3 == 0, n + 5).otherwise(n)  # beyond the text: the spans do not fit
    items = docs.select(F.col("doc_id").cast("string").alias("document_id"), "text", F.lit(1).alias("page"), box.alias("box"), F.lit(0).alias("position"), F.when(n >= 10, F.array(span(1, F.lit(0), F.lit(4)), span(2, F.lit(5), end))).otherwise(F.array(span(1, F.lit(0), n))).alias("spans"))
    return It.numbered(It.fragments(items)).select("document_id", "fragment", "text", "reading_order")


@query("item_kinds", "select l_orderkey, l_linenumber, case when l_linenumber % 5 = 4 then 'caption' when l_partkey % 6 = 0 then 'heading' when l_partkey % 6 = 1 then 'table' when l_partkey % 6 = 2 then 'image' when l_partkey % 6 = 3 then 'page_furniture' else 'paragraph' end as kind from lineitem where l_linenumber <> 7")
def item_kinds(spark, d):
    i = table(spark, d, "lineitem")
    label = F.create_map(*[F.lit(x) for kv in ((0, "section_header"), (1, "table"), (2, "picture"), (3, "page_footer")) for x in kv])
    box = F.when(F.col("l_linenumber") != 7, F.lit(1))
    items = i.select("l_orderkey", "l_linenumber", F.coalesce(label[(F.col("l_partkey") % 6).cast("int")], F.lit("text")).alias("label"), F.when(F.col("l_linenumber") % 5 == 4, "i1").alias("caption_of"), F.lit(1).alias("page"), box.alias("box"))
    return It.kinds(items).select("l_orderkey", "l_linenumber", "kind")


@query(
    "outline_levels",
    """with recursive o as (select user_id, row_number() over (partition by user_id order by ts, event_id)::int as p, (event_id % 4)::int as depth, event_type as key from events),
    up as (select user_id, p, depth, key, (select max(p) from o b where b.user_id = a.user_id and b.p < a.p and b.depth < a.depth) as parent from o a),
    lv as (select user_id, p, key, 0 as real from up where parent is null union all select c.user_id, c.p, c.key, l.real + (l.key <> c.key)::int from up c join lv l on l.user_id = c.user_id and l.p = c.parent),
    t as (select *, min(real) over (partition by user_id) as top, count(*) over (partition by user_id) as n from lv), s as (select *, sum((real = top)::int) over (partition by user_id) as tops from t)
    select user_id::varchar as document_id, p as position, least(real - top - (n > 1 and tops = 1)::int + 1, 6)::int as level from s where real - top - (n > 1 and tops = 1)::int + 1 > 0""",
)
def outline_levels(spark, d):
    """The events of a user as bookmarks of an outline."""
    from pyspark.sql import Window as W

    e = table(spark, d, "events")
    p = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    outline = e.select(F.col("user_id").cast("string").alias("document_id"), p.alias("position"), (F.col("event_id") % 4).cast("int").alias("depth"), F.col("event_type").alias("title"), F.lit(1).alias("page"))
    return Y.outline_levels(outline).select("document_id", "position", F.col("level").cast("int").alias("level"))


# Units ----------------------------------------------------------------------------------------------------------------


@query(
    "table_and_figure_units",
    f"""with {ELEMENTS}, t as (select *, lead(id) over w as next_id, lead(page) over w as next_page, lead(y0) over w as next_y0, lead(n) over w as next_n from e where kind = 'table' window w as (partition by document_id order by n)),
    c as (select next_id as source_id from t where next_page = page + 1 and y1 > 396 and next_y0 < 396 and not exists (select 1 from e b where b.document_id = t.document_id and b.n > t.n and b.n < t.next_n and b.kind not in ('page_furniture', 'image'))),
    m as (select x.*, sum(case when c.source_id is null then 1 else 0 end) over (partition by x.document_id order by x.n) as chain from t x left join c on c.source_id = x.id),
    tu as (select 'table:' || min_by(id, n) as unit_key, document_id, string_agg(line, chr(10) order by n) as text, count(*) as elements from m group by document_id, chain),
    fi as (select i.document_id, 'figure:' || i.id as unit_key, c.line as caption, array_to_string(string_split(i.line, ' ')[1:3], ' ') as labels, c.id is not null as told from e i left join e c on c.document_id = i.document_id and c.n = i.n + 1 and c.kind = 'caption' where i.kind = 'image'),
    fu as (select unit_key, document_id, concat_ws(chr(10), nullif(coalesce(caption, ''), ''), nullif(labels, '')) as text, 1 + told::int as elements from fi)
    select document_id, unit_key, text, elements::int as elements from tu union all select document_id, unit_key, text, elements::int from fu where text <> ''""",
)
def table_and_figure_units(spark, d):
    """Units of table chains and of figures; free text is packed sequentially and has a plain version in the tests."""
    e = materialize(L.line_elements(table(spark, d, "documents")), "line-elements")
    links = materialize(Y.link_elements(e, L.no_links(e), L.page_sizes(e)), "line-links")
    units = Y.build_units(e, links).where("unit_type <> 'text'")
    return units.select("document_id", "unit_key", "text", F.size("element_ids").alias("elements"))


@query("free_text_units", f"with {ELEMENTS} select document_id, id, page from e where kind = 'paragraph' and line <> ''")
def free_text_units(spark, d):
    """Every paragraph is in just one text unit, however the packing cuts."""
    e = materialize(L.line_elements(table(spark, d, "documents")), "line-elements")
    links = materialize(Y.link_elements(e, L.no_links(e), L.page_sizes(e)), "line-links")
    units = Y.build_units(e, links, 60).where("unit_type = 'text'")
    # a paragraph that is cut has a unit for each piece
    members = units.select("document_id", F.explode("element_ids").alias("id"), F.explode("pages").alias("page"))
    return members.join(e.select("document_id", "id", "page"), ["document_id", "id", "page"]).distinct().select("document_id", "id", "page")


# Text rules -----------------------------------------------------------------------------------------------------------


@query(
    "table_headers",
    r"""with t as (select l_orderkey, l_linenumber, l_returnflag, '|' || l_returnflag || '|' || chr(10) || case when l_linenumber % 2 = 0 then '|:---|' || chr(10) else '' end || '|x|' || chr(10) || '|---|' as md from lineitem)
    select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then '|x|' || chr(10) || '|---|' else '' end as stripped, l_linenumber % 3 <> 0 as repeats from t""",
)
def table_headers(spark, d):
    i = table(spark, d, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    md = F.concat(F.lit("|"), "l_returnflag", F.lit("|\n"), F.when(even, "|:---|\n").otherwise(""), F.lit("|x|\n|---|"))
    head = F.array(F.array(F.lit("Part  No"), F.col("l_returnflag")))
    part = F.when(F.col("l_linenumber") % 3 != 0, F.array(F.array(F.lit("part no"), F.lower("l_returnflag")))).otherwise(F.array(F.array(F.lit("part no"))))
    return i.select("l_orderkey", "l_linenumber", T.strip_header(md).alias("stripped"), T.repeats_header(head, part).alias("repeats"))


@query(
    "statements",
    r"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from documents),
    s as (select doc_id, i, generate_subscripts(p, 1) as j, unnest(p) as s from (select doc_id, i, string_split(regexp_replace(trim(line, ' ' || chr(9) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as p from l)),
    k as (select * from s where len(regexp_extract_all(s, '[\p{L}\p{N}_-]+')) >= 3)
    select doc_id, count(*) as statements, md5(string_agg(trim(s), chr(10) order by i, j)) as digest from k group by doc_id""",
)
def statements(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.find_statements(F.col("text")).alias("s")).where(F.size("s") > 0)
    return s.select("doc_id", F.size("s").cast("long").alias("statements"), F.md5(F.array_join(F.transform("s", lambda x: x["text"]), "\n").cast("binary")).alias("digest"))


@query(
    "marker_insertion",
    """with t as (select conv_id, turn, 'See ' || role || case turn % 3 when 0 then '.' when 1 then '!' else '' end as a from conversations)
    select conv_id, turn, case when right(a, 1) in ('.', '!') then left(a, length(a) - 1) || ' [1] [2]' || right(a, 1) else a || ' [1] [2]' end || ' More here.' as text from t""",
)
def marker_insertion(spark, d):
    c = table(spark, d, "conversations")
    a = F.concat(F.lit("See "), "role", F.when(F.col("turn") % 3 == 0, ".").when(F.col("turn") % 3 == 1, "!").otherwise(""))
    marks = F.array(*(F.struct(F.length("a").alias("end"), F.lit(n).alias("number")) for n in (2, 1)))
    return c.withColumn("a", a).select("conv_id", "turn", T.insert_markers(F.concat("a", F.lit(" More here.")), marks).alias("text"))


@query(
    "marker_forms",
    r"""with t as (select conv_id, turn, turn % 5 as f from conversations)
    select conv_id, turn, case f when 0 then 'as [1]' when 1 then 'as [1][2]' when 2 then 'as [1][2]' when 3 then 'as' else 'as [x] [ 1]' end as text, f in (0, 1, 2, 3) as marked, case f when 0 then 'u2' when 1 then 'u1,u2' when 2 then 'u1,u2' else '' end as units from t""",
)
def marker_forms(spark, d):
    """Doubled and wide brackets, lists and ranges resolved against two sources; numbers beyond them go, other brackets stay."""
    c = table(spark, d, "conversations")
    f = F.col("turn") % 5
    answer = F.when(f == 0, "as [[2]]").when(f == 1, "as 【1】[2]").when(f == 2, "as [1-9]").when(f == 3, "as [7, 8]").otherwise("as [x] [ 1]")
    source = lambda n: F.struct(F.lit(f"u{n}").alias("unit_id"), F.lit(f"d{n}").alias("document_id"), F.array(F.lit(n)).alias("pages"))
    got = c.withColumn("answer", answer).withColumn("r", T.resolve_citations(F.col("answer"), F.array(source(1), source(2))))
    units = F.array_join(F.flatten(F.transform("r.citations", lambda x: x["unit_ids"])), ",")
    return got.select("conv_id", "turn", F.col("r.text").alias("text"), T.has_markers(F.col("answer")).alias("marked"), units.alias("units"))


@query("texts_of_units", "select doc_id, lang || chr(10) || source || chr(10) || text as embedding_text, case when doc_id % 2 = 0 then lang || chr(10) else '' end || source || ' ' || lang as figure_text from documents where text is not null")
def texts_of_units(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    caption = F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("")
    return docs.select("doc_id", T.embedding_text(F.array("lang", "source"), F.col("text")).alias("embedding_text"), T.figure_text(F.array(caption), F.array("source", "lang"), F.lit(None).cast("string")).alias("figure_text"))


@query("has_text", f"with {ELEMENTS} select id, kind not in ('image', 'page_furniture') and regexp_matches(line, '[^ \\t\\n\\r\\f\\v]') as has_text from e")
def has_text(spark, d):
    return L.line_elements(table(spark, d, "documents")).select("id", Y.has_text().alias("has_text"))


@query("upload_rules", "select page_id, case when page_id % 7 = 0 then 'invalid_file_name' when length(html) = 0 then 'empty_file' when length(html) > 3000 then 'file_too_large' when page_id % 5 = 0 then 'unsupported_media_type' when page_id % 4 = 0 then 'encrypted_document' when page_id % 30 > 20 then 'too_many_pages' end as problem from pages")
def upload_rules(spark, d):
    p = table(spark, d, "pages")
    i = F.col("page_id")
    uploads = p.select("page_id", F.when(i % 7 != 0, "a.pdf").alias("file_name"), F.length("html").alias("size_bytes"), (i % 5 != 0).alias("is_pdf"), (i % 4 == 0).alias("encrypted"), (i % 30).alias("page_count"))
    return uploads.select("page_id", Fi.upload_problem(3000, 20).alias("problem"))


# Scores ---------------------------------------------------------------------------------------------------------------


@query("attribution_scores", "with v as (select vec_id, embedding::double[] as x from embeddings) select a.vec_id, round(list_cosine_similarity(a.x, b.x), 6) as cosine, round(0.7 * (a.vec_id % 3) / 3 + 0.3 * list_cosine_similarity(a.x, b.x), 6) as score from v a join v b on b.vec_id = a.vec_id + 1")
def attribution_scores(spark, d):
    v = table(spark, d, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    words, held = F.array(*(F.lit(w) for w in "abc")), F.slice(F.array(*(F.lit(w) for w in "abc")), 1, (F.col("vec_id") % 3).cast("int"))
    j = v.join(b, "vec_id")
    return j.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"), F.round(V.attribution_score(words, held, F.col("embedding"), F.col("other")), 6).alias("score"))


@query("rank_fusion", "select l_orderkey, round(sum(1 / (60.0 + l_linenumber)), 9) as score from lineitem group by l_orderkey")
def rank_fusion(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(V.rrf(F.col("l_linenumber"))), 9).alias("score"))


@query(
    "expected_hits",
    "select l.doc_id, doc_id % 4 = 0 or (doc_id % 4 = 1 and doc_id % 3 = 0) as supplied from labels l",
)
def expected_hits(spark, d):
    """Whether an outcome's sources hold the expected document and page."""
    i = F.col("doc_id")
    key = i.cast("string").alias("id")
    labels = table(spark, d, "labels")
    questions = labels.select(key, F.lit("answerable").alias("label"), F.lit(None).cast("string").alias("identifier"), F.lit("a.pdf").alias("expected_document"), F.array(F.lit(1), F.lit(2)).alias("expected_pages"))
    source = F.struct(F.when(i % 4 < 2, "a.pdf").otherwise("b.pdf").alias("document_name"), F.array(F.when((i % 4 == 0) | (i % 3 == 0), 2).otherwise(9)).alias("pages"))
    outcomes = labels.select(i.cast("string").alias("question_id"), F.array(source).alias("sources"))
    return E.hits_expected(outcomes, questions).select(F.col("question_id").cast("long").alias("doc_id"), "supplied")


# Rows -----------------------------------------------------------------------------------------------------------------


@query("ordered_members", "select o_orderkey, string_agg(l_linenumber::varchar, ',' order by l_linenumber desc) as members from orders join (select distinct l_orderkey, l_linenumber from lineitem) on l_orderkey = o_orderkey group by 1")
def ordered_members(spark, d):
    """Units with their elements in the order of their list of ids."""
    i = _order_lines(spark, d)
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    units = i.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", key.alias("k"))), asc=False), lambda x: x["k"]).alias("element_ids"))
    got = R.in_order(units, i.select(key.alias("id"), "l_linenumber"))
    return got.select(F.col("id").alias("o_orderkey"), F.array_join(F.transform("members", lambda x: x["l_linenumber"].cast("string")), ",").alias("members"))


@query("semi_lookup", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)")
def semi_lookup(spark, d):
    return R.semi_lookup(table(spark, d, "orders"), table(spark, d, "customer").where("c_nationkey = 3").select("c_custkey"), "o_custkey").select("o_orderkey")


@query("searchable_units", "select o_orderkey::varchar as unit_id from orders where o_orderkey % 2 = 0 and o_custkey in (5, 7, 10, 11)")
def searchable_units(spark, d):
    units = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("unit_id"), F.col("o_custkey").cast("string").alias("document_id"), (F.col("o_orderkey") % 2 == 0).alias("visible"))
    return S.searchable(units, documents=["5", "7", "10", "11"]).select("unit_id")


@query("newest_row", "select event_id, ts from events where user_id = 3 order by ts desc, event_id desc limit 1")
def newest_row(spark, d):
    return R.newest(table(spark, d, "events"), "user_id", 3, "ts", "event_id").select("event_id", "ts")


@query("ordered_distinct", "select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1")
def ordered_distinct(spark, d):
    return R.ordered_distinct(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("lists_in_order", "select 0 as family, n_name as name from nation union all select 1, r_name from region")
def lists_in_order(spark, d):
    return R.concatenated(table(spark, d, "nation").select(F.col("n_name").alias("name")), table(spark, d, "region").select(F.col("r_name").alias("name"))).select("family", "name")


# Sources of answers ---------------------------------------------------------------------------------------------------

_SOURCES = """s as (select conv_id, turn, 'c' || conv_id || '-' || turn as unit_id, case when turn % 3 = 1 then 'figure' when turn % 3 = 2 then 'table' else 'text' end as unit_type, text from conversations)"""


def _sources(spark, d):
    """Turns of conversations as judged units with one element each."""
    c = table(spark, d, "conversations")
    t = F.col("turn")
    unit = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    kind = F.when(t % 3 == 1, "figure").when(t % 3 == 2, "table").otherwise("text")
    judged = c.select(F.col("conv_id").alias("question_id"), unit.alias("unit_id"), F.col("conv_id").cast("string").alias("document_id"), kind.alias("unit_type"), "text", F.array("role").alias("heading_path"), F.array(t.cast("int")).alias("pages"), F.array(unit).alias("element_ids"), F.array().cast("array<string>").alias("figure_ids"), (t + 1).cast("int").alias("rank"), F.lit(0.5).alias("relevance"), F.lit(0.5).alias("similarity"), F.when(t % 2 == 0, (t + 1).cast("int")).alias("citation_number"))
    known = {"id": unit, "document_id": F.col("conv_id").cast("string"), "kind": F.when(kind == "figure", "image").when(kind == "table", "table").otherwise("paragraph"), "page": t.cast("int"), "reading_order": t.cast("int"), "origin": F.when(t % 5 == 0, "recognized").otherwise("text_layer"), "confidence": F.when(t % 5 == 0, 0.5), "table_rows": F.when(kind == "table", F.array(F.array("role"))), "description_status": F.when((kind == "figure") & (t % 2 == 0), "described"), "is_decorative": F.lit(False), "unverified_identifiers": F.array(F.lit("X-1"))}
    fields = [f.split(" ", 1) for f in schemas.ELEMENTS.replace(", ", "\n").split("\n")]
    elements = c.select(*(known.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields))
    names = c.select(F.col("conv_id").cast("string").alias("document_id")).distinct().withColumn("document_name", F.concat(F.lit("doc"), "document_id"))
    return judged, elements, names


@query(
    "answer_sources",
    f"""with {_SOURCES} select unit_id, 'doc' || conv_id as document_name, substr(text, 1, 300) as excerpt, unit_type as content_type, turn % 5 = 0 as low_confidence_text, unit_type = 'figure' and turn % 2 = 0 as generated_description,
    case when unit_type = 'figure' and turn % 2 = 0 then 'X-1' else '' end as unverified, case when unit_type = 'table' then 1 end as tables, case when unit_type = 'figure' then 1 else 0 end as figures, turn % 2 = 1 as uncited from s""",
)
def answer_sources(spark, d):
    got = A.sources(*_sources(spark, d))
    tables = F.when(F.col("tables").isNotNull(), F.size("tables"))
    return got.select("unit_id", "document_name", "excerpt", "content_type", "low_confidence_text", "generated_description", F.array_join("unverified_identifiers", ",").alias("unverified"), tables.alias("tables"), F.size("figure_ids").alias("figures"), F.col("citation_number").isNull().alias("uncited"))


@query("uncited_sources", f"with {_SOURCES} select unit_id from s where turn % 2 = 1")
def uncited_sources(spark, d):
    return A.uncited(A.sources(*_sources(spark, d))).select("unit_id")


@query("sources_of_citations", f"with {_SOURCES} select conv_id as question_id, (turn + 1)::int as number, unit_id from s where turn % 2 = 0")
def sources_of_citations(spark, d):
    found = A.sources(*_sources(spark, d))
    citations = found.where("citation_number is not null").select("question_id", F.col("citation_number").alias("number"), F.array("unit_id").alias("unit_ids"))
    return A.sources_of_citation(found, citations).select("question_id", "number", "unit_id")


@query(
    "answer_outcomes",
    "select doc_id, case when doc_id % 5 = 0 then 'no_searchable_documents' when doc_id % 5 = 1 then 'no_relevant_content' when doc_id % 5 = 2 then 'not_answered_by_sources' when doc_id % 5 = 3 then 'no_valid_citations' end as reason from documents",
)
def answer_outcomes(spark, d):
    i = F.col("doc_id") % 5
    docs = table(spark, d, "documents")
    return docs.select("doc_id", A.outcome(i > 0, i > 1, F.when(i == 2, " ").otherwise("yes"), F.when(i == 4, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).alias("reason"))


@query("missing_crops", "select p_partkey from part where p_partkey % 3 = 0")
def missing_crops(spark, d):
    p = table(spark, d, "part").withColumn("image_key", F.concat(F.lit("k"), F.col("p_partkey").cast("string")))
    return A.missing_crops(p, p.where("p_partkey % 3 <> 0").select("image_key")).select("p_partkey")


@query("description_context", f"with {ELEMENTS} select i.document_id, i.id as image_id, c.line as caption from e i join e c on c.document_id = i.document_id and c.n = i.n + 1 and c.kind = 'caption' where i.kind = 'image' and c.line <> ''")
def description_context(spark, d):
    e = L.line_elements(table(spark, d, "documents"))
    links = Y.caption_links(e, L.no_links(e))
    return Y.description_context(e, links).select("document_id", "image_id", "caption")


@query(
    "contested_captions",
    """with l as (select l_orderkey::varchar as document_id, l_linenumber as n, l_linenumber % 2 = 1 as image, l_quantity as y from (select l_orderkey, l_linenumber, min(l_quantity) as l_quantity from lineitem group by all)), i as (select * from l where image), c as (select * from l where not image),
    f as (select document_id, min(n) as n from c group by 1)
    select c.document_id, c.n::int as caption, arg_min(i.n, (greatest(0, greatest(c.y, i.y) - least(c.y, i.y) - 1), i.n))::int as image from c join f using (document_id, n) join i on i.document_id = c.document_id and greatest(0, greatest(c.y, i.y) - least(c.y, i.y) - 1) <= 10 group by all""",
)
def contested_captions(spark, d):
    """Several captions and images on one page: the first caption in reading order takes the closest image within ten points."""
    i = _order_lines(spark, d, "l_quantity")
    n, y = F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("double")
    e = i.select(F.col("l_orderkey").cast("string").alias("document_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), n.cast("string")).alias("id"), F.when(n % 2 == 1, "image").otherwise("caption").alias("kind"), F.lit(1).alias("page"), n.alias("reading_order"), F.lit(0.0).alias("bbox_left"), F.lit(9.0).alias("bbox_right"), y.alias("bbox_top"), (y + 1).alias("bbox_bottom"))
    links = Y.caption_links(e, L.no_links(e), 10.0)
    number = lambda c: F.split(c, ":")[1].cast("int")
    firsts = e.where("kind = 'caption'").groupBy("document_id").agg(F.min("reading_order").alias("caption"))
    return links.select("document_id", number("source_id").alias("caption"), number("target_id").alias("image")).join(firsts, ["document_id", "caption"])


@query("edges_of_elements", "with e as (select distinct 'c' || o_custkey as c, 'o' || o_orderkey as o from orders) select c_custkey, coalesce(string_agg(o, ',' order by o), '') as edges from customer left join e on c = 'c' || c_custkey group by 1")
def edges_of_elements(spark, d):
    edges = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("target_id"), F.lit("near").alias("kind"), F.lit(1.0).alias("score"))
    elements = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return R.nest_edges(elements, edges).select("c_custkey", F.array_join(F.transform("edges", lambda x: x["target_id"]), ",").alias("edges"))


# Store and ingestion --------------------------------------------------------------------------------------------------


@query("published_rows", "select c_custkey::varchar as document_id, 'v' || case when c_custkey % 2 = 0 then 2 else 1 end as text from customer where c_custkey % 5 <> 0 union all select c_custkey::varchar, 'v1' from customer where c_custkey % 10 = 5 and c_custkey % 15 <> 0")
def published_rows(spark, d):
    """Two generations of rows, the second published for some documents only; deleted and hidden ones do not show, compaction
    changes nothing that can be read."""
    store = Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex[:8]}", buckets=4)
    store.create("units", "id string, document_id string, text string")
    docs = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), F.col("c_custkey").alias("k"))
    rows = lambda v: docs.select(F.concat("document_id", F.lit(f":{v}")).alias("id"), "document_id", F.lit(f"v{v}").alias("text"))
    store.write("units", rows(1), 1)
    store.publish(docs, 1)
    store.write("units", rows(2), 2)
    store.write("units", rows(2), 2)  # again: no row twice
    store.publish(docs.where("k % 2 = 0"), 2)
    store.unpublish(docs.where("k % 10 = 0"))
    store.delete_documents(docs.where("k % 15 = 0"))
    store.compact("units")
    return store.read("units").select("document_id", "text")


@query(
    "ingested_pages",
    r"""with m as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?is)<nav\b.*?</nav\s*>', '<footer>nav</footer>', 'g') as h from pages),
    b as (select page_id, list_filter(string_split(regexp_replace(h, '{tag}', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_matches(x, '(?i)^<(?:{kinds})\b')) as bs from m),
    t as (select page_id, unnest(bs) as b from b),
    u as (select page_id, lower(regexp_extract(b, '^<([A-Za-z0-9]+)', 1)) as tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as text from t),
    k as (select page_id, count(*) filter (text <> '' and tag <> 'footer') as n, count(*) filter (text <> '' and tag ~ '^h[1-6]$') as headings from u group by 1)
    select p.page_id::varchar as document_id, case when coalesce(n, 0) > 0 then 'completed' else 'failed' end as status, case when coalesce(n, 0) = 0 then 'no_extractable_text' end as failure_code, nullif(coalesce(n, 0), 0) as text_elements, case when n > 0 then headings end as headings from pages p left join k using (page_id)""".replace("{tag}", L.BLOCK_TAG).replace("{kinds}", L.KINDS),
)
def ingested_pages(spark, d):
    """Web pages all the way: items, elements, links, units, vectors, hidden store, publishing; then what a reader sees."""
    pages = table(spark, d, "pages")
    blocks = L.web_elements(pages)
    labels = F.create_map(*[F.lit(x) for kv in (("heading", "section_header"), ("list_item", "list_item"), ("caption", "caption"), ("page_furniture", "page_footer"), ("paragraph", "text")) for x in kv])
    top = (F.col("reading_order") * 20).cast("double")
    box = F.struct(F.lit(72.0).alias("left"), top.alias("top"), F.lit(540.0).alias("right"), (top + 15).alias("bottom"))
    items = blocks.select("document_id", F.concat(F.lit("i"), F.col("reading_order").cast("string")).alias("item"), F.lit(None).cast("string").alias("parent"), labels[F.col("kind")].alias("label"), "text", F.lit(1).alias("page"), box.alias("box"), F.col("reading_order").alias("position"), F.lit(None).cast("string").alias("caption_of"), F.lit(None).cast(f"array<struct<page:int,box:{It.BOX},start:int,end:int>>").alias("spans"), F.lit(None).cast("string").alias("error"))
    documents = pages.select(F.col("page_id").cast("string").alias("id"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"), F.col("url").alias("file_name"))
    store = Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex[:8]}", buckets=8)
    outcome = N.ingest(store, documents, items, 1)
    seen = store.read("elements").groupBy(F.col("document_id").alias("_d")).agg(F.count_if(F.col("kind") == "heading").alias("headings"))
    return outcome.join(seen, F.col("document_id") == F.col("_d"), "left").select("document_id", "status", "failure_code", F.col("summary.text_elements").alias("text_elements"), F.when(F.col("status") == "completed", F.col("headings")).alias("headings"))
