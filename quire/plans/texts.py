"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import ids as I
from quire.functions import text as T
from quire.plans.library import table
from quire.plans.registry import query
from quire.sources import lines as L
from quire.sources import models as M

#: The same folding in SQL.
FOLD = f"translate(lower({{0}}), '{T.ACCENTED}', '{T.PLAIN}')"


@query(
    "distinct_folded_text",
    f"select trim(regexp_replace({FOLD.format('text')}, '\\s+', ' ', 'g')) as folded, min(doc_id) as doc_id, count(*) as copies from documents group by 1",
)
def distinct_folded_text(spark, d):
    key = T.collapse(T.fold_latin(F.col("text")))
    return table(spark, d, "documents").groupBy(key.alias("folded")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "split_sentences",
    """with s as (select doc_id, list_filter(string_split(regexp_replace(trim(text, ' ' || chr(10) || chr(9) || chr(13)), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as s from documents)
    select doc_id, len(s) as sentences, s[1] as first, list_max(list_transform(s, lambda x: length(x))) as longest from s""",
)
def split_sentences(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.get("s", F.lit(0)).alias("first"), F.array_max(F.transform("s", F.length)).alias("longest"))


@query(
    "identifier_tokens",
    rf"""select doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({FOLD.format('text')}, '[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}_./-]*[\p{{L}}\p{{N}}])?'), lambda t: length(t) >= 3 and regexp_matches(t, '[0-9]')))), ' ') as ids from documents""",
)
def identifier_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.question_identifiers(T.fold_latin(F.col("text")))), " ").alias("ids"))


@query(
    "word_sets",
    rf"""select doc_id, len(list_distinct(list_filter(regexp_extract_all({FOLD.format('text')}, '[\p{{L}}\p{{N}}_-]+'), lambda w: length(w) >= 3))) as words from documents""",
)
def word_sets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.word_set(T.fold_latin(F.col("text")))).alias("words"))


@query(
    "exact_folding",
    # the documents hold Latin letters only, for which SQL has what folding does
    "select doc_id, sha256(encode(strip_accents(replace(lower(text), 'ß', 'ss')))) as folded from documents",
)
def exact_folding(spark, d):
    """Unicode case folding and compatibility decomposition; a test holds every character against Unicode's tables."""
    return table(spark, d, "documents").select("doc_id", F.sha2(T.fold(F.col("text")).cast("binary"), 256).alias("folded"))


@query(
    "stable_ids",
    """with d as (select doc_id, sha1(unhex('%s') || encode('unit:' || sha256(text) || ':text:' || doc_id)) as h from documents)
    select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', strpos('0123456789abcdef', substr(h, 17, 1))::int %% 4 + case when strpos('0123456789abcdef', substr(h, 17, 1)) %% 4 = 0 then 4 else 0 end, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as id from d"""
    % I.NAMESPACE.hex,
)
def stable_ids(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", I.unit_id(I.fingerprint(F.col("text")), F.concat(F.lit("text:"), F.col("doc_id").cast("string"))).alias("id"))


@query(
    "storage_keys",
    "select doc_id, 'documents/' || sha256(text) || '.pdf' as document, 'pages/' || doc_id || '/3.png' as page, true as safe from documents",
)
def storage_keys(spark, d):
    docs = table(spark, d, "documents").select("doc_id", I.document_blob_key(I.fingerprint(F.col("text"))).alias("document"), I.page_blob_key(F.col("doc_id").cast("string"), F.lit(3)).alias("page"))
    return docs.withColumn("safe", I.is_safe_key(F.col("document")) & I.is_safe_key(F.col("page")))


@query(
    "base_names",
    r"select page_id, case when length(n) between 1 and 255 then n end as name from (select page_id, trim(regexp_extract(url, '([^/\\]*)$', 1)) as n from pages)",
)
def base_names(spark, d):
    return table(spark, d, "pages").select("page_id", T.base_name(F.col("url")).alias("name"))


@query(
    "web_elements",
    r"""with m as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'), '(?is)<nav\b.*?</nav\s*>', '<footer>nav</footer>', 'g') as h from pages),
    b as (select page_id, list_filter(string_split(regexp_replace(h, '{tag}', chr(1) || '\1', 'g'), chr(1)), lambda x: regexp_matches(x, '(?i)^<(?:{kinds})\b')) as bs from m),
    t as (select page_id, unnest(bs) as b, generate_subscripts(bs, 1) as i from b),
    u as (select page_id, i, lower(regexp_extract(b, '^<([A-Za-z0-9]+)', 1)) as tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as text from t)
    select page_id::varchar as document_id, (row_number() over (partition by page_id order by i) - 1)::int as reading_order, case when tag ~ '^h[1-6]$' then 'heading' when tag = 'li' then 'list_item' when tag = 'figcaption' then 'caption' when tag = 'footer' then 'page_furniture' else 'paragraph' end as kind,
    case when tag ~ '^h[1-6]$' then substr(tag, 2, 1)::int end as heading_level, text from u where text <> ''""".replace("{tag}", L.BLOCK_TAG).replace("{kinds}", L.KINDS),
)
def web_elements(spark, d):
    return L.web_elements(table(spark, d, "pages"))


@query(
    "heading_titles",
    r"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as n, unnest(string_split(text, chr(10))) as line from documents), t as (select doc_id, n, line, (doc_id % 1200) || '.' || n || '. ' || line || ' :.' as title from l)
    select doc_id, n::int as n, case when doc_id % 1200 < 1000 then 2 end as level, rtrim(trim(regexp_replace(lower(title), '\s+', ' ', 'g')), ' .:') as key, regexp_matches(title, '(?i)\bcont(?:inu|\.)') as continued from t where line <> ''""",
)
def heading_titles(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("n", F.col("i") + 1).where("line <> ''")
    title = F.concat((F.col("doc_id") % 1200).cast("string"), F.lit("."), F.col("n").cast("string"), F.lit(". "), F.col("line"), F.lit(" :."))
    return lines.select("doc_id", "n", T.section_level(title).alias("level"), T.title_key(title).alias("key"), T.is_continued(title).alias("continued"))


@query(
    "unverified_identifiers",
    r"""with b as (select doc_id, lower(coalesce(source, '') || ' ' || substr(text, 1, 400)) as known, regexp_extract_all(text, '[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*') as t from documents)
    select doc_id, array_to_string(list_sort(list_distinct(list_filter(t, lambda x: regexp_matches(x, '[0-9]') and regexp_matches(x, '[A-Za-z-]') and not contains(known, lower(x))))), ' ') as ids from b""",
)
def unverified_identifiers(spark, d):
    """Texts as descriptions; the first 400 characters of each stand for its caption."""
    docs = table(spark, d, "documents")
    ids = T.unverified_identifiers(F.col("text"), F.array(F.coalesce("source", F.lit(""))), F.substring("text", 1, 400))
    return docs.select("doc_id", F.array_join(F.array_sort(ids), " ").alias("ids"))


@query(
    "citation_markers",
    r"""select conv_id, turn, text || ' [' || turn || '] [99]' as text, turn < 5 as known from conversations""",
)
def citation_markers(spark, d):
    c = table(spark, d, "conversations")
    text = F.concat(F.col("text"), F.lit(" ["), F.col("turn").cast("string"), F.lit("] [99]"))
    return c.select("conv_id", "turn", text.alias("text"), F.array_contains(T.known_markers(text, F.array(*(F.lit(i) for i in range(5)))), F.col("turn").cast("int")).alias("known"))


@query(
    "prompt_sources",
    r"""select doc_id, '<source id="1" document="' || source || '" pages="1, 2" section="' || lang || ' &gt; x">' || chr(10) || regexp_replace(text, '(?i)</(sources?|question)\b', '&lt;/\1', 'g') || chr(10) || '</source>' as block from documents""",
)
def prompt_sources(spark, d):
    block = T.source_block(F.lit(1), F.col("source"), F.array(F.lit(1), F.lit(2)), F.array("lang", F.lit("x")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", block.alias("block"))


@query(
    "source_labels",
    "select l_orderkey, l_linenumber, 'Source: part ' || l_partkey || ', page ' || l_linenumber as label from lineitem",
)
def source_labels(spark, d):
    i = table(spark, d, "lineitem")
    return i.select("l_orderkey", "l_linenumber", T.source_label(F.concat(F.lit("part "), F.col("l_partkey").cast("string")), F.array(F.col("l_linenumber").cast("int"))).alias("label"))


@query("token_counts_by_words", "select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) as words, length(regexp_extract(text, '^(?:\\s*\\S+){0,40}', 0)) as cut from documents")
def token_counts_by_words(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", T.count_words(F.col("text")).alias("words"), F.length(T.truncate_words(F.col("text"), 40)).alias("cut"))


_WORDS = {c: ", ".join(f"'{w}'" for w in dict.fromkeys(ws.split())) for c, ws in M.FUNCTION_WORDS.items()}


@query(
    "language_of_text",
    "with w as (select doc_id, regexp_split_to_array(lower(text), '[\\s,.;:!?]+') as w from documents), s as (select doc_id, "
    + ", ".join(f"len(list_filter(w, lambda x: x in ({_WORDS[c]}))) as {c}" for c in ("en", "es", "fr", "de"))
    + " from w) select doc_id, case when en >= greatest(es, fr, de) then 'en' when es >= greatest(fr, de) then 'es' when fr >= de then 'fr' else 'de' end as language from s",
)
def language_of_text(spark, d):
    return table(spark, d, "documents").select("doc_id", M.identify_language(F.col("text"), ("en", "es", "fr", "de")).alias("language"))


@query("fixed_messages", "select doc_id, case when lang = 'es' then '%s' else '%s' end as message from documents" % tuple(T.MESSAGES[c][1] for c in ("es", "en")))
def fixed_messages(spark, d):
    return table(spark, d, "documents").select("doc_id", T.message(F.lit("no_relevant_content"), F.col("lang")).alias("message"))
