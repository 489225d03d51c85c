"""Queries over search, judging, answering and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import vectors as V
from quire.operators import answering as A
from quire.operators import evaluation as E
from quire.operators import search as S
from quire.operators.text_index import TextIndex
from quire.operators.vector_index import VectorIndex
from quire.plans.library import table
from quire.plans.registry import query
from quire.plans.texts import FOLD
from quire.sources.scratch import exists, index_dir, materialize

_TERMS = rf"regexp_extract_all({FOLD}, '[\p{{{{L}}}}\p{{{{N}}}}]+')"
_BM25 = f"""
u as (select doc_id as unit_id, {_TERMS.format('coalesce(text, chr(32))')} as w from documents),
p as (select unit_id, len(w) as length, unnest(w) as term from u),
tf as (select unit_id, term, count(*) as tf, any_value(length) as length from p group by unit_id, term),
q as (select item_id as question_id, unnest(list_distinct({_TERMS.format('text')})) as term from benchmark),
df as (select term, count(*) as df from tf group by term),
st as (select count(*) as n, avg(len(w)) as average from u),
sc as (select question_id, unit_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))) as score from q join df using (term) join tf using (term), st group by question_id, unit_id)
"""


def _questions(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text")


def _units(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("unit_id"), F.coalesce("text", F.lit(" ")).alias("text"))


_indexes: dict[tuple[str, str, str], TextIndex | VectorIndex] = {}


def _stored(spark, d, name, build):
    """The stored index of a table's units: written once a session and table, beside the scratch tables, and read from then on."""
    place = index_dir(spark)
    key = (place, d.rstrip("/"), name)
    if key not in _indexes or _indexes[key].spark is not spark or not exists(spark, f"{_indexes[key].path}/schema"):
        _indexes[key] = build(f"{place}/{len(_indexes)}-{name}")
    return _indexes[key]


def _documents_index(spark, d):
    return _stored(spark, d, "documents", lambda path: TextIndex.build(_units(spark, d), path))


@query("text_index", f"with {_BM25} select st.n as units, round(average, 6) as average, (select count(*) from df) as terms, (select count(*) from tf) as postings from st")
def text_index(spark, d):
    """The stored full-text index of all documents: what the queries below read. Built here unless it is there."""
    index = _documents_index(spark, d)
    counted = index.terms.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return counted.select(F.lit(index.units).alias("units"), F.round(F.lit(index.average), 6).alias("average"), "terms", "postings")


@query("bm25_topk", f"with {_BM25} select question_id, unit_id, round(score, 6) as score, row_number() over (partition by question_id order by round(score, 9) desc, unit_id)::int as pos from sc qualify pos <= 8")
def bm25_topk(spark, d):
    return _documents_index(spark, d).top(_questions(spark, d), S.TOP_K).withColumn("score", F.round("score", 6))


@query("document_frequency", f"with {_BM25} select term, df from df")
def document_frequency(spark, d):
    return _documents_index(spark, d).terms.select("term", "df")


_DENSE = """
v as (select vec_id, embedding::double[] as x from embeddings),
n as (select q.vec_id as question_id, u.vec_id as unit_id, list_cosine_similarity(q.x, u.x) as similarity from v q, v u where q.vec_id % 20 = 0)
"""


@query("dense_topk", f"with {_DENSE} select question_id, unit_id, round(similarity, 6) as similarity, row_number() over (partition by question_id order by round(similarity, 9) desc, unit_id)::int as pos from n qualify pos <= 8")
def dense_topk(spark, d):
    """Queries are the vectors whose id is divisible by 20, against all vectors."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("dense"))
    return S.dense_top(asked, v.select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("dense")), S.TOP_K).withColumn("similarity", F.round("similarity", 6))


@query("indexed_dense_topk", f"with {_DENSE} select question_id, unit_id, round(similarity, 6) as similarity, row_number() over (partition by question_id order by round(similarity, 9) desc, unit_id)::int as pos from n qualify pos <= 8")
def indexed_dense_topk(spark, d):
    """The same through the stored vector index, which leaves out clusters that can't hold a hit."""
    v = table(spark, d, "embeddings")
    index = _stored(spark, d, "vectors", lambda path: VectorIndex.build(v.select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("dense")), path))
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("dense"))
    return index.top(asked, S.TOP_K).withColumn("similarity", F.round("similarity", 6))


@query(
    "hybrid_rrf",
    f"""with {_BM25}, m as (select count(*) as m from embeddings), vu as (select unit_id, unit_id % m as vec_id from u, m), vq as (select item_id as question_id, item_id % m as vec_id from benchmark, m),
    s as materialized (select a.vec_id as q, b.vec_id as v, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as similarity from embeddings a, embeddings b where a.vec_id in (select vec_id from vq)),
    pv as materialized (select question_id, v, similarity from vq join s on s.q = vq.vec_id),
    a as materialized (select question_id, unit_id, row_number() over (partition by question_id order by round(similarity, 9) desc, unit_id) as pos from pv join vu on vu.vec_id = pv.v qualify pos <= 32),
    b as materialized (select question_id, unit_id, row_number() over (partition by question_id order by round(score, 9) desc, unit_id) as pos from sc qualify pos <= 32),
    f as (select question_id, unit_id, sum(1 / (60.0 + pos)) as score from (select * from a union all select * from b) group by all),
    t as materialized (select *, row_number() over (partition by question_id order by round(score, 12) desc, unit_id)::int as search_pos from f qualify search_pos <= 16)
    select t.question_id, t.unit_id, round(score, 9) as score, search_pos, round(similarity, 6) as similarity from t join vu using (unit_id) join pv on pv.question_id || ':' || pv.v = t.question_id || ':' || vu.vec_id""",
)
def hybrid_rrf(spark, d):
    """All documents against all benchmark passages. The tables have fewer vectors than documents, so those are given in turn."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("dense"))
    m = vectors.count()
    given = lambda rows, key: rows.withColumn("vec_id", F.col(key) % m).join(vectors, "vec_id").drop("vec_id")
    got = S.hybrid(given(_questions(spark, d), "question_id"), given(_units(spark, d), "unit_id"), 16, _documents_index(spark, d))
    return got.select("question_id", "unit_id", F.round("score", 9).alias("score"), "search_pos", F.round("similarity", 6).alias("similarity"))


@query(
    "distinct_hits",
    f"""with {_BM25}, h as (select question_id, unit_id, row_number() over (partition by question_id order by round(score, 9) desc, unit_id) as search_pos from sc qualify search_pos <= 32),
    k as (select question_id, unit_id, search_pos, trim(regexp_replace({FOLD.format('text')}, '\\s+', ' ', 'g')) as key from h join documents on doc_id = unit_id),
    f as (select * from k qualify row_number() over (partition by question_id, key order by search_pos) = 1)
    select question_id, unit_id, search_pos::int as search_pos from f qualify row_number() over (partition by question_id order by search_pos) <= 16""",
)
def distinct_hits(spark, d):
    units = _units(spark, d)
    hits = materialize(_documents_index(spark, d).top(_questions(spark, d), 32).withColumnRenamed("pos", "search_pos"), "hits")
    hits = hits.join(S.of_hits(hits, units), "unit_id")
    return S.distinct_hits(hits, key=T.collapse(T.fold_latin(F.col("text")))).select("question_id", "unit_id", "search_pos")


_JUDGED = "j as (select lang as question_id, doc_id as unit_id, doc_id as search_pos, (n_chars % 97) / 96.0 as relevance, coalesce(toxic = 1, false) as pinned from documents left join labels using (doc_id))"


def _judged(spark, d):
    """Every document as a hit of its language, in the order of the ids."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return docs.select(F.col("lang").alias("question_id"), F.col("doc_id").alias("unit_id"), F.col("doc_id").alias("search_pos"), ((F.col("n_chars") % 97) / F.lit(96.0)).alias("relevance"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("pinned"))


@query(
    "pinned_topk",
    f"""with {_JUDGED}, t as (select * from j qualify row_number() over (partition by question_id order by pinned desc, relevance desc, search_pos) <= 8)
    select question_id, unit_id, search_pos, round(relevance, 6) as relevance, pinned, row_number() over (partition by question_id order by relevance desc, search_pos)::int as rank from t""",
)
def pinned_topk(spark, d):
    return S.pinned_top(_judged(spark, d)).withColumn("relevance", F.round("relevance", 6))


@query("relevance_gate", f"with {_JUDGED} select question_id, bool_or(relevance >= 0.995 or pinned and unit_id % 7 = 0) as passes, round(max(relevance), 6) as top_relevance from j group by 1")
def relevance_gate(spark, d):
    judged = _judged(spark, d).withColumn("pinned", F.col("pinned") & (F.col("unit_id") % 7 == 0))
    return S.gate(judged, 0.995).withColumn("top_relevance", F.round("top_relevance", 6))


@query(
    "identifier_holders",
    rf"""with d as (select doc_id, unnest(list_distinct(regexp_extract_all({FOLD.format('text')}, '[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}_./-]*[\p{{L}}\p{{N}}])?'))) as t from documents)
    select t as identifier, doc_id from d where length(t) >= 3 and regexp_matches(t, '[0-9]')""",
)
def identifier_holders(spark, d):
    """Every identifier of the documents is asked for: the documents that hold it as a whole token. An equi-join on tokens
    finds the pairs, the rule of pinning decides on them."""
    folded = table(spark, d, "documents").select("doc_id", T.fold_latin(F.col("text")).alias("text"))
    asked = folded.select(F.explode(T.question_identifiers(F.col("text"))).alias("identifier")).distinct().withColumn("question", F.concat(F.lit("where is "), "identifier", F.lit("?")))
    held = folded.select("doc_id", F.explode(T.identifier_tokens(F.col("text"))).alias("identifier"))
    found = asked.join(held, "identifier")
    return found.where(S.holds_identifier(F.col("identifier"), F.col("question"))).select("identifier", "doc_id")


@query("logprob_relevance", "select event_id, round(case when event_id % 5 = 0 then 1 else exp(-value / 100) / (exp(-value / 100) + exp(-0.7)) end, 9) as relevance from events")
def logprob_relevance(spark, d):
    e = table(spark, d, "events")
    no = F.when(F.col("event_id") % 5 != 0, F.lit(-0.7))
    return e.select("event_id", F.round(V.relevance_of_logprobs(-F.col("value") / 100, no), 9).alias("relevance"))


@query(
    "statement_attribution",
    rf"""with w as (select conv_id, turn, role, list_distinct(list_filter(regexp_extract_all({FOLD.format('text')}, '[\p{{L}}\p{{N}}_-]+'), lambda x: length(x) >= 3)) as w from conversations),
    s as (select a.conv_id, a.turn, u.turn as unit, case when len(a.w) = 0 then 0 else len(list_intersect(a.w, u.w)) / len(a.w) end as share from w a join w u on a.conv_id = u.conv_id where a.role = 'assistant' and u.role = 'user')
    select conv_id, turn, unit, round(share, 6) as share from s qualify row_number() over (partition by conv_id, turn order by share desc, unit) = 1""",
)
def statement_attribution(spark, d):
    """The user turn that each answer shares most words with; of equal shares the first turn."""
    c = table(spark, d, "conversations").withColumn("w", T.word_set(T.fold_latin(F.col("text"))))
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("w").alias("words"))
    u = c.where("role = 'user'").select("conv_id", F.col("turn").alias("unit"), F.col("w").alias("unit_words"))
    scored = a.join(u, "conv_id").withColumn("share", V.share(F.col("words"), F.col("unit_words")))
    best = scored.groupBy("conv_id", "turn").agg(F.max_by(F.struct("unit", "share"), F.struct("share", -F.col("unit"))).alias("b"))
    return best.select("conv_id", "turn", F.col("b.unit").alias("unit"), F.round("b.share", 6).alias("share"))


@query(
    "evaluation_shares",
    """with o as (select l.quality = 1 as answerable, n_chars < 900 as stopped, n_chars % 3 = 0 as answered, source = 'src1' as supplied, toxic = 1 as identifier from labels l join documents using (doc_id))
    select round(coalesce(avg((not stopped)::int) filter (answerable), 1), 6) as answerable_reaching_model, round(coalesce(avg(stopped::int) filter (not answerable), 1), 6) as unanswerable_stopped,
    round(coalesce(avg((not answered)::int) filter (not answerable), 1), 6) as unanswerable_not_answered, round(coalesce(avg(supplied::int) filter (identifier), 1), 6) as identifier_supplied from o""",
)
def evaluation_shares(spark, d):
    o = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(
        F.when(F.col("quality") == 1, "answerable").otherwise("unrelated").alias("label"),
        F.when(F.col("n_chars") < 900, "no_relevant_content").alias("reason"),
        F.when(F.col("n_chars") % 3 == 0, "answered").otherwise("not_enough_information").alias("status"),
        (F.col("source") == "src1").alias("supplied"),
        F.when(F.col("toxic") == 1, "x").alias("identifier"),
    )
    got = E.shares(o)
    return got.select(*(F.round(c, 6).alias(c) for c in got.columns))


@query("citations_resolved")
def citations_resolved(spark, d):
    """Answers with markers in several forms, resolved against the turns of their conversation."""
    c = table(spark, d, "conversations")
    supplied = c.select(F.col("conv_id").alias("question_id"), (F.col("turn") + 1).alias("rank"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("unit_id"), F.col("role").alias("document_id"), F.array((F.col("turn") % 2).cast("int")).alias("pages"))
    answers = c.groupBy(F.col("conv_id").alias("question_id")).agg(F.max_by("text", "turn").alias("answer")).withColumn("answer", F.concat("answer", F.lit(" [1-3] [[2]] 【1】 [9, 2].")))
    return A.cite(answers, supplied)


@query("answer_path")
def answer_path(spark, d):
    """The whole answer path over stand-in models: benchmark passages as questions, text lines as units."""
    from quire.sources import models as M

    lines = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("n", "text")).where("text <> ''")
    units = lines.select(F.concat_ws(":", "document_id", F.col("n").cast("string")).alias("unit_id"), "document_id", F.concat(F.lit("doc"), F.col("document_id")).alias("document_name"), "text", F.array().cast("array<string>").alias("heading_path"), F.array((F.col("n") + 1).cast("int")).alias("pages"), F.lit(True).alias("visible"))
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text", F.lit("en").alias("language"))
    # units get their vectors, and their index, once: when they are stored
    index = _stored(spark, d, "lines", lambda path: TextIndex.build(units, path))
    return A.answer_questions(questions, materialize(units.withColumn("dense", M.embed(F.col("text"))), "units"), text_index=index)
