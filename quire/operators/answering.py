"""From ranked units to answers: sources, images, attribution, citations, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.functions import vectors as V
from quire.operators import relational as R
from quire.operators import search as S
from quire.sources import models as M
from quire.sources.scratch import materialize

ATTRIBUTION_MIN, LOW_CONFIDENCE = 0.5, 0.90


def members_of(judged: DataFrame, elements: DataFrame) -> DataFrame:
    """judged units with the structs of their elements, in order (`members`), and of their near figures (`near`)."""
    keyed = judged.withColumn("id", F.concat_ws("/", "question_id", "unit_id"))
    own = R.in_order(keyed, elements, "element_ids")
    near = R.in_order(keyed.select("id", "figure_ids"), elements, "figure_ids").select(F.col("id").alias("_id"), F.col("members").alias("near"))
    return own.join(near, own["id"] == near["_id"], "left").drop("_id", "id")


def _content_image(e: Column) -> Column:
    return (e["kind"] == "image") & ~F.coalesce(e["is_decorative"], F.lit(False))


def sources(judged: DataFrame, elements: DataFrame, names: DataFrame, low: float = LOW_CONFIDENCE) -> DataFrame:
    """judged(question_id, unit_id, document_id, unit_type, text, heading_path, pages, element_ids, figure_ids, rank, relevance,
    similarity, citation_number) -> one row per supplied unit with everything a reader needs to check it. A unit whose element
    or document is missing fails. names(document_id, document_name)."""
    d = members_of(judged, elements)
    n = names.select(F.col("document_id").alias("_doc"), "document_name")
    d = R.strict_join(d, n, "document_id", "_doc", "document").drop("_doc")
    described = F.get(F.filter("members", lambda e: e["description_status"] == "described"), F.lit(0))
    figure = F.col("unit_type") == "figure"
    return d.select(
        "question_id",
        "unit_id",
        "rank",
        "relevance",
        "similarity",
        "document_id",
        "document_name",
        F.col("heading_path").alias("section"),
        "pages",
        F.col("unit_type").alias("content_type"),
        F.substring("text", 1, T.EXCERPT).alias("excerpt"),
        "citation_number",
        F.coalesce(F.exists("members", lambda e: (e["origin"] == "recognized") & F.coalesce(e["confidence"] < low, F.lit(False))), F.lit(False)).alias("low_confidence_text"),
        F.coalesce(figure & described.isNotNull(), F.lit(False)).alias("generated_description"),
        F.when(figure & described.isNotNull(), F.coalesce(described["unverified_identifiers"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("unverified_identifiers"),
        F.when(F.col("unit_type") == "table", F.transform(F.filter("members", lambda e: e["table_rows"].isNotNull()), lambda e: F.struct(e["page"].alias("page"), e["table_rows"].alias("rows")))).alias("tables"),
        F.array_distinct(F.transform(F.filter(F.concat("members", F.coalesce("near", F.slice("members", 1, 0))), _content_image), lambda e: e["id"])).alias("figure_ids"),
    )


def images(cited: DataFrame, elements: DataFrame, links: DataFrame) -> DataFrame:
    """cited(question_id, unit_id, rank, unit_type, element_ids, figure_ids, boxes) -> the figures of the cited units in judged
    order, within a unit the closest first, each figure once; the first of a question is its primary image."""
    figure = F.col("unit_type") == "figure"
    candidates = F.concat(F.when(figure, F.col("element_ids")).otherwise(F.array().cast("array<string>")), F.col("figure_ids"))
    at = cited.select("question_id", "unit_id", "rank", "boxes", "element_ids", F.posexplode(candidates).alias("place", "figure_id"))
    e = elements.select(F.col("id").alias("_e"), "document_id", "kind", "is_decorative", "image_key", "page", G.box(*(F.col(f"bbox_{s}") for s in ("left", "top", "right", "bottom"))).alias("box"))
    got = R.strict_join(at, e, "figure_id", "_e", "figure").where("kind = 'image' and not coalesce(is_decorative, false) and image_key is not null")
    here = F.filter("boxes", lambda b: b["page"] == F.col("page"))
    gaps = F.transform(here, lambda b: G.gap(b, F.col("box")))
    own = F.array_contains("element_ids", F.col("figure_id"))
    got = got.withColumn("off_page", ~own & (F.size(here) == 0)).withColumn("gap", F.when(own, F.lit(0.0)).otherwise(F.array_min(gaps)))
    order = [F.col("rank"), F.col("off_page"), F.coalesce("gap", F.lit(float("inf"))), F.col("place")]
    first = got.withColumn("_n", F.row_number().over(W.partitionBy("question_id", "figure_id").orderBy(*order))).where("_n = 1")
    # the last caption of a figure, by reading order of its text
    words = elements.select(F.col("id").alias("source_id"), "text", "reading_order")
    caption = links.where("kind = 'caption_of'").select("source_id", F.col("target_id").alias("figure_id")).join(words, "source_id").groupBy("figure_id").agg(F.max_by("text", "reading_order").alias("caption"))
    placed = first.join(caption, "figure_id", "left").withColumn("position", F.row_number().over(W.partitionBy("question_id").orderBy(*order)))
    return placed.select("question_id", "position", (F.col("position") == 1).alias("is_primary"), F.col("figure_id").alias("element_id"), "document_id", "page", "box", "caption", "unit_id", "image_key")


def attribute(answers: DataFrame, supplied: DataFrame, least: float = ATTRIBUTION_MIN, embed=M.embed) -> DataFrame:
    """answers(question_id, answer), supplied(question_id, rank, embedding_text) -> question_id, answer, attributed: each
    statement of an answer without markers gets the marker of the unit it shares most with, if that is enough."""
    bare = answers.where(~T.has_markers(F.col("answer")))
    s = bare.select("question_id", F.posexplode(T.find_statements(F.col("answer"))).alias("nth", "s")).select("question_id", "nth", "s.text", "s.end")
    s = s.withColumn("words", T.word_set(T.fold(F.col("text")))).withColumn("vector", embed(F.col("text")))
    u = supplied.select("question_id", "rank", F.col("embedding_text").alias("unit_text")).withColumn("unit_words", T.word_set(T.fold(F.col("unit_text")))).withColumn("unit_vector", embed(F.col("unit_text")))
    scored = s.join(u, "question_id").withColumn("score", V.attribution_score(F.col("words"), F.col("unit_words"), F.col("vector"), F.col("unit_vector")))
    best = scored.groupBy("question_id", "nth").agg(F.max_by(F.struct("score", "end", "rank"), F.struct("score", -F.col("rank"))).alias("b")).where(F.col("b.score") >= least)
    marks = best.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(F.col("b.end").alias("end"), F.col("b.rank").alias("number")))).alias("marks"))
    out = answers.join(marks, "question_id", "left")
    return out.select("question_id", F.when(F.col("marks").isNotNull(), T.insert_markers(F.col("answer"), F.coalesce("marks", F.array().cast(marks.schema["marks"].dataType)))).otherwise(F.col("answer")).alias("answer"), F.coalesce(F.size("marks"), F.lit(0)).alias("attributed"))


def cite(answers: DataFrame, supplied: DataFrame) -> DataFrame:
    """answers(question_id, answer), supplied(question_id, rank, unit_id, document_id, pages) -> text with valid markers and
    its citations."""
    lists = supplied.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.struct("unit_id", "document_id", "pages").alias("s")))), lambda x: x["s"]).alias("_sources"))
    joined = answers.join(lists, "question_id", "left").withColumn("cited", T.resolve_citations(F.col("answer"), F.col("_sources")))
    return joined.select("question_id", F.col("cited.text").alias("text"), F.col("cited.citations").alias("citations"))


def citation_numbers(cited: DataFrame) -> DataFrame:
    """question_id, unit_id, citation_number of every cited unit."""
    c = cited.select("question_id", F.explode("citations").alias("c"))
    return c.select("question_id", F.explode("c.unit_ids").alias("unit_id"), F.col("c.number").alias("citation_number"))


def outcome(found: Column, passes: Column, answer: Column, citations: Column) -> Column:
    """Why a question has no answer, null if it has one."""
    return (
        F.when(~F.coalesce(found, F.lit(False)), "no_searchable_documents")
        .when(~F.coalesce(passes, F.lit(False)), "no_relevant_content")
        .when(F.coalesce(F.trim(answer), F.lit("")) == "", "not_answered_by_sources")
        .when(F.coalesce(F.size(citations), F.lit(0)) == 0, "no_valid_citations")
    )


def missing_crops(shown: DataFrame, crops: DataFrame) -> DataFrame:
    """Returned figures without a stored crop: any row is an inconsistency."""
    return shown.join(crops, "image_key", "left_anti")


def uncited(found: DataFrame) -> DataFrame:
    return found.where("citation_number is null")


def sources_of_citation(found: DataFrame, citations: DataFrame) -> DataFrame:
    """citations(question_id, number, unit_ids) with each of their sources."""
    c = citations.select("question_id", "number", F.explode("unit_ids").alias("unit_id"))
    return found.join(c, ["question_id", "unit_id"])


class InvalidQuestion(ValueError):
    """A question that can't be asked."""


def validated(text: str, documents: list[str] | None = None, most_chars: int = 2000, most_documents: int = 20) -> tuple[str, list[str] | None]:
    text = text.strip()
    if not 0 < len(text) <= most_chars:
        raise InvalidQuestion(f"a question has 1 to {most_chars} characters")
    if documents is not None and (not 0 < len(documents) <= most_documents or len(set(documents)) != len(documents)):
        raise InvalidQuestion(f"a question names 1 to {most_documents} distinct documents")
    return text, documents


def require_ready(documents: list[str], known: DataFrame, completed: DataFrame) -> None:
    """Fail if a named document is unknown or not processed yet."""
    have = {r.id for r in R.in_lookup(known.select("id"), documents).collect()}
    if lost := [d for d in documents if d not in have]:
        raise R.NotFound(f"documents {lost}")
    ready = {r.id for r in R.in_lookup(completed.select("id"), documents).collect()}
    if waiting := [d for d in documents if d not in ready]:
        raise InvalidQuestion(f"documents not ready: {waiting}")


def _arranged(rows: DataFrame, order: str, name: str) -> DataFrame:
    """question_id and the other columns of its rows as an array of structs, in order."""
    fields = [order, *(c for c in rows.columns if c not in ("question_id", order))]
    return rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: (a[order] - b[order]).cast("int")).alias(name))


class MissingCrop(RuntimeError):
    """A figure that an answer shows has no stored crop."""


def evidence(kept: DataFrame, cited: DataFrame, elements: DataFrame, links: DataFrame, names: DataFrame, crops: DataFrame | None = None) -> DataFrame:
    """question_id, sources, images: what each answer was made from, cited or not, and the figures of what it cites, the
    primary one first. With crops(image_key), a figure without a stored crop fails."""
    numbered = materialize(kept.join(citation_numbers(cited), ["question_id", "unit_id"], "left"), "numbered")
    shown = materialize(images(numbered.where("citation_number is not null"), elements, links), "shown")
    if crops is not None and (lost := [r.image_key for r in missing_crops(shown, crops).select("image_key").limit(5).collect()]):
        raise MissingCrop(", ".join(lost))
    return _arranged(sources(numbered.drop("document_name"), elements, names), "rank", "sources").join(_arranged(shown, "position", "images"), "question_id", "full")


def answer_questions(
    questions: DataFrame,
    units: DataFrame,
    documents: list[str] | None = None,
    candidates: int = S.CANDIDATES,
    top_k: int = S.TOP_K,
    least: float = S.MIN_RELEVANCE,
    judge=M.judge,
    generate=M.generate,
    embed=M.embed,
    embed_query=M.embed_query,
    elements: DataFrame | None = None,
    links: DataFrame | None = None,
    names: DataFrame | None = None,
    crops: DataFrame | None = None,
    text_index=None,
) -> DataFrame:
    """The whole answer path for a batch of questions (question_id, text, language): search, distinct, judge, pinned top-k,
    gate, prompt, generate, attribute, cite. One row per question: reason, message, text, citations, top_relevance; with
    elements, links and names(document_id, document_name) also its sources and images.

    text_index: a stored index of all visible units; a question about named documents ranks among these alone and reads their
    texts. units: the stored units (unit_id, document_id, document_name, text, heading_path, pages, dense, visible), with their
    vectors: these are made when units are stored, and here only questions and statements are embedded. What a model made is
    written once, so no call is repeated for a later step. The gate is a filter below the generator, so no model is asked for
    questions that it stops; those join again at the end."""
    q = materialize(questions.withColumn("dense", embed_query(F.col("text"))), "questions")
    open_units = S.searchable(units, documents=documents)
    found = materialize(S.hybrid(q, open_units, candidates * S.OVER_FETCH, text_index if documents is None else None), "found")
    body = S.of_hits(found, open_units.drop("dense")).withColumn("embedding_text", T.embedding_text(F.col("heading_path"), F.col("text")))
    hits = S.distinct_hits(found.join(body, "unit_id"), candidates)
    asked = hits.join(questions.select("question_id", F.col("text").alias("question")), "question_id")
    judged = asked.withColumn("relevance", judge(F.col("question"), F.col("embedding_text"))).withColumn("pinned", S.holds_identifier(T.fold(F.col("embedding_text")), T.fold(F.col("question"))))
    kept = materialize(S.pinned_top(materialize(judged, "judged"), top_k), "kept")
    gates = S.gate(kept, least)
    passed = kept.join(gates.where("passes").select("question_id"), "question_id", "left_semi")
    blocks = passed.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", T.source_block(F.col("rank"), F.col("document_name"), F.col("pages"), F.col("heading_path"), F.col("text")).alias("block")))), lambda x: x["block"]).alias("blocks"), F.first("question").alias("question"))
    replies = blocks.withColumn("reply", generate(T.prompt(F.col("blocks"), F.col("question")))).select("question_id", F.col("reply.answer").alias("answer"), F.col("reply.not_covered").alias("not_covered"))
    replies = materialize(replies, "replies")
    cited = materialize(cite(attribute(replies, passed, embed=embed).select("question_id", "answer"), passed), "cited")
    out = questions.join(gates, "question_id", "left").join(replies, "question_id", "left").join(cited.withColumnRenamed("text", "cited_text"), "question_id", "left")
    out = out.withColumn("reason", outcome(F.col("passes").isNotNull(), F.col("passes"), F.col("answer"), F.col("citations")))
    answered = F.col("reason").isNull()
    columns = [
        "question_id",
        F.when(answered, "answered").otherwise("not_enough_information").alias("status"),
        "reason",
        F.when(~answered, T.message(F.col("reason"), F.col("language"))).otherwise(F.col("cited_text")).alias("text"),
        F.when(answered, F.col("citations")).alias("citations"),
        "top_relevance",
        "not_covered",
    ]
    if elements is not None:
        out = out.join(evidence(passed, cited, elements, links, names, crops), "question_id", "left")
        columns += [F.when(answered, F.col(c)).alias(c) for c in ("sources", "images")]
    return out.select(*columns)


def ask(spark, text: str, units: DataFrame, known: DataFrame, completed: DataFrame, documents: list[str] | None = None, candidates: tuple[str, ...] = ("en", "es"), **how) -> DataFrame:
    """One question as a client asks it: validated, its documents ready, its language identified, answered."""
    text, documents = validated(text, documents)
    if documents is not None:
        require_ready(documents, known, completed)
    one = spark.createDataFrame([("q", text)], "question_id string, text string")
    return answer_questions(one.withColumn("language", M.identify_language(F.col("text"), candidates)), units, documents, **how)
