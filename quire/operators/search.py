"""Search over retrieval units: BM25, exact vector neighbours, rank fusion, distinct hits, pinned top-k, the relevance gate.
Questions are rows, so a whole set of questions is one plan.

Both rankings read the units where they lie: a set of questions of bounded size goes to the units, each task keeps the best k
of each question, and only these are exchanged. Larger sets of questions are cut into such blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import vectors as V
from quire.sources.scratch import materialize, sized_broadcast

TOP_K, CANDIDATES, OVER_FETCH, PREFETCH, MIN_RELEVANCE = 8, 16, 2, 2, 0.30
#: Questions that one pass over the units answers, and units of one matrix product.
BLOCK, CHUNK = 1024, 2048


def terms(text: Column) -> Column:
    """BM25 analysis: lower case, folded, words of letters and digits of any script, no stemming, no stop words."""
    return F.regexp_extract_all(T.fold_latin(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def counted(units: DataFrame, id: str = "unit_id", text: str = "text") -> DataFrame:
    """unit_id, length, runs (array<struct<term, tf>>): the words of each row sorted, then the lengths of their runs."""
    d = units.select(F.col(id).alias("unit_id"), F.sort_array(terms(F.col(text))).alias("words")).withColumn("length", F.size("words"))
    begins = F.filter(F.sequence(F.lit(0), F.col("length") - 1), lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1)))
    d = d.withColumn("begins", F.when(F.col("length") > 0, begins))
    run = lambda i, n: F.struct(F.get("words", i).alias("term"), (F.coalesce(F.get("begins", n + 1), F.col("length")) - i).cast("long").alias("tf"))
    return d.withColumn("runs", F.transform("begins", run)).select("unit_id", "length", "runs")


def postings(units: DataFrame, id: str = "unit_id", text: str = "text") -> DataFrame:
    """unit_id, term, tf, length: words are counted within their row, nothing is exchanged."""
    # an inner explode would have a filter on `runs` pushed below and its array computed anew for each of its elements
    return counted(units, id, text).select("unit_id", "length", F.explode_outer("runs").alias("r")).select("unit_id", "r.term", "r.tf", "length").where("term is not null")


def asked_terms(questions: DataFrame, question: str = "question_id") -> DataFrame:
    return questions.select(F.col(question).alias("question_id"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def bm25_scores(questions: DataFrame, units: DataFrame, question: str = "question_id", id: str = "unit_id") -> DataFrame:
    """questions(question_id, text), units(unit_id, text) -> question_id, unit_id, score of every pair that shares a term: for
    analyses of all pairs; bm25_top() ranks without making them."""
    asked = asked_terms(questions, question)
    found = postings(units, id).join(asked.select("term").distinct(), "term", "left_semi")
    n, average = _collection(units)
    weight = found.groupBy("term").agg(F.count("*").alias("df")).select("term", V.idf(F.lit(float(n)), F.col("df")).alias("idf"))
    scored = found.join(asked.join(weight, "term"), "term").withColumn("s", V.bm25(F.col("tf"), F.col("length"), F.lit(average), F.col("idf")))
    return scored.groupBy("question_id", "unit_id").agg(F.sum("s").alias("score"))


def _collection(units: DataFrame, text: str = "text") -> tuple[int, float]:
    """Units and their average length: two numbers of the whole collection, by a plain aggregation."""
    n, average = units.agg(F.count("*"), F.avg(F.size(terms(F.col(text))))).first()
    return n, average or 1.0


def top(rows: DataFrame, by: str, k: int, *order: Column, name: str = "pos") -> DataFrame:
    """The first k rows of each group; Spark keeps just k per group and task before the exchange."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col(name) <= k)


class Best:
    """The k best units of each question that a task has met, by rounded score and then id. Units come in chunks."""

    def __init__(self, questions: int, k: int, digits: int = 9):
        self.k, self.digits = k, digits
        self.scores = np.full((questions, k), -np.inf)
        self.ids = np.full((questions, k), None, object)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: questions x units, minus infinity where a unit is no hit."""
        floor = np.round(self.scores[:, -1], self.digits)
        rounded = np.round(scores, self.digits)
        for q in np.flatnonzero((rounded >= floor[:, None]).any(axis=1) & (rounded > -np.inf).any(axis=1)):
            at = np.flatnonzero((rounded[q] >= floor[q]) & (rounded[q] > -np.inf))
            if len(at) > 4 * self.k:  # all that ties with the k-th best stays
                edge = np.partition(rounded[q, at], -self.k)[-self.k]
                at = at[rounded[q, at] >= edge]
            held = self.scores[q] > -np.inf
            every, names = np.concatenate((self.scores[q, held], scores[q, at])), [*self.ids[q, held], *ids[at]]
            order = sorted(range(len(names)), key=lambda i: (-np.round(every[i], self.digits), names[i]))[: self.k]
            self.scores[q, : len(order)] = every[order]
            for n, i in enumerate(order):
                self.ids[q, n] = names[i]

    def batch(self, questions: list, schema: pa.Schema) -> pa.RecordBatch:
        q, n = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array([questions[i] for i in q], schema.field(0).type), pa.array(self.ids[q, n].tolist(), schema.field(1).type), pa.array(self.scores[q, n])], schema=schema)


def _ranked(questions: DataFrame, units: DataFrame, k: int, name: str, of_block, parts: DataFrame) -> DataFrame:
    """The k best units of each question, ranked. of_block: collected questions -> (prepare, score); score gives the scores of
    a chunk of units (a batch whose first column is the id). Blocks of questions are answered by a pass each."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = units.sparkSession
    kinds = f"question_id {questions.schema['question_id'].dataType.simpleString()}, unit_id {units.schema['unit_id'].dataType.simpleString()}, {name} double"
    schema = to_arrow_schema(spark.createDataFrame([], kinds).schema)
    out = None
    rows = questions.toLocalIterator()  # a block at a time on the driver
    while block := [r for _, r in zip(range(BLOCK), rows)]:
        ids = [r["question_id"] for r in block]
        score = of_block(block)

        def run(batches, ids=ids, score=score):
            best = Best(len(ids), k)
            for b in batches:
                for at in range(0, b.num_rows, CHUNK):
                    part = b.slice(at, CHUNK)
                    best.add(score(part), np.array(part.column(0).to_pylist(), object))
            yield best.batch(ids, schema)

        found = parts.mapInArrow(run, kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], kinds)
    return top(out, "question_id", k, F.round(name, 9).desc(), F.col("unit_id"))


def bm25_top(questions: DataFrame, units: DataFrame, k: int, question: str = "question_id", id: str = "unit_id", text: str = "text") -> DataFrame:
    """questions(question_id, text), units(unit_id, text) -> question_id, unit_id, score, pos. Two passes over the units: the
    statistics of the terms asked for, then the scores, each unit's against all questions at once where it lies."""
    asked = questions.select(F.col(question).alias("question_id"), F.array_distinct(terms(F.col("text"))).alias("terms"))
    units = units.select(F.col(id).alias("unit_id"), F.col(text).alias("text"))
    n, average = _collection(units)
    vocabulary = materialize(asked.select(F.explode("terms").alias("term")).distinct(), "asked-terms")
    held = postings(units).join(sized_broadcast(vocabulary), "term", "left_semi")
    weights = materialize(held.groupBy("term").agg(F.count("*").alias("df")).select("term", V.idf(F.lit(float(n)), F.col("df")).alias("idf")), "weights")
    weighed = asked.select("question_id", F.explode("terms").alias("term")).join(weights, "term").groupBy("question_id").agg(F.collect_list(F.struct("term", "idf")).alias("terms"))
    weighed = materialize(weighed, "weighed")
    def of_block(block):
        rows: dict[str, list[int]] = {}
        idf: dict[str, float] = {}
        for i, r in enumerate(block):
            for t in r["terms"]:
                rows.setdefault(t["term"], []).append(i)
                idf[t["term"]] = t["idf"]
        number = {t: i for i, t in enumerate(rows)}

        def score(b: pa.RecordBatch) -> np.ndarray:
            lengths, lists = b.column(1).to_numpy(), b.column(2)
            entries, counts = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
            words, tf = entries.field(0).to_pylist(), entries.field(1).to_numpy()
            known = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
            unit = np.repeat(np.arange(len(b)), counts)[known >= 0]
            tf, known = tf[known >= 0].astype(np.float64), known[known >= 0]
            weight = np.array([idf[t] for t in number])[known] if len(known) else np.zeros(0)
            part = V.bm25(tf, lengths[unit], average, weight)
            out = np.zeros((len(block), len(b)))
            hit = np.zeros(out.shape, bool)
            order = np.argsort(known, kind="stable")
            names = list(number)
            for run in np.split(order, np.flatnonzero(np.diff(known[order])) + 1) if len(order) else []:
                asking = rows[names[known[run[0]]]]
                out[np.ix_(asking, unit[run])] += part[run]
                hit[np.ix_(asking, unit[run])] = True
            return np.where(hit, out, -np.inf)

        return score

    return _ranked(weighed, units, k, "score", of_block, counted(units))


def dense_top(questions: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """questions(question_id, dense), units(unit_id, dense) -> question_id, unit_id, similarity, pos: the k most similar
    units by exact cosine. A unit without a vector is no hit."""

    def of_block(block):
        a = np.array([r["dense"] for r in block], np.float64)
        na = np.linalg.norm(a, axis=1)

        def score(b: pa.RecordBatch) -> np.ndarray:
            vectors = b.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), -1)
            scale = na[:, None] * np.linalg.norm(flat, axis=1)
            return np.divide(a @ flat.T, scale, out=np.zeros((len(a), len(flat))), where=scale > 0)

        return score

    known = units.where("dense is not null").select("unit_id", "dense")
    return _ranked(questions.where("dense is not null").select("question_id", "dense"), units, k, "similarity", of_block, known)


def fused(lists: list[DataFrame], k: int, rank_constant: int = V.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (question_id, unit_id, pos): a union and a sum."""
    every = None
    for x in lists:
        x = x.select("question_id", "unit_id", V.rrf(F.col("pos"), rank_constant).alias("part"))
        every = x if every is None else every.unionByName(x)
    scored = every.groupBy("question_id", "unit_id").agg(F.sum("part").alias("score"))
    return top(scored, "question_id", k, F.round("score", 12).desc(), F.col("unit_id"), name="search_pos")


def searchable(units: DataFrame, published: DataFrame | None = None, documents: list[str] | None = None) -> DataFrame:
    """Units that a question may see: of published (or visible) documents and, if given, of these documents only. Applied
    before either ranking, since a filter behind it would change the ranks."""
    units = units.join(published.select("document_id").distinct(), "document_id", "left_semi") if published is not None else units.where("visible")
    return units.where(F.col("document_id").isin(documents)) if documents is not None else units


def of_hits(hits: DataFrame, units: DataFrame) -> DataFrame:
    """The units that are hits. hits: a written table, so few ids go to the units and the others stay where they are."""
    ids = materialize(hits.select("unit_id").distinct(), "hit-ids")
    return units.join(sized_broadcast(ids), "unit_id", "left_semi")


def with_similarity(hits: DataFrame, questions: DataFrame, units: DataFrame) -> DataFrame:
    """Hits (a written table) with the exact cosine of question and unit; a hit without a stored vector fails."""
    q = questions.select("question_id", F.col("dense").alias("_q"))
    u = of_hits(hits, units.select("unit_id", "dense")).select(F.col("unit_id").alias("_unit"), F.col("dense").alias("_u"))
    joined = hits.join(q, "question_id").join(u, F.col("unit_id") == F.col("_unit"), "left").drop("_unit")
    known = F.coalesce(F.col("_u"), F.raise_error(F.lit("a hit has no vector")).cast("array<float>"))
    return joined.withColumn("similarity", V.cosine(F.col("_q"), known)).drop("_q", "_u")


def hybrid(questions: DataFrame, units: DataFrame, limit: int = CANDIDATES * OVER_FETCH, text_index=None) -> DataFrame:
    """questions(question_id, text, dense), units(unit_id, text, dense): both sides to twice the limit, fused, rescored.
    text_index: the stored index of just these units (text_index.TextIndex); without it their texts are read."""
    words = text_index.top(questions, PREFETCH * limit) if text_index is not None else bm25_top(questions, units, PREFETCH * limit)
    sides = [dense_top(questions, units, PREFETCH * limit), words]
    return with_similarity(materialize(fused(sides, limit), "hits"), questions, units)


def distinct_hits(hits: DataFrame, limit: int = CANDIDATES, text: str = "text", rank: str = "search_pos", key: Column | None = None) -> DataFrame:
    """The best ranked hit of each distinct text (but for case, accents and spacing), the first `limit` of each question."""
    keyed = hits.withColumn("_key", key if key is not None else T.collapse(T.fold(F.col(text))))
    best = keyed.groupBy(F.col("question_id").alias("_question"), "_key").agg(F.min_by(F.struct(*hits.columns), F.col(rank)).alias("_row")).select("_row.*")
    return top(best, "question_id", limit, F.col(rank), name="_n").drop("_n")


def holds_identifier(unit_text: Column, question_text: Column) -> Column:
    """Whether a unit holds an identifier of the question as a whole token; both texts folded."""
    return F.arrays_overlap(T.identifier_tokens(unit_text), T.question_identifiers(question_text))


def pinned_top(judged: DataFrame, limit: int = TOP_K) -> DataFrame:
    """judged(question_id, unit_id, search_pos, relevance, pinned): pinned hits are kept first, then the most relevant; in
    the order of relevance, search order breaking ties."""
    best = [F.col("relevance").desc(), F.col("search_pos")]
    kept = top(judged, "question_id", limit, F.col("pinned").desc(), *best, name="_n").drop("_n")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("question_id").orderBy(*best)))


def gate(judged: DataFrame, least: float = MIN_RELEVANCE) -> DataFrame:
    """question_id, passes, top_relevance: any hit relevant enough, or any that holds an identifier."""
    return judged.groupBy("question_id").agg(F.bool_or((F.col("relevance") >= least) | F.col("pinned")).alias("passes"), F.max("relevance").alias("top_relevance"))
