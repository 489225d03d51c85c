"""Scores over vectors, ranks and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_WEIGHT, VECTOR_WEIGHT = 0.7, 0.3
#: Constants that an index server sets, chosen here: rank constant of the fusion, saturation and length weight of BM25.
RRF_K, BM25_K1, BM25_B = 60, 1.2, 0.75


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays, 0 where either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def share(words: Column, candidate: Column) -> Column:
    """Part of a set of words that another set holds."""
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, candidate)) / F.size(words)).otherwise(0.0)


def attribution_score(words: Column, candidate: Column, vector: Column, other: Column) -> Column:
    return WORD_WEIGHT * share(words, candidate) + VECTOR_WEIGHT * cosine(vector, other)


def relevance_of_logprobs(yes: Column, no: Column) -> Column:
    """Probability of "yes" against "no" from their log-probabilities; a missing one counts nothing, both missing fail."""
    a, b = F.coalesce(F.exp(yes), F.lit(0.0)), F.coalesce(F.exp(no), F.lit(0.0))
    return F.when(yes.isNull() & no.isNull(), F.raise_error(F.lit("the judge gave neither answer")).cast("double")).otherwise(a / (a + b))


def rrf(rank: Column, k: int = RRF_K) -> Column:
    return 1 / (F.lit(float(k)) + rank)


def idf(documents: Column, with_term: Column) -> Column:
    return F.log(1 + (documents - with_term + 0.5) / (with_term + 0.5))


def bm25(tf: Column, length: Column, average: Column, weight: Column, k1: float = BM25_K1, b: float = BM25_B) -> Column:
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))
