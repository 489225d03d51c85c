"""A training corpus from raw documents: classify, deduplicate, mask, mix, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder
and reads it again for the next stage. All stages but the last return the columns of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.classifier import keep_good
from quire.llm.common import materialize, table
from quire.llm.mixing import mix
from quire.llm.packing import pack
from quire.llm.pii import mask_pii
from quire.llm.simhash import drop_near_duplicates


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones that are not held out, rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, is masked."""
    return mask_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is repeated or thinned to its target share; copies are rows of their own."""
    return mix(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are packed into sequences of 4096."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("pii", pii),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL can express neither the trained classifier nor the tokenizer; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
