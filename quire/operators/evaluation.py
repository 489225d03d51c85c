"""Summaries of evaluation and load runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.schemas import QUESTIONS, require


LABELS = ("answerable", "same_topic", "unrelated")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """The labelled question set of a JSON file (one list, or one object a line), checked: ids are unique, labels known, and an
    answerable question names the document and pages that answer it."""
    rows = spark.read.schema(QUESTIONS).option("multiLine", not path.endswith("l")).option("mode", "FAILFAST").json(path)
    known = F.col("label").isin(*LABELS) & (F.trim("question") != "") & F.col("id").isNotNull()
    told = (F.col("label") != "answerable") | (F.col("expected_document").isNotNull() & (F.size("expected_pages") > 0))
    require({"question_form": rows.where(~F.coalesce(known & told, F.lit(False))), "question_id": rows.groupBy("id").count().where("count > 1")})
    return rows


def hits_expected(outcomes: DataFrame, questions: DataFrame) -> DataFrame:
    """Outcomes with `supplied`: whether a source is of the expected document and touches an expected page."""
    q = questions.select(F.col("id").alias("question_id"), "label", "identifier", "expected_document", "expected_pages")
    joined = outcomes.join(q, "question_id")
    right = F.exists("sources", lambda s: (s["document_name"] == F.col("expected_document")) & F.arrays_overlap(s["pages"], F.col("expected_pages")))
    return joined.withColumn("supplied", F.coalesce(right, F.lit(False)))


def share(passed: Column, of: Column) -> Column:
    """Part of the rows `of` that passed; 1 where there are none."""
    return F.coalesce(F.avg(F.when(of, passed.cast("double"))), F.lit(1.0))


def shares(outcomes: DataFrame) -> DataFrame:
    """Rates of one evaluation: answerable questions that reach the model, others stopped by the gate or not answered,
    identifier passages supplied."""
    answerable = F.col("label") == "answerable"
    stopped = F.coalesce(F.col("reason").isin("no_relevant_content", "no_searchable_documents"), F.lit(False))
    return outcomes.agg(
        share(~stopped, answerable).alias("answerable_reaching_model"),
        share(stopped, ~answerable).alias("unanswerable_stopped"),
        share(F.col("status") != "answered", ~answerable).alias("unanswerable_not_answered"),
        share(F.col("supplied"), F.col("identifier").isNotNull()).alias("identifier_supplied"),
    )


def latency(rows: DataFrame, seconds: str, *by: str, accuracy: int | None = None) -> DataFrame:
    """p50, p95 and maximum, by interpolation between the closest ranks. That keeps the distinct values of a group in one task;
    accuracy bounds what is kept, and gives ranks that are wrong by one in `accuracy` at most."""
    c = F.col(seconds)
    if accuracy is not None:
        near = F.percentile_approx(c, [0.5, 0.95], accuracy)
        return rows.groupBy(*by).agg(near.alias("_p"), F.max(c).alias("max")).select(*by, F.col("_p")[0].alias("p50"), F.col("_p")[1].alias("p95"), "max")
    return rows.groupBy(*by).agg(F.percentile(c, F.lit(0.5)).alias("p50"), F.percentile(c, F.lit(0.95)).alias("p95"), F.max(c).alias("max"))


def makespan(jobs: DataFrame) -> DataFrame:
    """Seconds from the first creation to the last end."""
    return jobs.agg((F.max("finished_at").cast("timestamp").cast("double") - F.min("created_at").cast("timestamp").cast("double")).alias("makespan"))


def in_progress(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status").isin("pending", "processing")).alias("in_progress"))
