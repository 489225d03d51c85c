"""Schemas of the data model and the rules that its tables must keep. Parquet enforces none of them, so each rule is a named
assertion that returns the rows that break it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = "struct<left:double,top:double,right:double,bottom:double>"
DOCUMENTS = "id string, sha256 string, file_name string, size_bytes bigint, page_count int, blob_key string, created_at timestamp"
SUMMARY = "struct<pages:bigint,text_elements:bigint,tables:bigint,table_chains:bigint,images:bigint,figures_described:bigint,figures_skipped:bigint,figures_not_described:bigint,retrieval_units:bigint,recognized_pages:bigint>"
JOBS = (
    "id string, document_id string, status string, stage string, pages_total int, pages_done int, attempt int, max_attempts int, lease_token string, "
    f"lease_expires_at timestamp, worker_id string, correlation_id string, failure_code string, failure_reason string, summary {SUMMARY}, "
    "created_at timestamp, started_at timestamp, finished_at timestamp, updated_at timestamp"
)
ELEMENTS = (
    "id string, document_id string, kind string, page int, bbox_left double, bbox_top double, bbox_right double, bbox_bottom double, reading_order int, "
    "origin string, heading_level int, text string, table_rows array<array<string>>, confidence double, image_key string, image_class string, "
    "labels array<string>, description string, description_status string, unverified_identifiers array<string>, is_decorative boolean"
)
EDGES = "document_id string, source_id string, target_id string, kind string, score double"
UNITS = (
    "id string, document_id string, unit_type string, text string, heading_path array<string>, pages array<int>, element_ids array<string>, "
    "boxes array<struct<page:int,left:double,top:double,right:double,bottom:double>>, figure_ids array<string>, image_key string, visible boolean, dense array<float>"
)
PAGE_SIZES = "document_id string, page int, width double, height double"
IMAGE_HASHES = "element_id string, sha256 string"
QUESTIONS = "id string, question string, language string, label string, expected_document string, expected_pages array<int>, identifier string"

# Members of the enumerations: fixed values of the data model.
ENUMS = {
    "job_status": ("pending", "processing", "completed", "failed"),
    "job_stage": ("extracting", "describing_figures", "building_units", "embedding", "indexing", "finalizing"),
    "failure_code": ("encrypted_document", "corrupt_document", "no_extractable_text", "provider_unavailable", "interrupted_repeatedly", "internal_error"),
    "element_kind": ("heading", "paragraph", "list_item", "caption", "table", "image", "page_furniture"),
    "text_origin": ("text_layer", "recognized"),
    "description_status": ("described", "skipped", "not_described"),
    "relationship_kind": ("caption_of", "title_of", "describes", "near", "continues"),
    "unit_type": ("text", "table", "figure"),
    "answer_status": ("answered", "not_enough_information"),
    "not_enough_reason": ("no_searchable_documents", "no_relevant_content", "not_answered_by_sources", "no_valid_citations"),
}


def _one_of(column: str, enum: str) -> Column:
    return F.col(column).isin(*ENUMS[enum])


def _broken(rows: DataFrame, holds: Column) -> DataFrame:
    """A rule holds only where it is true: unknown is broken too."""
    return rows.where(~F.coalesce(holds, F.lit(False)))


def _repeated(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def document_rules(documents: DataFrame) -> dict[str, DataFrame]:
    return {
        "unique_fingerprint": _repeated(documents, "sha256"),
        "fingerprint_form": _broken(documents, F.col("sha256").rlike("^[0-9a-f]{64}$")),
        "positive_size": _broken(documents, F.col("size_bytes") > 0),
        "positive_pages": _broken(documents, F.col("page_count").isNull() | (F.col("page_count") > 0)),
    }


def job_rules(jobs: DataFrame) -> dict[str, DataFrame]:
    done, total = F.col("pages_done"), F.col("pages_total")
    return {
        "status": _broken(jobs, _one_of("status", "job_status")),
        "one_active_job": _repeated(jobs.where("status <> 'failed'"), "document_id"),
        "attempts": _broken(jobs, F.col("attempt").between(0, F.col("max_attempts"))),
        "pages": _broken(jobs, (done >= 0) & (total.isNull() | (done <= total))),
        "failure_code": _broken(jobs, (F.col("status") == "failed") == F.col("failure_code").isNotNull()),
    }


def element_rules(elements: DataFrame) -> dict[str, DataFrame]:
    edges = [F.col(f"bbox_{s}") for s in ("left", "top", "right", "bottom")]
    finite = F.lit(True)
    for e in edges:
        finite = finite & (e >= 0) & ~F.isnan(e) & (e < float("inf"))
    image, table = F.col("kind") == "image", F.col("kind") == "table"
    return {
        "kind": _broken(elements, _one_of("kind", "element_kind")),
        "box_finite": _broken(elements, finite),
        "box_ordered": _broken(elements, (edges[2] >= edges[0]) & (edges[3] >= edges[1])),
        "confidence": _broken(elements, F.col("confidence").isNull() | ((F.col("origin") == "recognized") & F.col("confidence").between(0, 1))),
        "heading_level": _broken(elements, (F.col("kind") == "heading") == F.col("heading_level").isNotNull()),
        "table_rows": _broken(elements, table | F.col("table_rows").isNull()),
        "image_fields": _broken(elements, image | (F.col("image_key").isNull() & F.col("image_class").isNull() & F.col("description_status").isNull())),
        "description": _broken(elements, F.col("description").isNotNull() == (F.coalesce(F.col("description_status"), F.lit("")) == "described")),
        "reading_order": _repeated(elements, "document_id", "reading_order"),
    }


def edge_rules(edges: DataFrame) -> dict[str, DataFrame]:
    return {
        "kind": _broken(edges, _one_of("kind", "relationship_kind")),
        "unique": _repeated(edges, "source_id", "target_id", "kind"),
        "self_link": _broken(edges, F.col("source_id") != F.col("target_id")),
    }


def relevance_rules(judged: DataFrame) -> dict[str, DataFrame]:
    return {"relevance": _broken(judged, F.col("relevance").between(0, 1) & ~F.isnan("relevance"))}


class BrokenRule(ValueError):
    """A stored table breaks a rule of the data model."""


def require(rules: dict[str, DataFrame]) -> None:
    """Fail with the names of the rules that any row breaks."""
    broken = [name for name, rows in rules.items() if not rows.isEmpty()]
    if broken:
        raise BrokenRule(", ".join(broken))
