"""Relational access: look-ups, keyset pages, latest rows, registration, nesting of edges."""

from __future__ import annotations

import base64
import binascii
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_PAGE, DEFAULT_PAGE = 200, 50


class NotFound(LookupError):
    """No row has the id."""


class InvalidCursor(ValueError):
    """A page cursor that this library did not issue."""


class Inconsistent(RuntimeError):
    """A stored row refers to one that is missing."""


def point_lookup(rows: DataFrame, value, key: str = "id") -> DataFrame:
    """The row with an id; fails if there is none."""
    found = rows.where(F.col(key) == value)
    if found.isEmpty():
        raise NotFound(f"{key} {value}")
    return found


def in_lookup(rows: DataFrame, values: list, key: str = "id") -> DataFrame:
    """Rows with any of the ids; unknown ids are skipped, no ids read nothing."""
    return rows.where(F.col(key).isin(values)) if values else rows.limit(0)


def semi_lookup(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The same with ids in a table; Spark broadcasts it only while it is small."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias("_id")).distinct(), F.col(key) == F.col("_id"), "left_semi")


def edges_touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with either end among the ids, each once: two equi-joins, the second without what the first found."""
    i = ids.select(F.col(ids.columns[0]).alias("_id")).distinct()
    by_source = edges.join(i, edges["source_id"] == i["_id"], "left_semi")
    rest = edges.join(i, edges["source_id"] == i["_id"], "left_anti")
    return by_source.unionByName(rest.join(i, rest["target_id"] == i["_id"], "left_semi"))


def filtered(rows: DataFrame, **equal) -> DataFrame:
    """Conjunction of equality filters; None leaves a filter out."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def page_limit(limit: int | None) -> int:
    limit = DEFAULT_PAGE if limit is None else limit
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be 1 to {MAX_PAGE}")
    return limit


def encode_cursor(*parts) -> str:
    text = "|".join(p.isoformat() if isinstance(p, datetime) else str(p) for p in parts)
    return base64.urlsafe_b64encode(text.encode()).decode()


def decode_cursor(cursor: str, *kinds) -> tuple:
    """The parts of a cursor, each read by its kind (int, str, datetime.fromisoformat, ...)."""
    try:
        parts = base64.b64decode(cursor.encode(), altchars=b"-_", validate=True).decode().split("|")
        if len(parts) != len(kinds):
            raise ValueError
        return tuple(k(p) for k, p in zip(kinds, parts))
    except (ValueError, UnicodeError, binascii.Error) as e:
        raise InvalidCursor(cursor) from e


def after(columns: list[str], values: tuple, descending: bool = False) -> Column:
    """Rows strictly behind a key in lexicographic order. The plain comparison of the first column comes first, so that
    Parquet statistics can skip row groups."""
    step = (lambda c, v: F.col(c) < F.lit(v)) if descending else (lambda c, v: F.col(c) > F.lit(v))
    reach = (lambda c, v: F.col(c) <= F.lit(v)) if descending else (lambda c, v: F.col(c) >= F.lit(v))
    found = F.lit(False)
    for c, v in reversed([*zip(columns, values)]):
        found = step(c, v) | ((F.col(c) == F.lit(v)) & found)
    return reach(columns[0], values[0]) & found


def keyset_page(rows: DataFrame, columns: list[str], limit: int, cursor: tuple | None = None, descending: bool = False) -> DataFrame:
    """One page and a look-ahead row more, in key order."""
    if cursor is not None:
        rows = rows.where(after(columns, cursor, descending))
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in columns]
    return rows.orderBy(*order).limit(limit + 1)


def page_of(rows: DataFrame, columns: list[str], limit: int | None = None, cursor: str | None = None, kinds: tuple = (), descending: bool = False):
    """(rows of the page, cursor of the next page or None)."""
    limit = page_limit(limit)
    got = keyset_page(rows, columns, limit, decode_cursor(cursor, *kinds) if cursor else None, descending).collect()
    more = encode_cursor(*(got[limit - 1][c] for c in columns)) if len(got) > limit else None
    return got[:limit], more


def latest_per_key(rows: DataFrame, key: str, *newest: str) -> DataFrame:
    """The newest row of each key, by a partial aggregation over whole rows: no window, no sort of hot keys."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(*newest)).alias("_row")).select("_row.*")


def with_latest(rows: DataFrame, latest: DataFrame, left: str, right: str) -> DataFrame:
    return rows.join(latest, rows[left] == latest[right], "left")


def register_by_fingerprint(incoming: DataFrame, registered: DataFrame | None = None, fingerprint: str = "sha256", order: str = "id") -> DataFrame:
    """The rows to insert: of equal fingerprints the first by `order`, none that is registered already."""
    first = incoming.groupBy(F.col(fingerprint).alias("_fp")).agg(F.min_by(F.struct(*incoming.columns), F.col(order)).alias("_row")).select("_row.*")
    return first if registered is None else first.join(registered.select(fingerprint), fingerprint, "left_anti")


def nest_edges(elements: DataFrame, edges: DataFrame) -> DataFrame:
    """Each element with its edges on either end, ordered."""
    edge = F.struct("source_id", "target_id", "kind", "score")
    ends = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("_end"), edge.alias("_edge"))
    lists = ends.groupBy("_end").agg(F.array_sort(F.collect_list("_edge")).alias("edges"))
    joined = elements.join(lists, elements["id"] == lists["_end"], "left").drop("_end")
    return joined.withColumn("edges", F.coalesce("edges", F.array().cast(lists.schema["edges"].dataType)))


def strict_join(rows: DataFrame, others: DataFrame, key: str, other_key: str, what: str) -> DataFrame:
    """Inner join in which a missing partner is an error, not a lost row: a left join whose unmatched rows fail the query."""
    marked = others.withColumn("_there", F.lit(True))
    joined = rows.join(marked, rows[key] == marked[other_key], "left")
    ok = F.coalesce(F.col("_there"), F.raise_error(F.concat(F.lit(f"{what} is missing: "), F.col(key).cast("string"))).cast("boolean"))
    return joined.where(ok).drop("_there")


def in_order(units: DataFrame, elements: DataFrame, ids: str = "element_ids") -> DataFrame:
    """Units with the structs of their elements in the order of an array of ids (`members`); a missing element fails."""
    at = units.select(F.col("id").alias("_unit"), F.posexplode(ids).alias("_at", "_element"))
    found = strict_join(at, elements.select(F.col("id").alias("_eid"), F.struct(*elements.columns).alias("_e")), "_element", "_eid", "element")
    lists = found.groupBy("_unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_e"))), lambda x: x["_e"]).alias("members"))
    return units.join(lists, units["id"] == lists["_unit"], "left").drop("_unit")


def submission(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """What an upload of each document leads to, by its latest job: a new job where there is none or it failed, else none."""
    latest = latest_per_key(jobs, "document_id", "created_at", "id").select("document_id", "status")
    joined = documents.join(latest, documents["id"] == latest["document_id"], "left").drop("document_id")
    decision = F.when(F.col("status").isNull() | (F.col("status") == "failed"), "new_job").when(F.col("status") == "completed", "already_ingested").otherwise("in_progress")
    return joined.withColumn("decision", decision)


def completed_only(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents whose latest job is completed."""
    latest = latest_per_key(jobs, "document_id", "created_at", "id").where("status = 'completed'").select(F.col("document_id").alias("_d"))
    return documents.join(latest, documents["id"] == latest["_d"], "left_semi")


def display_status(status: Column) -> Column:
    return F.coalesce(status, F.lit("pending"))


def last_wins(*maps: DataFrame, key: str) -> DataFrame:
    """Union of maps in which later ones win."""
    every = None
    for i, m in enumerate(maps):
        m = m.withColumn("_map", F.lit(i))
        every = m if every is None else every.unionByName(m)
    return latest_per_key(every, key, "_map").drop("_map")


def concatenated(*lists: DataFrame) -> DataFrame:
    """Lists in a fixed order: family counts the list that a row is of."""
    out = None
    for i, rows in enumerate(lists):
        rows = rows.withColumn("family", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out


def ordered_distinct(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key by an explicit position."""
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_row")).select("_row.*")


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def newest(rows: DataFrame, key: str, value, *order: str) -> DataFrame:
    """The newest row of one key, or none."""
    return rows.where(F.col(key) == value).orderBy(*(F.col(c).desc() for c in order)).limit(1)
