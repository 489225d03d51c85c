"""Queries over jobs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions import ids as I
from quire.plans.library import table
from quire.plans.registry import query
from quire.sources.scratch import scratch
from quire.streaming import jobs as J


def _place(spark) -> str:
    return f"{scratch(spark)}/stream-{uuid.uuid4().hex[:12]}"


@query("ingestion_stream", "select sha256, count(*) as n from (select distinct sha256(text) as sha256 from documents) group by 1")
def ingestion_stream(spark, d):
    """Documents read as a stream into a register keyed by fingerprint; each fingerprint is registered once."""
    place = _place(spark)
    path = f"{d.rstrip('/')}/documents.parquet"
    schema = spark.read.parquet(path).schema
    # a folder streams as it is; a single file streams through its parent with a name filter
    folder, name = path.rsplit("/", 1)
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")
    rows = stream.select(F.col("doc_id").cast("string").alias("id"), I.fingerprint(F.col("text")).alias("sha256"))
    J.ingest_stream(rows, f"{place}/register", f"{place}/checkpoint").awaitTermination()
    return spark.read.schema("id string, sha256 string").option("recursiveFileLookup", "true").parquet(f"{place}/register").groupBy("sha256").agg(F.count("*").alias("n"))


_JOBS = """j as (select event_id::varchar as id, user_id::varchar as document_id, case event_type when 'purchase' then 'failed' when 'view' then 'pending' else 'processing' end as status, (event_id % 4)::int as attempt, 3 as max_attempts, ts as created_at, ts + interval 90 second as lease_expires_at, 't' || event_id as token from events)"""


def _jobs(spark, d):
    ts = F.col("ts").cast("timestamp")
    status = F.when(F.col("event_type") == "purchase", "failed").when(F.col("event_type") == "view", "pending").otherwise("processing")
    return table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("document_id"), status.alias("status"), (F.col("event_id") % 4).cast("int").alias("attempt"), F.lit(3).alias("max_attempts"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("lease_token"), (ts + F.make_dt_interval(secs=F.lit(90))).alias("lease_expires_at"), F.lit(None).cast("string").alias("failure_code"), ts.alias("created_at"), ts.alias("updated_at"))


_NOW = "2024-01-15 00:00:00"


@query(
    "claim_jobs",
    f"""with {_JOBS}, o as (select * from j where status = 'pending' or (status = 'processing' and lease_expires_at < timestamp '{_NOW}'))
    select id, 'processing' as status, attempt + 1 as attempt from (select * from o where attempt < 3 order by created_at, id limit 20) union all select id, 'failed', attempt from o where attempt >= 3""",
)
def claim_jobs(spark, d):
    return J.claim(_jobs(spark, d), F.lit(_NOW).cast("timestamp"), limit=20).select("id", "status", "attempt")


@query(
    "enqueue_jobs",
    f"with {_JOBS} select distinct 'd' || c_custkey as document from customer where c_custkey::varchar not in (select document_id from j where status <> 'failed')",
)
def enqueue_jobs(spark, d):
    documents = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return J.enqueue(documents, _jobs(spark, d), F.current_timestamp()).select(F.concat(F.lit("d"), "document_id").alias("document"))


@query(
    "fenced_updates",
    f"""with {_JOBS}, e as (select id, case when id::int % 3 = 0 then 'complete' when id::int % 3 = 1 then 'fail' else 'heartbeat' end as event, case when id::int % 5 = 0 then 'stale' else token end as t, token, status from j)
    select id, case event when 'complete' then 'completed' when 'fail' then 'failed' else 'processing' end as status from e where t = token and (status = 'processing' or (event = 'fail' and status = 'pending'))""",
)
def fenced_updates(spark, d):
    jobs = _jobs(spark, d)
    n = F.col("id").cast("int")
    events = jobs.select("id", F.when(n % 3 == 0, "complete").when(n % 3 == 1, "fail").otherwise("heartbeat").alias("event"), F.when(n % 5 == 0, "stale").otherwise(F.col("lease_token")).alias("token"), F.lit(None).cast("string").alias("failure_code"))
    return J.fenced(jobs, events, F.lit(_NOW).cast("timestamp")).select("id", "status")


@query("jobs_in_progress", f"with {_JOBS} select count(*) filter (status in ('pending', 'processing')) as in_progress from j")
def jobs_in_progress(spark, d):
    from quire.operators import evaluation as E

    return E.in_progress(_jobs(spark, d))
