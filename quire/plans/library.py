"""Queries over the relational operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ids as I
from quire.functions import text as T
from quire.operators import evaluation as E
from quire.operators import relational as R
from quire.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("register_by_fingerprint", "select doc_id, sha256(text) as sha256 from documents qualify row_number() over (partition by sha256(text) order by doc_id) = 1")
def register_by_fingerprint(spark, d):
    docs = table(spark, d, "documents").select("doc_id", I.fingerprint(F.col("text")).alias("sha256"))
    return R.register_by_fingerprint(docs, order="doc_id")


@query("point_lookup", "select * from customer where c_custkey = 7")
def point_lookup(spark, d):
    return R.point_lookup(table(spark, d, "customer"), 7, "c_custkey")


@query("in_lookup", "select n_nationkey, n_name from nation where n_nationkey in (3, 5, 999)")
def in_lookup(spark, d):
    return R.in_lookup(table(spark, d, "nation"), [3, 5, 999], "n_nationkey").select("n_nationkey", "n_name")


@query("keyset_page_desc", "select o_orderdate, o_orderkey from orders where (o_orderdate, o_orderkey) < (timestamp '1996-01-01', 500) order by 1 desc, 2 desc limit 51")
def keyset_page_desc(spark, d):
    rows = table(spark, d, "orders").select("o_orderdate", "o_orderkey")
    cursor = R.decode_cursor(R.encode_cursor(datetime(1996, 1, 1), 500), datetime.fromisoformat, int)
    return R.keyset_page(rows, ["o_orderdate", "o_orderkey"], 50, cursor, descending=True)


@query("keyset_page_asc", "select l_orderkey, l_linenumber from lineitem where (l_orderkey, l_linenumber) > (100, 2) order by 1, 2 limit 51")
def keyset_page_asc(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return R.keyset_page(rows, ["l_orderkey", "l_linenumber"], 50, (100, 2))


@query("latest_row_per_key", "select user_id, event_id, ts, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_row_per_key(spark, d):
    return R.latest_per_key(table(spark, d, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id")


@query(
    "batched_left_join_latest",
    """select c_custkey, o_orderkey, o_orderdate from customer left join
    (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) on o_custkey = c_custkey""",
)
def batched_left_join_latest(spark, d):
    latest = R.latest_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate", "o_orderkey")
    return R.with_latest(table(spark, d, "customer").select("c_custkey"), latest, "c_custkey", "o_custkey").select("c_custkey", "o_orderkey", "o_orderdate")


_EDGES = "select 'c' || o_custkey as source_id, 'o' || o_orderkey as target_id, 'near' as kind from orders union all select 'o' || l_orderkey, 'p' || l_partkey, 'continues' from lineitem"


def _edges(spark, d):
    c = lambda p, x: F.concat(F.lit(p), F.col(x).cast("string"))
    orders = table(spark, d, "orders").select(c("c", "o_custkey").alias("source_id"), c("o", "o_orderkey").alias("target_id"), F.lit("near").alias("kind"))
    return orders.unionAll(table(spark, d, "lineitem").select(c("o", "l_orderkey").alias("source_id"), c("p", "l_partkey").alias("target_id"), F.lit("continues").alias("kind")))


@query("edges_touching", f"with e as ({_EDGES}), i as (select 'o' || o_orderkey as id from orders where o_orderstatus = 'P') select * from e where source_id in (select id from i) or target_id in (select id from i)")
def edges_touching(spark, d):
    ids = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return R.edges_touching(_edges(spark, d), ids)


@query(
    "nested_edges",
    f"""with e as (select distinct * from ({_EDGES})), n as (select source_id as id from e union all select target_id from e where target_id <> source_id)
    select c_custkey, (select count(*) from n where n.id = 'c' || c_custkey) as edges from customer""",
)
def nested_edges(spark, d):
    elements = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    edges = _edges(spark, d).distinct().withColumn("score", F.lit(None).cast("double"))
    return R.nest_edges(elements, edges).select("c_custkey", F.size("edges").cast("long").alias("edges"))


@query("optional_filters", "select l_orderkey, l_linenumber from lineitem where l_linenumber = 2 and l_returnflag = 'R'")
def optional_filters(spark, d):
    return R.filtered(table(spark, d, "lineitem"), l_linenumber=2, l_returnflag="R", l_partkey=None).select("l_orderkey", "l_linenumber")


@query(
    "conditional_summary",
    """select event_type, count(*) as n, count(*) filter (value > 50) as large, count(distinct user_id) as users, count(*) filter (props is null) as bare from events group by event_type""",
)
def conditional_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("props").isNull()).alias("bare"))


@query(
    "repeated_items",
    """with g as (select lang, sha256(text) as sha256, count(distinct source) as sources, count(*) as n from documents group by all), t as (select lang, count(distinct source) as total from documents group by lang)
    select lang, sha256, sources, n from g join t using (lang) where sources > 1 and (sources >= 3 or sources / total >= 0.2)""",
)
def repeated_items(spark, d):
    docs = table(spark, d, "documents").select("lang", "source", I.fingerprint(F.col("text")).alias("sha256"))
    total = docs.groupBy("lang").agg(F.countDistinct("source").alias("total"))
    groups = docs.groupBy("lang", "sha256").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("n")).where("sources > 1")
    return groups.join(total, "lang").where("sources >= 3 or sources / total >= 0.2").drop("total")


@query(
    "submission_decision",
    """with l as (select user_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
    select c_custkey, case when event_type is null or event_type = 'purchase' then 'new_job' when event_type = 'view' then 'already_ingested' else 'in_progress' end as decision from customer left join l on user_id = c_custkey""",
)
def submission_decision(spark, d):
    status = F.when(F.col("event_type") == "purchase", "failed").when(F.col("event_type") == "view", "completed").otherwise("processing")
    jobs = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), status.alias("status"))
    documents = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return R.submission(documents, jobs).select(F.col("id").alias("c_custkey"), "decision")


@query(
    "completed_only",
    """select c_custkey from customer where c_custkey in (select user_id from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) where event_type = 'view')""",
)
def completed_only(spark, d):
    jobs = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "view", "completed").otherwise("failed").alias("status"))
    return R.completed_only(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), jobs).select(F.col("id").alias("c_custkey"))


@query("strict_join", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def strict_join(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name")
    return R.strict_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey", "c_custkey", "customer").select("o_orderkey", "c_name")


@query("last_wins", "select n_nationkey, coalesce(s.n, n_name) as name from nation left join (select s_nationkey as k, max(s_name) as n from supplier group by 1) s on k = n_nationkey")
def last_wins(spark, d):
    base = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    over = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_name").alias("name"))
    over = over.join(base.select("k"), "k", "left_semi")
    return R.last_wins(base, over, key="k").select(F.col("k").alias("n_nationkey"), "name")


@query("heads_of_chains", "select distinct l_partkey as id from lineitem where l_partkey not in (select l_suppkey from lineitem)")
def heads_of_chains(spark, d):
    items = table(spark, d, "lineitem")
    return items.select(F.col("l_partkey").alias("id")).distinct().join(items.select(F.col("l_suppkey").alias("id")).distinct(), "id", "left_anti")


@query("latency_percentiles", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, max(value) as max from events group by event_type")
def latency_percentiles(spark, d):
    got = E.latency(table(spark, d, "events"), "value", "event_type")
    return got.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "max")


@query("makespan", "select epoch(max(ts)) - epoch(min(ts)) as makespan from events")
def makespan(spark, d):
    return E.makespan(table(spark, d, "events").select(F.col("ts").alias("created_at"), F.col("ts").alias("finished_at")))


@query(
    "page_runs",
    """with p as (select distinct l_orderkey, l_partkey % 12 as page from lineitem), i as (select *, page - row_number() over (partition by l_orderkey order by page) as run from p),
    r as (select l_orderkey, min(page) as a, max(page) as b, count(*) as n from i group by l_orderkey, run)
    select l_orderkey, case when sum(n) = 1 then 'page ' else 'pages ' end || string_agg(case when a = b then a::varchar else a || '–' || b end, ', ' order by a) as pages from r group by l_orderkey""",
)
def page_runs(spark, d):
    pages = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 12).cast("int")).alias("p"))
    return pages.select("l_orderkey", T.page_runs(F.col("p")).alias("pages"))


@query(
    "rule_violations",
    """select 'unique_fingerprint' as rule, count(*) as n from (select sha256(text) from documents group by 1 having count(*) > 1)
    union all select 'positive_size', count(*) from documents where not coalesce(n_chars > 0, false)""",
)
def rule_violations(spark, d):
    from quire.sources import schemas

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), I.fingerprint(F.col("text")).alias("sha256"), F.col("n_chars").alias("size_bytes"), F.lit(1).alias("page_count"))
    rules = schemas.document_rules(docs)
    counted = [rules[r].agg(F.count("*").alias("n")).select(F.lit(r).alias("rule"), "n") for r in ("unique_fingerprint", "positive_size")]
    return counted[0].unionAll(counted[1])


@query(
    "waiting_turns",
    """select conv_id, turn, turn - 1 as ahead from conversations c where role = 'user' and not exists (select 1 from conversations x where x.conv_id = c.conv_id and x.turn > c.turn and x.role = 'assistant')""",
)
def waiting_turns(spark, d):
    """Turns of a conversation that no answer follows, first in first out."""
    c = table(spark, d, "conversations")
    answered = c.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return c.where("role = 'user'").join(answered, "conv_id", "left").where("last is null or turn > last").select("conv_id", "turn", (F.col("turn") - 1).alias("ahead"))
