"""Mixing sources to target weights by Poisson replication.

The target share of a source is its given weight, or its bytes to the power of a temperature; its mean repetition rate is
target share over actual share, times a budget in epochs. Each document draws its number of copies by inverting the Poisson
distribution with that mean at a number in [0, 1) hashed from seed and id: the same document always gets the same count,
whatever the partitioning. Documents are exploded by their counts and dealt to partitions by the hash of seed, id and copy,
each partition sorted by that hash: a global shuffle in one exchange. A mean above 200 is split into several draws.

Sources are counted in a partial aggregation and the few rates joined back (broadcast only if few), so a hot source never
meets in one task. Nulls and odd input: a null source is a source of its own; a null text has no bytes; a null doc_id draws
by its text; repeated rows draw alike; clashing extra columns (rate, copy, shuffle_key) are replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialize, shuffle_partitions, sized_broadcast, table

TEMPERATURE, BUDGET, SEED = 0.5, 1.0, "mix-1"
MOST_MEAN = 200


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, budget: float = BUDGET) -> DataFrame:
    """docs(source, text) -> (source, bytes, rate), one row per source. weights: target shares, in any unit; a source that
    is not named gets none."""
    # one byte more per row: a source without any text still has a share
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("bytes"))
    if weights is None:
        weight: Column = F.pow(F.col("bytes").cast("double"), F.lit(temperature))
    else:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(F.when(F.col("source").isNotNull(), F.element_at(given, F.col("source"))), F.lit(0.0))
    sizes = materialize(sizes.withColumn("weight", weight), "sizes")
    whole = lambda c: sizes.agg(F.sum(c)).scalar()
    sizes = sizes.withColumns({"w": whole("weight"), "b": whole("bytes")})
    return sizes.select("source", "bytes", F.when(F.col("w") > 0, F.col("weight") / F.col("w") * F.col("b") / F.col("bytes") * budget).otherwise(0.0).alias("rate"))


def _cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until it is 1 for all purposes, X Poisson with this mean."""
    first = F.exp(-rate)
    upto = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"), F.array_append(s["c"], F.element_at(s["c"], -1) + s["p"] * rate / k).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), upto), F.struct(first.alias("p"), F.array(first).alias("c")), step, lambda s: s["c"])


def _name(row: str = "row") -> Column:
    text = F.coalesce(F.col(f"{row}.text"), F.lit(""))
    return F.coalesce(F.col(f"{row}.doc_id").cast("string"), F.concat(F.lit("t"), F.md5(text.cast("binary"))))


def mix(docs: DataFrame, seed: str = SEED, **how) -> DataFrame:
    """docs(doc_id, text, source, ...) -> all columns of docs and rate, copy (from 1), shuffle_key; in shuffled order. Columns of
    docs with one of these three names are replaced."""
    docs = docs.drop("rate", "copy", "shuffle_key")
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN)).cast("int")
    per = rates(docs, **how).withColumn("draws", draws).withColumn("cdf", _cdf(F.col("rate") / F.col("draws")))
    per = sized_broadcast(materialize(per.select("source", "rate", "draws", "cdf"), "rates"))
    u = lambda j: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), _name(), j.cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    # a row stays one struct, so that none of its names can clash with those of the plan
    drawn = docs.select(F.struct(*docs.columns).alias("row")).join(per, F.col("row.source").eqNullSafe(F.col("source")))
    drawn = drawn.withColumn("us", F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: u(j)))
    drawn = drawn.withColumn("copies", F.aggregate("us", F.lit(0), lambda s, x: s + F.size(F.filter("cdf", lambda c: c <= x))))
    copies = drawn.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), _name(), F.col("copy").cast("string")).cast("binary")))
    out = copies.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), "rate", "copy", "shuffle_key")
    return out.repartition(shuffle_partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key", "copy")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


OP4_SQL = f"""
with recursive sizes as (select source, sum(octet_length(encode(coalesce(text, ''))) + 1) as b, pow(sum(octet_length(encode(coalesce(text, ''))) + 1)::double, {TEMPERATURE}) as w from documents group by source),
rates as (select source, w / (select sum(w) from sizes) * (select sum(b) from sizes) / b * {BUDGET} as rate from sizes),
cdf as (select source, rate, 0 as k, exp(-rate) as p, exp(-rate) as c from rates
  union all select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from cdf where k < ceil(rate + 12 * sqrt(rate) + 30)),
drawn as (select *, coalesce(doc_id::varchar, 't' || md5(coalesce(text, ''))) as name from documents),
n as (select d.name, d.doc_id, d.text, d.lang, d.source, d.n_chars, c.rate, c.k + 1 as copy from drawn d join cdf c on d.source is not distinct from c.source
  and c.c <= ('0x' || substr(md5('{SEED}:' || d.name || ':1'), 1, 13))::bigint / {float(1 << 52)})
select doc_id, text, lang, source, n_chars, round(rate, 9) as rate, copy::int as copy, md5('{SEED}/order:' || name || ':' || copy) as shuffle_key from n"""
