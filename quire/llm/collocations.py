"""Phrase collocations: all n-grams as rows, counted per language, scored exactly, extended phrases removed, ranked.

Every 1..max_n-gram is a row of a DataFrame, made where its piece of text lies; a row goes on to the exchange only if both of its
parts of one word less were counted often enough, as an n-gram is never more frequent than its parts (joins with the phrases of
the level before: broadcast if counted small, else ordinary joins; no frequent phrase is lost). So all counts of candidates are
over all documents. Counts are summed in tasks before the exchange, thus a word that is a third of all rows is one row per task.

Defined cases: a null text is empty, a null language is `und`, texts without words give no rows, repeated rows count each time,
extra columns are ignored. The arithmetic is decimal of 38 digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import materialize, sized_broadcast, table

MAX_N, MIN_COUNT, PERCENT, TOP = 5, 100, 100, 2000
#: Phrases of a level that a semi-join may broadcast.
SMALL = 400_000
#: Phrases of which a pair of ids is one number of 64 bits.
ONE_NUMBER = 3_000_000_000
PIECE_END, WORD = r"[.,;:!?\x0A-\x0D]", r"[^\x20\x09]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, words (array): the pieces of all texts that have a word, where their texts lie. Written."""
    parts = documents.sparkSession.sparkContext.defaultParallelism
    d = documents.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if d.rdd.getNumPartitions() < parts:  # a table of one file is dealt out; a large one stays where it is
        d = d.repartition(parts)
    d = d.select("lang", F.explode(F.split(F.translate("text", UPPER, LOWER), PIECE_END)).alias("piece"))
    d = d.select("lang", F.trim(F.regexp_replace("piece", r"[\x20\x09]+", " ")).alias("piece")).where("piece <> ''")
    return materialize(d.select("lang", F.split("piece", " ").alias("words")), "pieces", compression="zstd")


def level(held: DataFrame, n: int, shorter: DataFrame | None, least: int) -> DataFrame:
    """lang, words, w1 .. wn, f, id of the n-grams with f >= least. shorter: the same of n - 1. Written. An n-gram is told by the
    ids of its first and its last n - 1 words, so the exchange carries one number (two, if there are very many phrases) and a
    count."""
    words = [f"w{i}" for i in range(1, n + 1)]
    at = F.explode(F.sequence(F.lit(0), F.size("words") - n))
    rows = held.where(F.size("words") >= n).select("lang", "words", at.alias("i"))
    rows = rows.select("lang", *[F.get("words", F.col("i") + j).alias(w) for j, w in enumerate(words)])
    if shorter is None:
        found = rows.groupBy("lang", "w1").agg(F.count("*").alias("f")).withColumn("words", F.array("w1"))
    else:
        small, names, total = sized_broadcast(shorter, SMALL), words[:-1], shorter.count()
        for part, name in ((words[:-1], "first"), (words[1:], "last")):
            rows = rows.join(small.select("lang", F.col("id").alias(name), *[F.col(a).alias(b) for a, b in zip(names, part)]), ["lang", *part])
        if total < ONE_NUMBER:
            counts = rows.groupBy((F.col("first") * total + F.col("last")).alias("pair")).agg(F.count("*").alias("f")).where(F.col("f") >= least)
            counts = counts.select(F.expr(f"pair div {max(total, 1)}").alias("first"), (F.col("pair") % max(total, 1)).alias("last"), "f")
        else:
            counts = rows.groupBy("first", "last").agg(F.count("*").alias("f")).where(F.col("f") >= least)
        of = lambda name, *more: shorter.select(F.col("id").alias(name), F.col("words").alias(f"{name}_words"), *more)
        found = counts.join(of("first", "lang"), "first").join(of("last"), "last").withColumn("words", F.concat("first_words", F.slice("last_words", -1, 1)))
    found = found.where(F.col("f") >= least).select("lang", "words", *[F.get("words", F.lit(j)).alias(w) for j, w in enumerate(words)], "f")
    return consecutive(materialize(found.withColumn("_id", F.monotonically_increasing_id()), f"level-{n}"))


def consecutive(rows: DataFrame) -> DataFrame:
    """A written table whose _id was given task by task, with id from 0 without gaps: one row a task is summed up and joined."""
    sizes = rows.groupBy(F.shiftrightunsigned("_id", 33).alias("_task")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_task", (F.sum("_n").over(W.orderBy("_task")) - F.col("_n")).alias("_start"))
    at = F.col("_id").bitwiseAND((1 << 33) - 1)
    return materialize(rows.join(F.broadcast(starts), F.shiftrightunsigned("_id", 33) == F.col("_task")).withColumn("id", F.col("_start") + at).drop("_id", "_task", "_n", "_start"), "numbered")


def phrases(held: DataFrame, max_n: int = MAX_N, least: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, words (array), f: all phrases of 1 to max_n words with f >= least. Written."""
    out = found = None
    for n in range(1, max_n + 1):
        found = level(held, n, found, least)
        rows = found.select("lang", "words", "f")
        out = rows if out is None else out.unionByName(rows)
    return materialize(out.select("lang", F.array_join("words", " ").alias("phrase"), "words", "f"), "phrases")


def scored(found: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score: the cut with the lowest score, then the first one, of every candidate."""
    cuts = found.where(F.size("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice("words", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("right"))
    known = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).join(totals, "lang")
    product = lambda *xs: F.expr(" * ".join(f"cast({x} as decimal(19,0))" for x in xs))
    cuts = cuts.withColumn("_top", product("a", "n") * F.lit(1000).cast("decimal(4,0)")).withColumn("_low", product("l", "r"))
    cuts = cuts.withColumn("score", F.expr("_top div _low"))
    return cuts.groupBy("lang", "phrase", "words").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "words", "c.a", "c.l", "c.r", "c.n", "c.score")


def collocations(documents: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, least: int = MIN_COUNT, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score. A candidate goes if a one-word extension of it has percent of its count: counts
    only fall as a phrase grows, so a longer one that has it passes it on to the extensions between."""
    held = pieces(documents, text, lang)
    totals = held.groupBy("lang").agg(F.sum(F.size("words")).alias("n"))
    found = phrases(held, max_n, least)
    longer = found.where(F.size("words") > 2)
    inner = F.explode(F.array(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1)))
    extended = longer.select("lang", inner.alias("words"), "f").groupBy("lang", F.array_join("words", " ").alias("phrase")).agg(F.max("f").alias("most"))
    kept = scored(found, totals).alias("s").join(extended.alias("e"), (F.col("s.lang") == F.col("e.lang")) & (F.col("s.phrase") == F.col("e.phrase")) & (100 * F.col("e.most") >= percent * F.col("s.a")), "left_anti")
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
with piece as (
  select lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda w: w <> '') as ws
  from (
    select coalesce(lang, 'und') as lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as p
    from documents
  )
),
gram as (
  select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase
  from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) as i from piece, range(1, 6) as t(k) where len(ws) >= k)
),
f as materialized (select lang, k, phrase, lang || chr(9) || phrase as id, count(*) as f from gram group by all),
total as (select lang, sum(f) as n from f where k = 1 group by lang),
candidate as materialized (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k > 1 and f >= 100),
cut as materialized (
  select c.lang, c.phrase, c.k, c.a, j, l.f as l, r.f as r, t.n::bigint as n, (1000::hugeint * c.a * t.n) // (l.f::hugeint * r.f) as score
  from (select *, unnest(range(1, k)) as j from candidate) c
  join f l on l.id = c.lang || chr(9) || array_to_string(c.ws[1:c.j], ' ')
  join f r on r.id = c.lang || chr(9) || array_to_string(c.ws[c.j + 1:c.k], ' ')
  join total t on t.lang = c.lang
),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, j) = 1),
inner_part as (
  select lang, array_to_string(ws[i:i + j - 1], ' ') as phrase, max(a) as most
  from (select lang, ws, a, i, unnest(range(2, least(k, k - i + 2))) as j from (select *, unnest(range(1, k)) as i from candidate))
  group by all
),
kept as (
  select b.* from best b left join inner_part p on p.lang = b.lang and p.phrase = b.phrase
  where p.most is null or 100 * p.most < 100 * b.a
)
select lang, rank, phrase, a, l, r, n, score::bigint as score from (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept
) where rank <= 2000
"""
