"""Substring dedup by hashing of lines and of the paragraphs that they hold.

A text is a sequence of words (A-Z in lower case). Paragraphs are its units: each starts where a line starts or behind an
anchor word, and ends at the first line end, sentence end or low word after at least `min_words` words. A low word is less
than the words beside it (as bytes), an anchor word less than `spread` words on either side; content alone decides, so the
same passage is cut alike wherever it stands, in the midst of a longer line too. Where no anchor comes for `most` words (a
word repeated, a table of equal cells) one is set, a unit ends at the latest `most` words after `min_words`, and the last
`min_words` words of a text are a unit, so that a whole copy is a repeat from its first word to its last.

A unit is known by the MD5 of its words joined by blanks. Digests are grouped globally in a partial aggregation that keeps
only the least (doc_id, start, end) and the count; digests that occur more than once are joined back to the units, both
sides from written tables, so that a very common unit is a skewed join key that adaptive execution splits. The earliest
occurrence stays; all others are repeats. Repeats that overlap or touch are one passage, reported with its offsets in the
original text, and can be cut out of it. What is cut always stands in an earlier place that is kept.

A passage that two documents share is found if it holds a whole unit, which 51 words or more nearly always do; passages of
fewer than `min_words` words never are. Offsets are code points, the end exclusive. Nulls and odd input: a null or empty
text has no units; a null doc_id ranks last; rows that repeat an id and a text share their rank, so neither is removed for
the other; extra columns are ignored (kept by drop_repeats); an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import materialize, small_batches, table, utf8

MIN_WORDS, SPREAD, MOST = 40, 4, 32
SENTENCE_ENDS = ".!?"


def text_units(data: bytes, min_words: int = MIN_WORDS, spread: int = SPREAD, most: int = MOST) -> list[tuple[int, int, int, int, bytes]]:
    """UTF-8 bytes -> (start, end, number of the first word, words, digest) of each unit."""
    data = data.lower()
    words = data.split()
    n = len(words)
    if n < min_words:
        return []
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate(([True], (raw == 32) | ((raw >= 9) & (raw <= 13)), [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    first, last = edges[::2], edges[1::2]
    breaks = np.cumsum(raw == 10, dtype=np.int32)
    line_end = np.append(breaks[first[1:]] != breaks[last[:-1] - 1], True)
    end = (line_end | np.isin(raw[last - 1], list(SENTENCE_ENDS.encode()))).tolist()
    anchors = [0]
    for i, line in enumerate(line_end[:-1].tolist()):
        x = words[i]
        low = x < words[i + 1] and (not i or x <= words[i - 1])
        if low:
            end[i] = True
            low = x < min(words[i + 1 : i + spread + 1]) and (not i or x <= min(words[max(0, i - spread) : i]))
        if line or low:
            anchors += range(anchors[-1] + most, i + 1, most)
            anchors.append(i + 1)
    anchors += range(anchors[-1] + most, n, most)
    begin = np.array([a for a in anchors if a < n - min_words] + [n - min_words])
    ends = np.flatnonzero(end) + 1
    stop = np.minimum(ends[np.searchsorted(ends, begin + min_words)], begin + min_words + most)
    if data.isascii():
        start, close = first[begin], last[stop - 1]
    else:
        point = np.cumsum((raw & 0xC0) != 0x80)
        start, close = point[first[begin]] - 1, point[last[stop - 1] - 1]
    return [(s, c, a, b - a, md5(b" ".join(words[a:b])).digest()) for s, c, a, b in zip(start.tolist(), close.tolist(), begin.tolist(), stop.tolist())]


def units(docs: DataFrame, **how) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, text_key, start, end, first, n_words, digest); text_key tells apart texts of one id."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_key", "start", "end", "first", "n_words", "digest"]

    def run(batches):
        for b in batches:
            rows = [(doc, key, *u) for doc, key, text in zip(*(c.to_pylist() for c in b.columns)) for u in text_units(text, **how)]
            types = [b.column(0).type, *[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows)] or [()] * len(names), types)], names)

    text = utf8(F.col("text"))
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, text_key long, start long, end long, first long, n_words long, digest binary")


def _passages(docs: DataFrame, **how) -> DataFrame:
    found = materialize(units(docs, **how), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "end")
    first = found.groupBy("digest").agg(F.min(rank).alias("at"), F.count("*").alias("n")).where("n > 1")
    first = materialize(first.select("digest", F.col("at.doc_id").alias("kept_doc_id"), F.col("at.start").alias("kept_start"), F.col("at.end").alias("kept_end")), "first")
    later = ~(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")) & (F.col("start") == F.col("kept_start")))
    again = found.join(first, "digest").where(later).withColumn("stop", F.col("first") + F.col("n_words"))
    # the units of one text, which come in order: a passage ends where the next unit begins behind all before it
    order = W.partitionBy("doc_id", "text_key").orderBy("first", "stop")
    before = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    again = again.withColumn("nth", F.when(F.col("first") <= before, 0).otherwise(1)).withColumn("nth", F.sum("nth").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    kept = F.min(F.struct("first", "kept_doc_id", "kept_start", "kept_end")).alias("k")
    found = again.groupBy("doc_id", "text_key", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("stop") - F.min("first")).alias("n_words"), kept)
    return found.select("doc_id", "text_key", "start", "end", "n_words", "k.kept_doc_id", "k.kept_start", "k.kept_end")


def repeats(docs: DataFrame, **how) -> DataFrame:
    """Every passage that repeats an earlier one: doc_id, start, end, n_words, and the kept occurrence of its first unit
    (kept_doc_id, kept_start, kept_end). Rows that repeat an id and a text have their passages reported once."""
    return _passages(docs, **how).drop("text_key")


def drop_repeats(docs: DataFrame, **how) -> DataFrame:
    """The same rows and columns with repeated passages cut out of text, each with the white space behind it; and
    kept_spans, the spans of the original text that are left (in the place of a column of that name)."""
    cuts = _passages(docs, **how).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))

    @F.pandas_udf("text string, kept_spans array<struct<start:bigint,end:bigint>>")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(texts, cuts):
            kept, at = [], 0
            for s in spans if spans is not None else []:
                if s["start"] > at:
                    kept.append((at, s["start"]))
                at = s["end"]
                while at < len(text) and text[at] in " \t\n\v\f\r":
                    at += 1
            if text is not None and at < len(text):
                kept.append((at, len(text)))
            out.append((text and "".join(text[a:b] for a, b in kept), [{"start": a, "end": b} for a, b in kept]))
        return pd.DataFrame(out, columns=["text", "kept_spans"]).astype(object)

    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(utf8(F.col("text"))).alias("key"))
    joined = rows.join(cuts, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")), "left")
    done = joined.select("row", cut("row.text", "cuts").alias("cut"))
    others = [F.col("cut.text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c != "kept_spans"]
    return done.select(*others, "cut.kept_spans")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


_AFTER, _BEFORE = f"rows between 1 following and {SPREAD} following", f"rows between {SPREAD} preceding and 1 preceding"
OP5_SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
s as (select rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws, regexp_extract_all(text, '[\\x20\\x09-\\x0D]+') as gs, (not regexp_matches(text, '^[^\\x20\\x09-\\x0D]'))::int as lead from d),
w as (select rid, doc_id, len(ws) as n, unnest(range(len(ws))) as i, unnest(ws) as raw, unnest(list_transform(range(1, len(ws) + 1), lambda j: coalesce(gs[j + lead], ''))) as gap, case when lead = 1 then length(gs[1]) else 0 end as skip from s),
p as (select *, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x, skip + sum(length(raw) + length(gap)) over o - length(raw) - length(gap) as start from w window o as (partition by rid order by i rows unbounded preceding)),
q as (select *, start + length(raw) as stop, contains(gap, chr(10)) or i = n - 1 as line_end, right(raw, 1) in ('.', '!', '?') as sentence_end,
  lead(x) over o as next, lag(x) over o as prior, min(x) over (partition by rid order by i {_AFTER}) as low_after, min(x) over (partition by rid order by i {_BEFORE}) as low_before from p window o as (partition by rid order by i)),
r as (select *, line_end or sentence_end or (x < next and (prior is null or x <= prior)) as ends, coalesce(lag(line_end or (x < low_after and (low_before is null or x <= low_before))) over (partition by rid order by i), true) as anchor from q),
t as (select *, max(case when anchor then i end) over (partition by rid order by i rows unbounded preceding) as held, min(case when ends then i + 1 end) over (partition by rid order by i rows between {MIN_WORDS - 1} following and {MIN_WORDS + MOST - 1} following) as close from r),
u as (select rid, doc_id, i as a, least(coalesce(close, i + {MIN_WORDS + MOST}), n) as b, start from t where i + {MIN_WORDS} < n and (i - held) % {MOST} = 0 or i + {MIN_WORDS} = n),
k as (select u.rid, u.doc_id, a, b, u.start::bigint as start, q.stop::bigint as "end", array_to_string(list_transform(ws[a + 1 : b], lambda v: translate(v, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')), ' ') as unit from u join s on s.rid = u.rid join q on q.rid = u.rid and q.i = b - 1),
f as (select *, first_value(doc_id) over w as kept_doc_id, first_value(start) over w as kept_start, first_value("end") over w as kept_end from k window w as (partition by md5(unit) order by doc_id nulls last, start, "end")),
g as (select *, coalesce(max(b) over (partition by rid order by a, b rows between unbounded preceding and 1 preceding) >= a, false) as joined from f where not (doc_id is not distinct from kept_doc_id and start = kept_start)),
h as (select *, sum((not joined)::int) over (partition by rid order by a, b rows unbounded preceding) as nth from g)
select doc_id, min(start) as start, max("end") as "end", (max(b) - min(a))::bigint as n_words, arg_min(kept_doc_id, a) as kept_doc_id, arg_min(kept_start, a) as kept_start, arg_min(kept_end, a) as kept_end from h group by rid, doc_id, nth"""
