"""Quality rules with risk-controlled cutoffs. DataFrame and SQL functions only.

Signals are counted over whole texts. Each rule compares one signal with a cutoff of a fixed grid. The labelled documents of
quality 1 that the base rule keeps are the holdout of their stratum (the language), dealt into two parts by a hash of the id.
The first part (5 of 16) proposes: for each rule the strictest cutoff of the grid that rejects at most TARGET of it, and
from these a path of LEVELS steps, on which all rules go together from their laxest cutoff to the proposed one. The second
part decides, from the laxest step on, whether a step is safe: the exact binomial tail P(X <= k), X ~ Bin(n, RISK), is at
most ERROR over the number of strata, k of n being the good documents that any of the step's rules rejects. The first step
that is not safe ends the path and the last safe one holds. A path that is fixed before its tests needs no correction along
the way, and that of Bonferroni over the strata makes all hold at once: with probability 95 % no stratum loses more than 5 %
of the good documents that the base rule keeps to the rules together. (What the base rule itself rejects is given by the
contract and outside of this bound.) A stratum without enough labelled documents to prove its first step (about 85 with four
strata) gets no such rules.

Nulls and odd input: a null text has no words; a null language is the stratum of the empty one; repeated rows are judged
each; labels that repeat or contradict count once, with the lowest quality; a null doc_id is never labelled; extra columns
are ignored; empty tables give an empty result, and without labels only the base rule holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import materialize, sized_broadcast, table

WINDOW = 8
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
RISK, ERROR, TARGET, LEVELS = 0.05, 0.05, 0.005, 4
#: First digits of the MD5 of an id that deal a labelled document to the part that proposes.
PROPOSES = "01234"
#: Rule -> (signal, its base, factor, cutoffs from lax to strict, whether low values are rejected):
#: rejected if factor * signal > cutoff * base (or < it).
RULES = {
    "symbols": ("n_symbols", "n_words", 1000, (2000, 1000, 500, 300, 200, 100, 50, 20, 10), False),
    "repeats": ("n_repeat_words", "n_words", 1000, (250, 200, 150, 100, 50, 20), False),
    "lines": ("n_dup_lines", "n_words", 1000, (50, 20, 10, 5, 2, 1), False),
    "long_words": ("word_chars", "n_words", 100, (2000, 1500, 1200, 1000, 900, 800), False),
    "short_words": ("word_chars", "n_words", 100, (200, 250, 300, 350, 400), True),
}


def _count(text: Column, chars: str) -> Column:
    """Occurrences of one-byte characters."""
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c))) for c in chars), F.lit(0)).cast("long")


def signals(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), text.alias("text"), F.trim(text, F.lit(SPACES)).alias("core"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    d = d.select(
        "doc_id",
        "stratum",
        (F.length("text") - _count(F.col("text"), SPACES)).alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"),
        lines.alias("lines"),
        F.when(F.col("core") == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split("core", r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))).alias("h1"),
    )
    d = d.select("doc_id", "stratum", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("h1").cast("long").alias("n_words"), "h1")
    at = 1
    while at < WINDOW:  # hashes of windows of twice the length, from pairs of those at hand
        a, left = f"h{at}", F.size(f"h{at}") - at
        d = d.withColumn(f"h{2 * at}", F.when(left > 0, F.zip_with(F.slice(a, 1, left), F.slice(a, at + 1, left), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))).drop(a)
        at *= 2
    h = f"h{WINDOW}"
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    d = d.withColumn("sorted", F.when(repeats, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))).drop(h)
    same = lambda p, j, k: F.coalesce(F.get("sorted", j + k)["x"] == p["x"], F.lit(False))
    d = d.withColumn("at", F.sort_array(F.transform(F.filter("sorted", lambda p, j: same(p, j, -1) | same(p, j, 1)), lambda p: p["i"]))).drop("sorted")
    covered = F.aggregate("at", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n")), lambda s: s["n"])
    return d.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))


def _rule_sql(rule: str, cutoff) -> str:
    signal, base, factor, _, low = RULES[rule]
    return f"{signal} * {factor} {'<' if low else '>'} {cutoff} * {base}"


def _rejects(rule: str, cutoff: Column) -> Column:
    signal, base, factor, _, low = RULES[rule]
    a, b = F.col(signal) * factor, cutoff * F.col(base)
    return (a < b) if low else (a > b)


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _any(cuts: dict[str, Column]) -> Column:
    """Whether any rule rejects; a null cutoff rejects nothing."""
    rejected = F.lit(False)
    for r, cut in cuts.items():
        rejected = rejected | F.coalesce(_rejects(r, cut), F.lit(False))
    return rejected


def paths(proposing: DataFrame, target: float = TARGET, levels: int = LEVELS) -> DataFrame:
    """proposing: signals of good documents -> one row per stratum and level: level and cut_<rule>, null where even the laxest
    cutoff rejects too many."""
    tried = [F.count_if(F.expr(_rule_sql(r, c))).alias(f"{r}_{i}") for r, (_, _, _, grid, _) in RULES.items() for i, c in enumerate(grid)]
    counts = proposing.groupBy("stratum").agg(F.count("*").alias("n"), *tried)
    # stricter cutoffs reject more, so those that reject few enough are the first ones of the grid
    reach = [sum((F.col(f"{r}_{i}") <= target * F.col("n")).cast("int") for i in range(len(RULES[r][3]))).alias(f"reach_{r}") for r in RULES]
    steps = counts.select("stratum", *reach).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    cut = lambda r: F.get(F.array(*(F.lit(c) for c in RULES[r][3])), F.floor((F.col(f"reach_{r}") - 1) * F.col("level") / levels).cast("int"))
    return steps.select("stratum", "level", *(F.when(F.col(f"reach_{r}") > 0, cut(r)).alias(f"cut_{r}") for r in RULES))


def cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR, target: float = TARGET, levels: int = LEVELS) -> DataFrame:
    """labelled(doc_id, ...): signals of good documents that the base rule keeps -> one row per stratum with a safe step: the
    number of its documents that decided, those rejected, and cut_<rule>."""
    first = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1).isin(*PROPOSES)
    proposed = materialize(paths(labelled.where(first), target, levels), "paths")
    strata = proposed.select("stratum").distinct().count()
    tested = labelled.where(~first).join(sized_broadcast(proposed), "stratum")
    cuts = [f"cut_{r}" for r in RULES]
    rejected = F.sum(_any({r: F.col(f"cut_{r}") for r in RULES}).cast("long")).alias("k")
    steps = tested.groupBy("stratum", "level", *cuts).agg(F.count("*").alias("n"), rejected)
    # log of the binomial terms by recurrence; beyond the mean the tail is about a half or more, and cannot pass
    tail = f"""aggregate(sequence(0, cast(k as int)), struct(cast(0 as double) as p, n * ln(1 - {risk}) as t),
        (s, i) -> struct(s.p + exp(s.t) as p, s.t + ln((n - i) / (i + 1)) + ln({risk} / (1 - {risk})) as t), s -> s.p)"""
    safe = F.expr(f"case when k > {risk} * n then false else {tail} <= {error} / {max(strata, 1)} end")
    # a step holds if all up to it are safe: the number of safe steps up to it is its own number
    upto = W.partitionBy("stratum").orderBy("level")
    held = steps.withColumn("safe", F.sum(safe.cast("int")).over(upto)).where("safe = level")
    best = held.groupBy("stratum").agg(F.max_by(F.struct("level", "n", "k", *cuts), "level").alias("b"))
    return best.select("stratum", "b.*")


def apply_rules(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """docs(doc_id, text, lang), labels(doc_id, quality) -> signals, base_failed, kept and the cutoffs that held."""
    found = materialize(signals(docs).withColumn("base_failed", _base_failed()), "signals")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    labelled = materialize(found.where(~F.col("base_failed")).join(good, "doc_id", "left_semi"), "labelled")
    cuts = sized_broadcast(materialize(cutoffs(labelled, **how).drop("n", "k"), "cutoffs"))
    judged = found.join(cuts, "stratum", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & ~_any({r: F.col(f"cut_{r}") for r in RULES}))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    space = r"[\x20\x09-\x0D]"
    tried = ", ".join(f"count(*) filter ({_rule_sql(r, c)}) as {r}_{i}" for r, (_, _, _, grid, _) in RULES.items() for i, c in enumerate(grid))
    reach = ", ".join(" + ".join(f"({r}_{i} <= {TARGET} * n)::int" for i in range(len(RULES[r][3]))) + f" as reach_{r}" for r in RULES)
    cuts = ", ".join(f"case when reach_{r} > 0 then [{', '.join(map(str, RULES[r][3]))}][((reach_{r} - 1) * level // {LEVELS})::int + 1] end as cut_{r}" for r in RULES)
    names = ", ".join(f"cut_{r}" for r in RULES)
    rejected = " or ".join(f"coalesce({_rule_sql(r, f'cut_{r}')}, false)" for r in RULES)
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '{space}+'), lambda x: x <> '') as ws from d),
win as (select rid, unnest(range(1, len(ws) - {WINDOW - 2})) as i, unnest(list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: array_to_string(ws[i:i+{WINDOW - 1}], ' '))) as g from w where len(ws) >= {WINDOW}),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c > 1),
cov as (select rid, count(distinct i + j) as n_repeat_words from rep, range({WINDOW}) t(j) group by rid),
ln as (select rid, unnest(string_split(text, chr(10))) as l from d),
dup as (select rid, count(*) - count(distinct l) as n_dup_lines from ln where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by rid),
sg as (select w.rid, doc_id, stratum, len(ws)::bigint as n_words, length(regexp_replace(text, '{space}', '', 'g'))::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join dup on w.rid = dup.rid left join cov on w.rid = cov.rid),
sig as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from sg),
good as (select *, substr(md5(doc_id::varchar), 1, 1) in ({', '.join(f"'{x}'" for x in PROPOSES)}) as proposes from sig where not base_failed and doc_id in (select doc_id from labels group by doc_id having min(quality) = 1)),
counts as (select stratum, count(*) as n, {tried} from good where proposes group by stratum),
reached as (select stratum, {reach} from counts),
path as (select stratum, level, {cuts} from reached, range(1, {LEVELS} + 1) r(level)),
step as (select stratum, level, {names}, count(*) as n, count(*) filter ({rejected}) as k from good join path using (stratum) where not proposes group by stratum, level, {names}),
tail as (select *, k <= {RISK} * n and (select sum(exp(lgamma(n + 1) - (case when i = 0 then 0 else lgamma(i + 1) end) - (case when i = n then 0 else lgamma(n - i + 1) end) + i * ln({RISK}) + (n - i) * ln(1 - {RISK}))) from range(k + 1) s(i)) <= {ERROR} / (select count(*) from counts) as safe from step),
held as (select * from (select *, sum(safe::int) over (partition by stratum order by level) as n_safe from tail) where n_safe = level qualify row_number() over (partition by stratum order by level desc) = 1),
b as (select sig.*, {names} from sig left join held on sig.stratum = held.stratum)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({rejected}) as kept from b"""


OP7_SQL = _sql()
