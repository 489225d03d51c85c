"""op12: against its SQL on the tables and a plain count on small texts."""

import random
import re
from collections import Counter

from quire.llm.collocations import OP12_SQL, collocations, op12_collocations, scored


def plain(rows, least, percent, top, max_n=5):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(lower)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, max_n + 1) for i in range(len(words) - k + 1))
    often = {g: c for g, c in counts.items() if len(g[1]) > 1 and c >= least}
    within = lambda a, b: any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1))
    by = {}
    for (lang, words), a in often.items():
        if any(o == lang and len(w) > len(words) and 100 * c >= percent * a and within(words, w) for (o, w), c in often.items()):
            continue
        cuts = [(1000 * a * total[lang] // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        by.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]]))
    return sorted((lang, n, p.decode(), -a, left, right, total[lang], -s) for lang, found in by.items() for n, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def test_equals_sql(spark, duck, data, same_rows):
    same_rows(op12_collocations(spark, data).toPandas(), duck.execute(OP12_SQL).df())


def test_equals_plain_counts(spark):
    r = random.Random(5)
    vocabulary = ["New", "new", "york", "Ünit", "ünit", "of", "the", "und", " x", "a-b", "…"]
    rows = [(" ".join(r.choice(vocabulary) + r.choice(["", "", "", ".", ",\t", "\n", "\x0b"]) for _ in range(r.randrange(60))), r.choice(["en", "und", None])) for _ in range(60)]
    rows += [("new york new york new york city", "en")] * 7 + [("", "en"), (None, None), (" \t.\n", "xx"), ("of the new york\r\nof  the\tnew york", None)] * 3
    df = spark.createDataFrame(rows, "text string, lang string")
    for least, percent, top in ((3, 100, 1000), (5, 60, 9)):
        assert rows_of(collocations(df, least=least, percent=percent, top=top)) == plain(rows, least, percent, top)


def test_one_text_in_most_rows_and_one_long_text(spark):
    rows = [("all the same words here", "en")] * 3000 + [("go on " * 20_000, "en")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    assert rows_of(collocations(df)) == plain(rows, 100, 100, 2000)


def test_products_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a b", ["a", "b"], 7 * 10**15), ("en", "a", ["a"], 9 * 10**15), ("en", "b", ["b"], 8 * 10**15)], "lang string, phrase string, words array<string>, f long")
    totals = spark.createDataFrame([("en", 3 * 10**17 + 1)], "lang string, n long")
    (row,) = scored(found, totals).collect()
    assert row["score"] == 1000 * 7 * 10**15 * (3 * 10**17 + 1) // (72 * 10**30)


def test_empty_and_clashing_columns(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    df = spark.createDataFrame([("a b c", "en", "x", 1, 2)] * 4, "text string, lang string, words string, f int, times int")
    assert [r["phrase"] for r in collocations(df, least=2).collect()] == ["a b c"]
