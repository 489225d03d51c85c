"""Classifier, quality rules, personal data, mixing, line dedup and sharding on odd rows and against plain versions."""

import random
import re
import time
import zlib
from collections import Counter
from math import comb, exp

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import classifier as C
from quire.llm import line_dedup as D
from quire.llm import mixing as M
from quire.llm import pii as P
from quire.llm import quality_rules as Q
from quire.llm import sharding as H


# Classifier


def test_classifier_learns_and_scores(spark, odd, none):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("***" if i % 4 == 0 else "") for _ in range(40)), int(i % 4 > 0)) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    model = C.train(docs, labels)
    scored = {r.doc_id: r for r in docs.select("doc_id", C.held_out(F.col("doc_id")).alias("out"), C.score(F.col("text"), model).alias("score")).collect()}
    out = [(scored[i].score, q) for i, _, q in rows if scored[i].out]
    assert out and sum((s >= 0.3) == q for s, q in out) / len(out) > 0.97
    again = C.train(docs, labels)
    assert np.array_equal(model.margin, again.margin) and model.bias == again.bias
    scores = [r.s for r in odd.select(C.score(F.col("text"), model).alias("s")).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert C.keep_good(odd, labels).columns == odd.columns
    assert C.keep_good(none, labels).count() == 0
    assert C.train(docs, labels.limit(0)).score(0, 0) == 0.5


def test_score_is_the_softmax_of_the_average(spark):
    rng = np.random.default_rng(2)
    model = C.Model(rng.normal(size=C.BUCKETS).astype(np.float32), 0.3)
    scorer = C.Scorer(model)
    for text in ("", "a", "a a b " + "z" * 100 + " b b " + "z" * 100, "one two " * 50):
        f, s = C.text_features(text.encode())
        want = model.score(float(sum(model.margin[i] * w for i, w in zip(f, s))), 1.0 if f else 0)
        assert abs(scorer(text.encode()) - want) < 1e-6


def test_fit_is_gradient_descent_on_the_softmax(monkeypatch):
    """The fit and its margin against a plain version that keeps vectors and outputs apart, number by number."""
    from math import exp as e, log

    monkeypatch.setattr(C, "BUCKETS", 12)
    monkeypatch.setattr(C, "DIMENSIONS", 3)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(8):
        f = rng.choice(12, 4, replace=False)
        shares = rng.dirichlet(np.ones(4))
        rows.append((int(rng.integers(2)), f.astype(np.int32), shares.astype(np.float32)))
    rows[0], rows[1] = (0, *rows[0][1:]), (1, *rows[1][1:])
    steps, rate = 60, 0.5
    got = C.fit(rows, steps, rate, 3)
    draw = np.random.default_rng(3)
    v = [[float(x) for x in r] for r in draw.uniform(-1 / 3, 1 / 3, (12, 3)).astype(np.float32)]
    order = np.concatenate([draw.permutation(8) for _ in range(8)])[:steps]
    out, bias = [[0.0, 0.0] for _ in range(3)], [0.0, 0.0]

    def forward(f, s):
        mean = [sum(float(w) * v[i][d] for i, w in zip(f, s)) for d in range(3)]
        z = [sum(mean[d] * out[d][c] for d in range(3)) + bias[c] for c in (0, 1)]
        total = sum(e(x) for x in z)
        return mean, [e(x) / total for x in z]

    losses = []
    for step, i in enumerate(order):
        y, f, s = rows[i]
        mean, p = forward(f, s)
        losses.append(-log(p[y]))
        lr, p[y] = rate * (1 - step / steps), p[y] - 1
        down = [out[d][0] * p[0] + out[d][1] * p[1] for d in range(3)]
        for d in range(3):
            for c in (0, 1):
                out[d][c] -= lr * mean[d] * p[c]
        for c in (0, 1):
            bias[c] -= lr * 0.1 * p[c]
        for j, w in zip(f, s):
            for d in range(3):
                v[j][d] -= lr * float(w) * down[d]
    for y, f, s in rows:
        assert abs(forward(f, s)[1][1] - got.score(float(sum(got.margin[i] * w for i, w in zip(f, s))), 1.0)) < 1e-4
    assert sum(losses[-8:]) < sum(losses[:8])


def test_held_out_documents_are_told_apart(spark):
    """Area under the curve over labelled documents that the fit never saw."""
    place = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{place}/{t}.parquet") for t in ("documents", "labels"))
    scored = C.op3_quality_classifier(spark, place).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in scored if r.quality == q] for q in (1, 0))
    assert good and bad and sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad) > 0.97
    assert sum((r.predicted == r.quality) for r in scored) / len(scored) > 0.95


def test_held_out_is_the_checksum(spark):
    got = spark.range(200).select("id", C.held_out(F.col("id")).alias("x")).collect()
    assert all(r.x == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


# Quality rules


def plain_signals(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_signals(odd, none):
    got = sorted(((r.doc_id is None, r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.signals(odd).collect()), key=str)
    want = sorted(((r.doc_id is None, r.doc_id, *plain_signals(r.text)) for r in odd.collect()), key=str)
    assert got == want
    assert Q.signals(none).count() == 0


SIGNALS = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def plain_cutoffs(rows, strata):
    """The procedure of the docstring, stratum by stratum."""
    from hashlib import md5

    def rejects(r, c, x):
        signal, base, factor, _, low = Q.RULES[r]
        a, b = x[signal] * factor, c * x[base]
        return a < b if low else a > b

    out = {}
    for s in strata:
        mine = [dict(zip([c.split()[0] for c in SIGNALS.split(", ")], x)) for x in rows if x[1] == s]
        first = [x for x in mine if md5(str(x["doc_id"]).encode()).hexdigest()[0] in Q.PROPOSES]
        rest = [x for x in mine if x not in first]
        reach = {r: sum(sum(rejects(r, c, x) for x in first) <= Q.TARGET * len(first) for c in Q.RULES[r][3]) for r in Q.RULES}
        for level in range(1, Q.LEVELS + 1):
            cuts = {r: Q.RULES[r][3][(n - 1) * level // Q.LEVELS] for r, n in reach.items() if n}
            n, k = len(rest), sum(any(rejects(r, c, x) for r, c in cuts.items()) for x in rest)
            if sum(comb(n, i) * Q.RISK**i * (1 - Q.RISK) ** (n - i) for i in range(k + 1)) > Q.ERROR / len(strata):
                break
            out[s] = (level, n, k, *(cuts.get(r) for r in Q.RULES))
    return out


def test_cutoffs_are_those_of_the_procedure(spark):
    """Strata in which all steps are safe, the path ends early, the first step fails, and there are too few documents."""
    rng = np.random.default_rng(0)
    rows = []
    for s, n, share, rate in (("clean", 600, 0.001, 12), ("mixed", 900, 0.03, 30), ("violating", 900, 0.3, 3000), ("few", 60, 0.0, 0)):
        for _ in range(n):
            # what rejects too many in the part that decides, and few in the part that proposes
            rows.append((len(rows), s, 1000, int(rng.integers(4200, 7900)), int(rate if rng.random() < share else 0), int(rng.random() < share / 4), 0))
    strata = ["clean", "mixed", "violating", "few"]
    got = {r.stratum: tuple(r)[1:] for r in Q.cutoffs(spark.createDataFrame(rows, SIGNALS)).collect()}
    want = plain_cutoffs(rows, strata)
    assert got == want and "clean" in want and "few" not in want


def test_a_path_ends_at_the_first_step_that_is_not_safe(spark):
    from hashlib import md5

    rows = []
    for i in range(900):
        proposes = md5(str(i).encode()).hexdigest()[0] in Q.PROPOSES
        rows.append((i, "s", 1000, 5000, 0 if proposes or i % 10 else 60, 0, 0))  # a tenth of the deciding part at 60 symbols
    want = plain_cutoffs(rows, ["s"])
    got = {r.stratum: tuple(r)[1:] for r in Q.cutoffs(spark.createDataFrame(rows, SIGNALS)).collect()}
    assert got == want and 0 < want["s"][0] < Q.LEVELS and want["s"][3] > 60


def test_false_rejections_keep_to_the_risk(spark):
    """Many strata of random signals: rarely does one lose more than the risk of its whole population."""
    rng = np.random.default_rng(3)
    rows, share = [], {}
    for s in range(40):
        share[s] = rng.uniform(0.0, 0.12)  # of documents that only the strictest cutoff rejects
        rows += [(len(rows) + i, str(s), 1000, 5000, 15 if rng.random() < share[s] else 0, 0, 0) for i in range(400)]
    got = {int(r.stratum): r.cut_symbols for r in Q.cutoffs(spark.createDataFrame(rows, SIGNALS)).collect()}
    assert not [s for s, c in got.items() if c is not None and c < 15 and share[s] > Q.RISK]
    assert sum(c is not None and c < 15 for c in got.values()) > 0


def test_rules_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, None), (10, None, 1)], "doc_id long, quality int, toxic int")
    got = Q.apply_rules(odd, labels).collect()
    assert len(got) == odd.count() and all(r.kept is not None and not (r.kept and r.base_failed) for r in got)
    assert Q.apply_rules(none, labels).count() == 0 and Q.apply_rules(odd, labels.limit(0)).count() == odd.count()


def test_rules_run_without_python(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    plan = Q.apply_rules(odd, labels)._jdf.queryExecution().toString() + Q.signals(odd)._jdf.queryExecution().toString() + H.shard_rows(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Personal data


def plain_spans(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and P.luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b.", "@", "@@", ".", "..", "-", "+", "1", "12", "255", "256", "9.9.9.9", " ", "(", ")", "4111111111111111", "4111 1111 1111 1111", "+1 (555) 555-1234", "x@y.z", "0", "é", "_", "%"]
    for _ in range(8000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert P.plain_spans(t) == plain_spans(t)


@pytest.mark.parametrize(
    "text,span",
    [
        ("mail john.doe (at) mail (dot) com now", "john.doe (at) mail (dot) com"),
        ("to john at example dot com please", "john at example dot com"),
        ("jоhn@mаil.com ok", "jоhn@mаil.com"),
        ("call plus one five five five one two three four five six seven today", "plus one five five five one two three four five six seven"),
        ("4１11 1111 1111 1111", "4１11 1111 1111 1111"),
        ("ip 10 dot 0 dot 0 dot 1 x", "10 dot 0 dot 0 dot 1"),
        ("10[.]0[.]0[.]1", "10[.]0[.]0[.]1"),
        ("écrire à jean arobase exemple point fr vite", "jean arobase exemple point fr"),
    ],
)
def test_disguises_map_back(text, span):
    base, every = P.find(text)
    assert [text[s:e] for s, _, e in every if (s, _, e) not in base] == [span]


@pytest.mark.parametrize("text", ["look at the dot on it", "meet us at example.com", "one two three go", "see (at) noon.", "at 5 dot com"])
def test_plain_prose_is_left_alone(text):
    assert P.find(text) == ([], [])


def disguised_identifier(rng):
    """(kind, text, whether it is disguised): an identifier whose signs and characters are disguised at random."""
    blank = lambda least: "".join(rng.choice(" \t\n") for _ in range(rng.randrange(least, 4)))
    word = lambda words: rng.choice([w.upper() if rng.random() < 0.2 else w for w in words.split("|")])

    def sign(words, plain):
        how = rng.random()
        if how < 0.3:
            return plain
        if how < 0.6:
            return blank(1) + word(words) + blank(1)
        return blank(0) + rng.choice("([{<") + blank(0) + rng.choice([plain, word(words)]) + blank(0) + rng.choice(")]}>") + blank(0)

    def odd(text):
        other = {v: k for k, v in P.ALIKE.items() if v not in "-.@"}
        def one(c):
            how = rng.random()
            if how < 0.1 and c in other:
                return other[c]
            if how < 0.15 and c.isalnum():
                return chr(ord(c) + 0xFEE0)
            return c + "\u200b" if how < 0.18 and c.isalnum() else c
        return "".join(map(one, text))

    dot, kind = (lambda: sign(P.DOT_WORDS, ".")), rng.choice(["email", "ip", "phone"])
    plain = rng.random() < 0.3
    if kind == "email":
        labels = [rng.choice(["mail", "x-1", "example"]) for _ in range(rng.randrange(1, 3))]
        text = odd("john.doe") + sign(P.AT_WORDS, "@") + "".join(odd(x) + dot() for x in labels) + rng.choice(P.DOMAINS)
    elif kind == "ip":
        octets = [str(rng.randrange(256)) for _ in range(4)]
        spelled = lambda x: " ".join(P.DIGIT_WORDS[0].split()[int(c)] for c in x) if rng.random() < 0.2 else odd(x)
        text = "".join(spelled(x) + d for x, d in zip(octets, [dot(), dot(), dot(), ""]))
    else:
        words = [rng.choice(P.DIGIT_WORDS).split()[c] if rng.random() < 0.4 and not plain else str(c) for c in (rng.randrange(10) for _ in range(rng.randrange(10, 15)))]
        words[0] = words[0] if plain else "one"
        text = rng.choice(["plus ", "más "] if plain else ["+", "+ ", "plus ", "más "]) + rng.choice([" ", "-"] if plain else [" ", ", ", "-"]).join(words)
    return kind, text.rstrip("\u200b")


def test_planted_disguises_are_found_whole():
    """Thousands of random disguises in prose: each is found as one span from its first character to its last, whatever else
    the text holds, and the prose around adds nothing."""
    rng = random.Random(11)
    prose = ["look at the dot on it,", "meet us at noon.", "point de vue", "one or two of three;", "un deux", "see (at) noon.", "it is 5 dot", "ok"]
    n = 0
    for _ in range(4000):
        kind, text = disguised_identifier(rng)
        if P.plain_spans(text):
            continue
        before, behind = rng.choice(prose) + rng.choice(["; ", " | "]), rng.choice([" | ", ";\n"]) + rng.choice(prose)
        base, every = P.find(before + text + behind)
        assert base == [] and {(s, e) for s, _, e in every} == {(len(before), len(before) + len(text))}, (kind, text)
        assert P.KINDS.index(kind) in {k for _, k, _ in every}
        n += 1
    assert n > 2500
    for _ in range(500):
        assert P.find(" ".join(rng.choice(prose) for _ in range(8))) == ([], [])


def test_spans_do_not_depend_on_other_text():
    rng = random.Random(12)
    for _ in range(200):
        parts = [disguised_identifier(rng)[1] for _ in range(3)]
        text, want, at = "", [], 0
        for x in parts:
            want += [(s + len(text), k, e + len(text)) for s, k, e in P.find(x)[1]]
            text += x + " |;| "
        assert P.find(text)[1] == want


@pytest.mark.parametrize("part", [" ", "(at) ", "(at)", "one ", "( ", "at ", "a@", "1.", "+1 ", "+", "plus ", "one" + " " * 1000, "\u00e9 (at", "1-", "1.1.1.1 one dot two dot three dot four ", "a@b.c x(at)y.com "])
def test_time_is_linear(part):
    """A megabyte of one thing; (at) and blanks once took hours."""
    began = time.process_time()
    P.find(part * (1_000_000 // len(part)))
    P.find("x (at)" + part * (500_000 // len(part)) + "(dot) com")
    assert time.process_time() - began < 8


@pytest.mark.parametrize("text,base", [("10.0.0.1 one two", "10.0.0.1"), ("+1 555 123 4567 one", "+1 555 123 4567")])
def test_plain_numbers_are_not_lengthened(text, base):
    assert [text[s:e] for s, _, e in P.find(text)[1]] == [base]


def test_pii_odd_rows(odd, none):
    rows = odd.collect()
    got = P.find_pii(odd).collect()
    assert len(got) == len(rows) and sum(r.n_email for r in got) == sum(sum(k == 0 for _, k, _ in plain_spans(r.text or "")) for r in rows)
    masked = P.mask_pii(odd)
    assert masked.columns == odd.columns
    assert not any(plain_spans(r.text) for r in masked.collect() if r.text)
    assert P.find_pii(none).count() == 0 and P.mask_pii(none).count() == 0


# Mixing


def test_mixing_follows_the_distribution(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 9).alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    got = M.mix(docs, weights={"a": 0.5, "b": 0.5}).collect()
    per = Counter(r.doc_id for r in got)
    rate = {r.source: r.rate for r in got}
    assert rate == pytest.approx({"a": 2.0, "b": 2 / 3})
    for source, ids in (("a", range(0, 4000, 4)), ("b", [i for i in range(4000) if i % 4])):
        counts = [per.get(i, 0) for i in ids]
        lam = rate[source]
        for k in range(3):
            p = exp(-lam) * lam**k / [1, 1, 2][k]
            assert abs(counts.count(k) / len(counts) - p) < 4 * (p / len(counts)) ** 0.5
    assert sorted((r.doc_id, r.copy) for r in M.mix(docs.repartition(7), weights={"a": 0.5, "b": 0.5}).collect()) == sorted((r.doc_id, r.copy) for r in got)


def test_large_means_are_split(spark):
    docs = spark.createDataFrame([(1, "x", "a"), (2, "y" * 4000, "b")], "doc_id long, text string, source string")
    n = Counter(r.doc_id for r in M.mix(docs, weights={"a": 0.5, "b": 0.5}).collect())
    assert 850 < n[1] < 1150


def test_mixing_odd_rows(odd, none):
    got = M.mix(odd)
    assert got.columns == [c for c in odd.columns if c != "rate"] + ["rate", "copy", "shuffle_key"]
    clash = odd.withColumns({c: F.lit("mine") for c in ("row", "draws", "cdf", "us", "copies", "_source", "copy", "bytes", "weight")})
    plain, other = (sorted((str(r.doc_id), str(r.text), r.copy, r.shuffle_key) for r in M.mix(x).collect()) for x in (odd, clash))
    assert plain == other and {r.cdf for r in M.mix(clash).collect()} == {"mine"} and plain
    assert M.mix(none).count() == 0
    assert M.mix(odd, weights={}).count() == 0


# Line dedup


def plain_units(text, least=40, spread=4, most=32):
    """Units by their definition, word by word."""
    m = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x[0]).encode() for x in m]
    n = len(w)
    line = [i == n - 1 or "\n" in text[m[i].end() : m[i + 1].start()] for i in range(n)]
    low = lambda i, k: i < n - 1 and all(w[i] < y for y in w[i + 1 : i + k + 1]) and all(w[i] <= y for y in w[max(0, i - k) : i])
    ends = [line[i] or m[i][0][-1] in ".!?" or low(i, 1) for i in range(n)]
    out, held = [], 0
    for i in range(n):
        if i == 0 or line[i - 1] or low(i - 1, spread):
            held = i
        if i + least < n and (i - held) % most == 0 or i + least == n:
            b = next((j + 1 for j in range(i + least - 1, min(n, i + least + most)) if ends[j]), i + least + most)
            out.append((m[i].start(), m[b - 1].end(), i, b - i, " ".join(x.decode() for x in w[i:b])))
    return out


def test_units_are_as_defined(odd_rows):
    rng = random.Random(11)
    words = ["Der", "die", "ünd", "a.", "b!", "zoo", "x", "Über", "q?", "mm"]
    texts = ["".join(rng.choice(words[: rng.randrange(1, 11)]) + rng.choice([" ", "  ", "\n", " \n ", "\t"]) for _ in range(rng.randrange(300))) for _ in range(150)]
    texts += [r[1] or "" for r in odd_rows] + ["one " * 500, "\n\n" + "a b " * 100]
    for t in texts:
        got, want = D.text_units(t.encode()), plain_units(t)
        assert [g[:4] for g in got] == [x[:4] for x in want]
        assert [g[4] for g in got] == [D.md5(x[4].encode()).digest() for x in want]


def test_line_dedup(odd, none):
    rows = odd.collect()
    seen, again = {}, {}
    units = sorted(((r.doc_id is None, r.doc_id or 0, s, e, d, r.doc_id, a, a + n, r.text) for r in rows for s, e, a, n, d in plain_units(r.text or "")), key=lambda x: x[:4])
    for _, _, s, e, d, doc, a, b, text in units:
        first = seen.setdefault(d, (doc, s, e))
        if first[:2] != (doc, s):
            again.setdefault((doc, text), []).append((a, b, s, e, first))
    want = set()
    for (doc, _), found in again.items():
        found.sort()
        while found:
            run = [found.pop(0)]
            while found and found[0][0] <= max(x[1] for x in run):
                run.append(found.pop(0))
            want.add((doc, run[0][2], max(x[3] for x in run), max(x[1] for x in run) - run[0][0], *run[0][4]))
    got = [tuple(r) for r in D.repeats(odd).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    cut = D.drop_repeats(odd).collect()
    texts = {r.doc_id: r.text for r in rows}
    assert len(cut) == len(rows)
    for r in cut:
        if r.doc_id is not None and r.text is not None:
            assert r.text == "".join(texts[r.doc_id][s.start : s.end] for s in r.kept_spans)
    left = {r.doc_id: r.text for r in cut}
    assert texts[3] == texts[4]
    assert left[3] == texts[3] and left[4] == "" and len(left[11]) < len(texts[11])
    clash = odd.withColumns({"kept_spans": F.lit(1), "cuts": F.lit(2), "row": F.lit(3), "key": F.lit(4), "cut": F.lit(5)})
    assert sorted((str(r.doc_id), str(r.text)) for r in D.drop_repeats(clash).collect()) == sorted((str(r.doc_id), str(r.text)) for r in cut)
    assert D.repeats(none).count() == 0 and D.drop_repeats(none).count() == 0


def test_passages_inside_lines_are_found_and_chance_is_not(spark):
    """Passages of 51 to 90 words, put anywhere into prose without regard to lines: found whatever stands around them."""
    rng = random.Random(4)
    prose = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice("rstlmn") + rng.choice(["", "", "", "", "."]) for _ in range(n)]
    rows, planted = [], set()
    for i in range(200):
        passage = prose(rng.randrange(51, 91))
        for k in (0, 1):
            words = prose(rng.randrange(100, 200))
            at = rng.randrange(len(words))
            rows.append((2 * i + k, " ".join(words[:at] + passage + words[at:])))
            if k:
                planted.add((2 * i + 1, len(passage)))
        rows.append((1000 + i, " ".join(prose(300))))
    got = {r.doc_id: r for r in D.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) <= {i for i, _ in planted}
    assert len(got) / len(planted) > 0.97
    assert all(got[i].kept_doc_id == i - 1 and got[i].n_words <= n + 2 for i, n in planted if i in got)


# Sharding


@pytest.mark.parametrize("n", [0, 1, 2, 5, 24, 30, 1000])
def test_shards(spark, n):
    docs = spark.range(n).select((F.col("id") * 7).alias("doc_id"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    got = H.shard_rows(docs).collect()
    assert len(got) == n
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.size == len(f"é{r.doc_id // 7}".encode()) + 8 and r.text_crc32 == zlib.crc32(f"é{r.doc_id // 7}".encode())
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(k, [])) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1
    if n == 1000:
        again = H.shard_rows(docs.repartition(5)).collect()
        assert sorted(got) == sorted(again)
        assert sorted(range(n), key=lambda i: 0) != [r.doc_id // 7 for r in sorted(got, key=lambda r: (r.slot, r.shard))]


def plain_place(number, rows, key=H.KEY, rounds=H.ROUNDS):
    """Feistel with cycle walking, by its definition."""
    from hashlib import md5
    from math import isqrt

    side = isqrt(rows - 1) + 1
    while True:
        left, right = divmod(number, side)
        for i in range(1, rounds + 1):
            left, right = right, (left + int(md5(f"{key}:{i}:{right}".encode()).hexdigest()[:15], 16)) % side
        number = left * side + right
        if number < rows:
            return number


@pytest.mark.parametrize("n", [1, 2, 3, 25, 300])
def test_shards_are_those_of_the_plain_permutation(spark, n):
    docs = spark.range(n).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    got = {r.doc_id // 3: (r.row_number, r.shard, r.slot) for r in H.shard_rows(docs.repartition(3)).collect()}
    assert sorted(plain_place(i, n) for i in range(n)) == list(range(n))
    assert got == {i: (i, plain_place(i, n) % H.SHARDS, plain_place(i, n) // H.SHARDS) for i in range(n)}


def test_shards_of_odd_rows(odd):
    got = H.shard_rows(odd).collect()
    assert len(got) == odd.count() and sorted(r.row_number for r in got) == list(range(len(got)))
    assert sum(r.doc_id is None for r in got) == 2
