import uuid

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import ids as I
from quire.functions import text as T
from quire.functions import vectors as V


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_exact_folding(spark):
    assert one(spark, T.fold(F.col("t")), t="Tensión STRASSE Straße ﬁn") == "tension strasse strasse fin"


def test_sentences(spark):
    assert one(spark, T.split_sentences(F.col("t")), t="  One. Two? Three 4.5 end!  ") == ["One.", "Two?", "Three 4.5 end!"]
    assert one(spark, T.split_sentences(F.col("t")), t="   ") == []


def test_question_identifiers(spark):
    got = one(spark, T.question_identifiers(F.col("t")), t="what of spl-480, 2-71. tensión 12 a1 and x/9-b?")
    assert sorted(got) == ["2-71", "spl-480", "x/9-b"]


@pytest.mark.parametrize("title,level", [("4 Start", 1), ("4.2.1. Wiring", 3), ("1.2.3.4.5.6.7 Deep", 6), ("2024 Report", None), ("Plain", None)])
def test_section_level(spark, title, level):
    assert one(spark, T.section_level(F.col("t")), t=title) == level


def test_header_rules(spark):
    table = "|a|b|\n|---|---|\n|1|2|"
    assert one(spark, T.strip_header(F.col("t")), t=table) == "|1|2|"
    assert one(spark, T.strip_header(F.col("t")), t="no table") == "no table"
    row = spark.range(1).select(F.array(F.array(F.lit("Part  No"), F.lit("Code"))).alias("a"), F.array(F.array(F.lit("part no"), F.lit("CODE"))).alias("b"))
    assert row.select(T.repeats_header(F.col("a"), F.col("b")).alias("x")).first().x


def test_page_runs(spark):
    assert one(spark, T.page_runs(F.array(*map(F.lit, (9, 3, 4, 3)))), z=1) == "pages 3–4, 9"
    assert one(spark, T.source_label(F.lit("a.pdf"), F.array(F.lit(12))), z=1) == "Source: a.pdf, page 12"


def test_figure_text_and_labels(spark):
    labels, captions = F.array(F.lit("A1"), F.lit("B2")), F.array(F.lit("Cap"), F.lit(""))
    assert one(spark, T.figure_text(captions, labels, F.lit(None).cast("string")), z=1) == "Cap\nA1 B2"
    assert one(spark, T.figure_text(F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit("")), z=1) is None


def test_unverified_identifiers(spark):
    got = one(spark, T.unverified_identifiers(F.lit("Bolt V-12 and 12v and 5-3431 near V-12 or 77"), F.array(F.lit("x v-12")), F.lit(None).cast("string")), z=1)
    assert got == ["12v", "5-3431"]


def test_citations():
    sources = [("u1", "d1", (1,)), ("u2", "d1", (1,)), ("u3", "d2", (2, 3))]
    text, cited = T.resolved("A [3]. B [1, 2] c [[9]] d 【1】 e [2-7].", sources)
    assert text == "A [1]. B [2] c d [2] e [2][1]."
    assert [(c["number"], c["unit_ids"]) for c in cited] == [(1, ["u3"]), (2, ["u1", "u2"])]


@pytest.mark.parametrize("text,want", [("a [9, 2] b", "a[1] b"), ("[1][1] [1]", "[1] [1]"), ("x [1] [9][2]", "x [1][2]"), ("[3-1] [1-2-3]", " [1][2]"), ("[0] [ 1] [a]", " [ 1] [a]"), ("", ""), ("[[2]][2], [1]", "[1], [2]"), ("[1, 1–2]", "[1][2]")])
def test_marker_forms(text, want):
    assert T.resolved(text, [("u1", "d1", (1,)), ("u2", "d2", (2,))])[0] == want


def test_statements_and_markers(spark):
    text = "First of all here. And one more thing!\n1.\nLast line without stop"
    ends = [(s["end"], i + 1) for i, s in enumerate(T.statements_of(text))]
    rows = spark.createDataFrame([(text, ends), (text, None), ("né à trois: mots!", [(17, 2), (17, 1)])], "t string, m array<struct<end:int,number:int>>")
    got = [r.x for r in rows.select(T.insert_markers(F.col("t"), F.col("m")).alias("x")).collect()]
    assert got == ["First of all here [1]. And one more thing [2]!\n1.\nLast line without stop [3]", text, "né à trois: mots [1] [2]!"]


def test_statements_end_at_sentences_and_lines():
    got = T.statements_of("  One two three.  Four five! six seven eight \r\nv1.2 is out now? yes\n\na-b c_d e")
    assert [s["text"] for s in got] == ["One two three.", "six seven eight", "v1.2 is out now?", "a-b c_d e"]


def test_message_falls_back_to_english(spark):
    assert one(spark, T.message(F.lit("no_relevant_content"), F.lit("fr")), z=1) == T.MESSAGES["en"][1]


def test_uuid5_equals_the_standard(spark):
    got = spark.range(200).select(F.concat(F.lit("é:"), F.col("id").cast("string")).alias("n")).select("n", I.uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(I.NAMESPACE, r.n)) for r in got)


@pytest.mark.parametrize("key,safe", [("a/b.png", True), ("/a", False), ("a/../b", False), ("a//b", False), ("a\\b", False), ("", False)])
def test_safe_keys(spark, key, safe):
    assert one(spark, I.is_safe_key(F.col("k")), k=key) is safe


def test_geometry(spark):
    a, b = G.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)), G.box(F.lit(13), F.lit(14), F.lit(20), F.lit(20))
    assert one(spark, G.gap(a, b), z=1) == 5.0
    assert one(spark, G.column_gap(a, F.lit(1), b, F.lit(1)), z=1) is None
    assert one(spark, G.area(a), z=1) == 100.0


def test_vectors(spark):
    a, zero = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert abs(one(spark, V.cosine(a, a), z=1) - 1) < 1e-12
    assert one(spark, V.cosine(a, zero), z=1) == 0.0
    assert one(spark, V.relevance_of_logprobs(F.lit(-1.0), F.lit(None).cast("double")), z=1) == 1.0
    with pytest.raises(Exception, match="neither answer"):
        one(spark, V.relevance_of_logprobs(F.lit(None).cast("double"), F.lit(None).cast("double")), z=1)


def test_folding_of_every_character_without_python(spark):
    """All code points, alone and within a text, and texts of many kinds; no Python in the plan."""
    import random
    import sys

    r = random.Random(11)
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, codes[i : i + 500])) for i in range(0, 0x3000, 500)] + ["".join(chr(r.choice(codes[:0xC000])) for _ in range(40)) for _ in range(300)]
    special = [c for c in codes if T.folded(chr(c)) != chr(c)]
    texts += [chr(c) for c in special] + ["".join(map(chr, special[i : i + 97])) for i in range(0, len(special), 97)] + ["", "Straße ǅ ﬁ", "한국어 ABC", "İstanbul", "a\x01b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = df.select("i", T.fold(F.col("t")).alias("f"))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    found = {x.i: x.f for x in got.collect()}
    assert found.pop(-1) is None
    wrong = [(t, found[i], T.folded(t)) for i, t in enumerate(texts) if found[i] != T.folded(t)]
    assert not wrong, wrong[:5]


def test_statements_are_found_in_bounded_parts(monkeypatch):
    import pyarrow as pa

    held, of = [], T.statements_of
    monkeypatch.setattr(T, "STATEMENT_ROWS", 3)
    monkeypatch.setattr(T, "statements_of", lambda x: held.append(x) or of(x))
    texts = ["One two three. Four five six!", None, "", "a", "x y z\nu v w"] * 2
    got = T._find_statements(pa.array(texts))
    assert got.to_pylist() == [None if x is None else of(x) for x in texts] and len(held) == 8
    assert len(T._find_statements(pa.array([], pa.string()))) == 0
