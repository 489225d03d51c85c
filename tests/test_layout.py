"""Layout operators on small documents, and unit packing against a plain sequential version."""

import random

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import layout as Y
from quire.sources import lines as L
from quire.sources import schemas


def element(order, kind="paragraph", page=1, top=100.0, bottom=120.0, columns=(72.0, 540.0), document="d", **more):
    row = {c.split(" ")[0]: None for c in schemas.ELEMENTS.replace("array<array<string>>", "x").split(", ")}
    row |= {"id": f"e{order}", "document_id": document, "kind": kind, "page": page, "bbox_left": columns[0], "bbox_right": columns[1], "bbox_top": float(top), "bbox_bottom": float(bottom), "reading_order": order, "origin": "text_layer", "text": f"text {order}", "labels": [], "unverified_identifiers": [], "is_decorative": False}
    if kind == "heading":
        row["heading_level"] = 1
    if kind == "table":
        row |= {"table_rows": [["Part", "Code"], [f"row {order}", "A-1"]], "text": f"|Part|Code|\n|---|---|\n|row {order}|A-1|"}
    return row | more


def frame(spark, rows):
    return spark.createDataFrame(rows, schemas.ELEMENTS)


def edges(spark, rows=()):
    return spark.createDataFrame([("d", s, t, k, None) for s, t, k in rows], schemas.EDGES)


def sizes(spark, *pages):
    return spark.createDataFrame([("d", p, 612.0, 792.0) for p in pages], schemas.PAGE_SIZES)


def pairs(df):
    return sorted((r.source_id, r.target_id, r.kind) for r in df.collect())


def test_captions_take_the_closest_free_target(spark):
    e = frame(spark, [element(0, "image", top=100, bottom=200), element(1, "caption", top=210, bottom=220), element(2, "image", top=230, bottom=300), element(3, "caption", top=305, bottom=315)])
    assert pairs(Y.caption_links(e, edges(spark))) == [("e1", "e0", "caption_of"), ("e3", "e2", "caption_of")]


def test_caption_across_a_page_break(spark):
    e = frame(spark, [element(0), element(1, "table", top=600, bottom=700), element(2, "page_furniture", page=2, top=10, bottom=20), element(3, "caption", page=2, top=40, bottom=60)])
    assert pairs(Y.caption_links(e, edges(spark))) == [("e3", "e1", "title_of")]


def test_linked_captions_and_other_columns_are_left_alone(spark):
    e = frame(spark, [element(0, "image", columns=(72.0, 290.0)), element(1, "caption", columns=(320.0, 540.0)), element(2, "caption", columns=(72.0, 290.0), top=125, bottom=130)])
    assert pairs(Y.caption_links(e, edges(spark, [("e2", "e0", "caption_of")]))) == []


def test_near_text_is_the_closest_in_the_column(spark):
    e = frame(spark, [element(0, top=10, bottom=40), element(1, "image", top=100, bottom=200), element(2, top=210, bottom=230), element(3, top=205, bottom=208, columns=(700.0, 800.0))])
    got = Y.near_links(e, edges(spark)).collect()
    assert [(r.source_id, r.target_id) for r in got] == [("e2", "e1")]
    assert abs(got[0].score - (1 - 10 / 72)) < 1e-12


def test_near_text_of_a_caption_on_the_next_page(spark):
    e = frame(spark, [element(0, "image", top=600, bottom=700), element(1, "caption", page=2, top=40, bottom=60), element(2, page=2, top=70, bottom=90)])
    assert pairs(Y.near_links(e, edges(spark, [("e1", "e0", "caption_of")]))) == [("e2", "e0", "near")]


def test_tables_continue(spark):
    rows = [element(0, "table", top=600, bottom=750), element(1, "page_furniture", page=2, top=5, bottom=20), element(2, "caption", page=2, top=30, bottom=40, text="Table 1 (continued)"), element(3, "table", page=2, top=50, bottom=200)]
    got = Y.continuation_links(frame(spark, rows), edges(spark, [("e2", "e3", "title_of")]), sizes(spark, 1, 2)).collect()
    assert [(r.source_id, r.target_id, r.score) for r in got] == [("e3", "e0", 1.0)]
    interrupted = [*rows[:1], element(1, page=2, top=20, bottom=30), rows[3]]
    assert Y.continuation_links(frame(spark, interrupted), edges(spark), sizes(spark, 1, 2)).count() == 0


def test_outline_levels(spark):
    rows = [("d", 0, 0, "Book", 1), ("d", 1, 1, "Setup", 2), ("d", 2, 2, "Setup", 2), ("d", 3, 3, "Wiring.", 3), ("d", 4, 1, "Care", 9)]
    outline = spark.createDataFrame(rows, "document_id string, position int, depth int, title string, page int")
    headings = spark.createDataFrame([("d", "a", "SETUP", 2), ("d", "b", "wiring", 7), ("d", "c", "3.1 Other", 4), ("d", "e", "None", 4)], "document_id string, id string, text string, page int")
    got = {r.id: r.level for r in Y.heading_levels(headings, outline).collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "e": 1}


def test_triage(spark):
    rows = [element(i, "image", page=i + 1, top=100, bottom=300, image_key=f"k{i}") for i in range(4)] + [element(9, "image", page=1, top=0, bottom=10, image_key="k9"), element(10, "image", page=1, top=300, bottom=600, image_class="logo", image_key="k10")]
    hashes = spark.createDataFrame([("e0", "x"), ("e1", "x"), ("e2", "x"), ("e3", "y"), ("e9", "z"), ("e10", "w")], schemas.IMAGE_HASHES)
    pages = spark.createDataFrame([("d", 20)], "document_id string, total int")
    got = {r.id: (r.is_decorative, r.to_describe, r.description_status) for r in Y.triage(frame(spark, rows), hashes, sizes(spark, 1, 2, 3, 4), pages).collect()}
    assert got == {"e0": (True, False, "skipped"), "e1": (True, False, "skipped"), "e2": (True, False, "skipped"), "e3": (False, True, None), "e9": (False, False, "skipped"), "e10": (True, False, "skipped")}


def test_units_of_a_small_document(spark):
    rows = [
        element(0, "heading", text="Guide"),
        element(1, text="Intro words"),
        element(2, "table", page=1, top=600, bottom=700),
        element(3, "table", page=2, top=20, bottom=90),
        element(4, "image", page=2, top=100, bottom=300, labels=["A1"], image_key="k"),
        element(5, "caption", page=2, top=310, bottom=320, text="Figure 1"),
        element(6, page=2, top=330, bottom=350, text="Near the figure"),
    ]
    links = edges(spark, [("e3", "e2", "continues"), ("e5", "e4", "caption_of"), ("e6", "e4", "near")])
    got = {r.unit_key: r for r in Y.build_units(frame(spark, rows), links).collect()}
    assert set(got) == {"text:e1", "table:e2", "figure:e4", "text:e6"}
    assert got["table:e2"].text == "|Part|Code|\n|---|---|\n|row 2|A-1|\n|row 3|A-1|"
    assert got["table:e2"].pages == [1, 2] and got["table:e2"].heading_path == ["Guide"]
    assert got["figure:e4"].text == "Figure 1\nA1" and got["figure:e4"].element_ids == ["e4", "e5"]
    assert got["text:e6"].figure_ids == ["e4"]


def packed(texts, limit):
    """Plain version for paragraphs without headings."""
    count = lambda t: len(t.split())
    out, open_ = [], []
    for t in texts:
        if not t:
            continue
        if count("\n".join([*open_, t])) <= limit:
            open_.append(t)
            continue
        if open_:
            out.append("\n".join(open_))
        open_ = []
        if count(t) <= limit:
            open_ = [t]
            continue
        piece = []
        for s in (s for s in __import__("re").split(r"(?<=[.!?])\s+", t.strip()) if s):
            if piece and count(" ".join([*piece, s])) > limit:
                out.append(" ".join(piece))
                piece = []
            piece.append(s)
        out.append(" ".join(piece))
    return out + (["\n".join(open_)] if open_ else [])


def test_packing_equals_the_plain_version(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for d in range(12):
        texts = [" ".join(rng.choice(["a", "b.", "c!", "dd"]) for _ in range(rng.choice([0, 3, 8, 30]))) for _ in range(15)]
        want[f"d{d}"] = packed(texts, 12)
        rows += [element(i, document=f"d{d}", id=f"d{d}:{i}", text=t) for i, t in enumerate(texts)]
    got = {}
    for r in Y.build_units(frame(spark, rows), edges(spark), max_tokens=12).collect():
        got.setdefault(r.document_id, []).append((r.element_ids, r.unit_key, r.text))
    order = lambda u: (int(u[0][0].split(":")[1]), int(u[1].split(":")[-1]) if u[1].count(":") > 2 else 0)
    assert {d: [u[2] for u in sorted(us, key=order)] for d, us in got.items()} == want


def test_links_of_line_elements(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    e = L.line_elements(docs)
    assert not any(not v.isEmpty() for k, v in schemas.element_rules(e).items())
    links = Y.link_elements(e, L.no_links(e), L.page_sizes(e))
    assert {r.kind for r in links.select("kind").distinct().collect()} == {"caption_of", "near", "continues"}
    assert schemas.edge_rules(links)["unique"].isEmpty()


def test_description_context(spark):
    e = frame(spark, [element(0, "image"), element(1, "caption", text="Cap"), element(2, text="Near")])
    got = Y.description_context(e, edges(spark, [("e1", "e0", "caption_of"), ("e2", "e0", "near")])).first()
    assert (got.caption, got.context) == ("Cap", "Near")


def test_continued_caption(spark):
    got = spark.createDataFrame([("Tabla 2 (continuación)",), ("Table 2 cont. here",), ("Contents",), (None,)], "t string").select(T.is_continued(F.col("t")).alias("x"))
    assert [r.x for r in got.collect()] == [True, True, False, False]


def test_a_very_deep_outline_is_one_fold(spark):
    rows = [("d", i, i, f"t{i}", 1) for i in range(3000)] + [("e", i, d, t, 1) for i, (d, t) in enumerate([(0, "Root"), (2, "A"), (7, "A"), (7, "B"), (1, "C"), (0, "Last")])]
    df = spark.createDataFrame(rows, "document_id string, position int, depth int, title string, page int")
    got = {(r.document_id, r.position): r.level for r in Y.outline_levels(df).collect()}
    assert [got.get(("d", i)) for i in (0, 1, 6, 2999)] == [None, 1, 6, 6]
    assert [got["e", i] for i in range(6)] == [1, 2, 2, 3, 2, 1]
    plan = Y.outline_levels(df)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000


def test_sequential_steps_take_bounded_parts_and_exchange_no_cells(spark, monkeypatch):
    monkeypatch.setattr(Y, "DOCUMENTS", 2)
    rows = spark.createDataFrame([(f"d{i % 7}", i) for i in range(28)], "document_id string, n int")
    got = Y.per_document(rows, "n", lambda doc, members: [(doc, [m["n"] for m in members])], "document_id string, ns array<int>").collect()
    assert {r.document_id: r.ns for r in got} == {f"d{i}": [i, i + 7, i + 14, i + 21] for i in range(7)}
    from quire.sources import lines as L

    e = L.line_elements(spark.createDataFrame([(1, "a\nb")], "doc_id int, text string"))
    plan = Y.continuation_links(e, L.no_links(e), L.page_sizes(e))._jdf.queryExecution().optimizedPlan().toString()
    assert "table_rows" not in plan.split("Window")[0]
