import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import answering as A
from quire.operators import evaluation as E
from quire.operators import search as S
from quire.sources import models as M
from tests.test_layout import element


def hits(spark, rows):
    return spark.createDataFrame(rows, "question_id string, unit_id string, search_pos int, relevance double, pinned boolean")


def test_pinned_units_are_kept_first(spark):
    judged = hits(spark, [("q", "a", 1, 0.9, False), ("q", "b", 2, 0.8, False), ("q", "c", 3, 0.1, True), ("q", "d", 4, 0.8, False)])
    got = [(r.unit_id, r.rank) for r in S.pinned_top(judged, 2).orderBy("rank").collect()]
    assert got == [("a", 1), ("c", 2)]


def test_gate(spark):
    judged = hits(spark, [("q", "a", 1, 0.29, False), ("r", "a", 1, 0.30, False), ("s", "a", 1, 0.0, True)])
    assert {r.question_id: r.passes for r in S.gate(judged).collect()} == {"q": False, "r": True, "s": True}


def test_distinct_hits_ignore_case_accents_and_spaces(spark):
    rows = spark.createDataFrame([("q", "a", 1, "Tensión  x"), ("q", "b", 2, "tension X"), ("q", "c", 3, "other")], "question_id string, unit_id string, search_pos int, text string")
    assert sorted(r.unit_id for r in S.distinct_hits(rows, 5).collect()) == ["a", "c"]


@pytest.mark.parametrize("block,chunk", [(1024, 2048), (3, 7)])
def test_dense_top_equals_numpy(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    u, q = rng.normal(size=(200, 8)).astype(np.float32), rng.normal(size=(7, 8)).astype(np.float32)
    u[100:150] = u[:50]  # ties go by id
    units = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(u)] + [(900, None)], "unit_id int, dense array<float>")
    asked = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(q)], "question_id int, dense array<float>")
    got = {(r.question_id, r.pos): r.unit_id for r in S.dense_top(asked, units, 5).collect()}
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(float) @ (u / np.linalg.norm(u, axis=1, keepdims=True)).T
    want = {(i, k + 1): int(j) for i in range(7) for k, j in enumerate(sorted(range(200), key=lambda j: (-round(float(s[i, j]), 6), j))[:5])}
    assert got == want
    assert S.dense_top(asked.limit(0), units, 5).count() == 0 and S.dense_top(asked, units.limit(0), 5).count() == 0


def test_dense_top_keeps_vectors_where_they_are(spark):
    units = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "unit_id int, dense array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "question_id int, dense array<float>")
    plan = S.dense_top(asked, units, 3)._jdf.queryExecution().executedPlan().toString()
    assert "dense" not in plan[: plan.index("MapInArrow")] and plan.count("Exchange") == 1


@pytest.mark.parametrize("block,chunk", [(1024, 2048), (2, 3)])
def test_bm25_top_is_the_best_of_all_scores(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "CHUNK", chunk)
    words = "the the the pump valve oil насос клапан 油".split()
    units = spark.createDataFrame([(i, " ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 6))) for i in range(60)] + [(90, ""), (91, " .")], "unit_id int, text string")
    asked = spark.createDataFrame([(1, "the pump"), (2, "Насос, 油!"), (3, "absent"), (4, ""), (5, "oil oil the valve")], "question_id int, text string")
    got = {(r.question_id, r.pos): (r.unit_id, round(r.score, 9)) for r in S.bm25_top(asked, units, 4).collect()}
    every = S.bm25_scores(asked, units).collect()
    want = {}
    for q in {r.question_id for r in every}:
        best = sorted((r for r in every if r.question_id == q), key=lambda r: (-round(r.score, 9), r.unit_id))[:4]
        want |= {(q, n + 1): (r.unit_id, round(r.score, 9)) for n, r in enumerate(best)}
    assert got == want and {q for q, _ in got} == {1, 2, 5}


def test_dense_top_is_no_cross_join(spark):
    v = spark.createDataFrame([(1, [1.0])], "id int, dense array<float>")
    plan = S.dense_top(v.withColumnRenamed("id", "question_id"), v.withColumnRenamed("id", "unit_id"), 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_filter_comes_before_ranking(spark):
    units = spark.createDataFrame([("a", "d1", True), ("b", "d2", True), ("c", "d1", False)], "unit_id string, document_id string, visible boolean")
    assert [r.unit_id for r in S.searchable(units, documents=["d1"]).collect()] == ["a"]


def test_sources_and_images(spark):
    from quire.sources import schemas

    e = spark.createDataFrame(
        [element(1, text="Cap", kind="caption"), element(2, "image", image_key="k2", top=100, bottom=200), element(3, "image", image_key="k3", top=300, bottom=320), element(4, "table"), element(5, origin="recognized", confidence=0.5), element(6, "image", image_key="k6", is_decorative=True)],
        schemas.ELEMENTS,
    )
    cols = "question_id string, unit_id string, document_id string, unit_type string, text string, heading_path array<string>, pages array<int>, element_ids array<string>, figure_ids array<string>, boxes array<struct<page:int,left:double,top:double,right:double,bottom:double>>, rank int, relevance double, similarity double, citation_number int"
    judged = spark.createDataFrame(
        [
            ("q", "u1", "d", "text", "x" * 400, ["H"], [1], ["e5"], ["e3", "e2"], [(1, 72.0, 310.0, 540.0, 330.0)], 1, 0.9, 0.8, 1),
            ("q", "u2", "d", "table", "t", [], [1], ["e4"], ["e2", "e6"], [(1, 72.0, 100.0, 540.0, 120.0)], 2, 0.5, 0.7, None),
        ],
        cols,
    )
    names = spark.createDataFrame([("d", "manual.pdf")], "document_id string, document_name string")
    got = {r.unit_id: r for r in A.sources(judged, e, names).collect()}
    assert len(got["u1"].excerpt) == 300 and got["u1"].low_confidence_text and got["u1"].document_name == "manual.pdf"
    assert [t.page for t in got["u2"].tables] == [1] and got["u1"].tables is None and got["u2"].figure_ids == ["e2"]
    links = spark.createDataFrame([("d", "e1", "e2", "caption_of", None)], schemas.EDGES)
    shown = A.images(judged, e, links).orderBy("position").collect()
    assert [(r.element_id, r.is_primary, r.unit_id, r.caption) for r in shown] == [("e3", True, "u1", None), ("e2", False, "u1", "Cap")]
    assert A.uncited(A.sources(judged, e, names)).count() == 1
    with pytest.raises(Exception, match="element is missing"):
        A.sources(judged, e.where("id <> 'e4'"), names).collect()


def test_attribution_and_citation(spark):
    answers = spark.createDataFrame([("q", "The red pump needs oil. Blue valves stay shut."), ("r", "Marked already [1].")], "question_id string, answer string")
    supplied = spark.createDataFrame([("q", 1, "u1", "d", [1], "blue valves stay shut always"), ("q", 2, "u2", "d", [2], "the red pump needs oil daily"), ("r", 1, "u1", "d", [1], "other")], "question_id string, rank int, unit_id string, document_id string, pages array<int>, embedding_text string")
    got = {r.question_id: r for r in A.attribute(answers, supplied).collect()}
    assert got["q"].answer == "The red pump needs oil [2]. Blue valves stay shut [1]." and got["q"].attributed == 2
    assert got["r"].answer == "Marked already [1]." and got["r"].attributed == 0
    cited = {r.question_id: r for r in A.cite(spark.createDataFrame([(k, v.answer) for k, v in got.items()], "question_id string, answer string"), supplied).collect()}
    assert cited["q"].text == "The red pump needs oil [1]. Blue valves stay shut [2]."
    assert [c.unit_ids for c in cited["q"].citations] == [["u2"], ["u1"]]


def test_answer_path_outcomes(spark):
    units = spark.createDataFrame(
        [("u1", "d", "a.pdf", "Change the oil filter SPL-480 every year.", ["Care"], [3], True), ("u2", "d", "a.pdf", "Nothing of note.", [], [4], True)],
        "unit_id string, document_id string, document_name string, text string, heading_path array<string>, pages array<int>, visible boolean",
    ).withColumn("dense", M.embed(F.col("text")))
    questions = spark.createDataFrame([("q1", "change the oil filter", "en"), ("q2", "zebra migration distance", "es"), ("q3", "what is SPL-480", "en")], "question_id string, text string, language string")
    got = {r.question_id: r for r in A.answer_questions(questions, units).collect()}
    assert got["q1"].status == "answered" and got["q1"].citations[0].pages == [3]
    assert got["q2"].reason == "no_relevant_content" and got["q2"].text == T.MESSAGES["es"][1]
    assert got["q3"].status == "answered"
    none = A.answer_questions(questions, units, documents=["other"]).first()
    assert none.reason == "no_searchable_documents"


def test_answers_carry_sources_and_images(spark):
    from quire.sources import schemas

    e = spark.createDataFrame([element(1, text="The pump", kind="caption"), element(2, "image", image_key="k2", top=100, bottom=200), element(3, text="Change the oil filter every year.")], schemas.ELEMENTS)
    links = spark.createDataFrame([("d", "e1", "e2", "caption_of", None)], schemas.EDGES)
    names = spark.createDataFrame([("d", "a.pdf")], "document_id string, document_name string")
    units = spark.createDataFrame(
        [("u1", "d", "a.pdf", "Change the oil filter every year.", ["Care"], [1], True, "text", ["e3"], ["e2"], [(1, 72.0, 210.0, 540.0, 220.0)]), ("u2", "d", "a.pdf", "Nothing of note.", [], [1], True, "text", ["e3"], [], [])],
        "unit_id string, document_id string, document_name string, text string, heading_path array<string>, pages array<int>, visible boolean, unit_type string, element_ids array<string>, figure_ids array<string>, boxes array<struct<page:int,left:double,top:double,right:double,bottom:double>>",
    ).withColumn("dense", M.embed(F.col("text")))
    crops = spark.createDataFrame([("k2",)], "image_key string")
    known = spark.createDataFrame([("d",)], "id string")
    how = {"elements": e, "links": links, "names": names}
    got = A.ask(spark, " change the oil filter ", units, known, known, ["d"], crops=crops, **how).first()
    assert got.status == "answered" and [s.unit_id for s in got.sources][0] == "u1" and got.sources[0].citation_number == 1
    assert [(i.element_id, i.is_primary, i.caption) for i in got.images] == [("e2", True, "The pump")]
    with pytest.raises(A.MissingCrop, match="k2"):
        A.ask(spark, "change the oil filter", units, known, known, crops=crops.limit(0), **how).first()
    with pytest.raises(A.InvalidQuestion):
        A.ask(spark, "x", units, known, known.limit(0), ["d"])


def test_failures_of_models():
    assert {x.code for x in (M.Unavailable, M.Rejected, M.InvalidReply)} == {"provider_unavailable", "provider_rejected", "provider_invalid_reply"}
    with pytest.raises(M.Unavailable):
        M.post_json("http://127.0.0.1:1/none", {}, timeout=1)
    with pytest.raises(M.InvalidReply):
        M._batched(["a", "b"], lambda texts: [1], M.Retry())
    assert M._batched(["a", None, "b"], lambda texts: [t.upper() for t in texts], M.Retry()) == ["A", None, "B"]


def test_validation():
    assert A.validated("  x ", None) == ("x", None)
    for bad in ("", " ", "x" * 2001):
        with pytest.raises(A.InvalidQuestion):
            A.validated(bad)
    with pytest.raises(A.InvalidQuestion):
        A.validated("x", ["a", "a"])


def test_labelled_questions_are_read_and_checked(spark, tmp_path):
    import json

    from quire.sources.schemas import BrokenRule

    good = {"id": "1", "question": "what?", "language": "en", "label": "answerable", "expected_document": "a.pdf", "expected_pages": [3], "identifier": None}
    other = {"id": "2", "question": "why?", "language": "en", "label": "unrelated"}
    (tmp_path / "set.json").write_text(json.dumps([good, other]))
    assert {r.id: r.expected_pages for r in E.load_questions(spark, str(tmp_path / "set.json")).collect()} == {"1": [3], "2": None}
    (tmp_path / "bad.jsonl").write_text("\n".join(json.dumps(x) for x in (good, {**good, "expected_pages": []}, {**other, "label": "x"})))
    with pytest.raises(BrokenRule, match="question_form, question_id"):
        E.load_questions(spark, str(tmp_path / "bad.jsonl"))


def test_latency_by_exact_and_bounded_ranks(spark):
    rows = spark.range(1001).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("s"))
    assert tuple(E.latency(rows, "s", "k").first()) == ("a", 500.0, 950.0, 1000.0)
    near = E.latency(rows, "s", "k", accuracy=100).first()
    assert abs(near.p50 - 500) <= 11 and abs(near.p95 - 950) <= 11 and near["max"] == 1000.0


def test_shares_of_nothing_are_one(spark):
    rows = spark.createDataFrame([], "label string, reason string, status string, supplied boolean, identifier string")
    assert E.shares(rows).first().answerable_reaching_model == 1.0


def test_expected_pages(spark):
    outcomes = spark.createDataFrame([("1", [("a.pdf", [2, 3])]), ("2", [("b.pdf", [9])])], "question_id string, sources array<struct<document_name:string,pages:array<int>>>")
    questions = spark.createDataFrame([("1", "answerable", None, "a.pdf", [3]), ("2", "answerable", None, "a.pdf", [9])], "id string, label string, identifier string, expected_document string, expected_pages array<int>")
    assert {r.question_id: r.supplied for r in E.hits_expected(outcomes, questions).collect()} == {"1": True, "2": False}


def test_retry_gives_up_and_recovers():
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise M.Unavailable
        return x

    assert M.Retry(first=0.0).call(flaky, 5) == 5
    with pytest.raises(M.Unavailable):
        M.Retry(attempts=2, first=0.0).call(lambda: (_ for _ in ()).throw(M.Unavailable()))


def test_figures_after_an_outage_are_not_described(spark):
    def model(key, caption, context):
        if key == "k2":
            raise M.Unavailable
        return f"about {key}"

    figures = spark.createDataFrame([("1", "k1", None, None), ("2", "k2", None, None), ("3", "k3", None, None)], "id string, image_key string, caption string, context string").coalesce(1)
    got = {r.id: r.description_status for r in M.describe_figures(figures, model, retry=M.Retry(attempts=2, first=0.0)).collect()}
    assert got == {"1": "described", "2": "not_described", "3": "not_described"}


def test_vectors_of_words_are_made_at_once(monkeypatch):
    """Equal to the sum of what default_rng() gives each word, without a generator for each."""
    from hashlib import sha256

    from quire.functions import text as T
    from quire.sources import models as M

    monkeypatch.setattr(M, "WORDS", 40)
    texts = [" ".join(f"Wörd{i * j % 97}" for j in range(i)) for i in range(60)]
    want = []
    for t in texts:
        total = np.zeros(M.DIMENSIONS)
        for w in T.folded(t).split():
            total += np.random.default_rng(int.from_bytes(sha256(w.encode()).digest()[:8], "big")).normal(size=M.DIMENSIONS)
        n = np.linalg.norm(total)
        want.append((total / n if n else total).astype(np.float32).tolist())
    monkeypatch.setattr(np.random, "default_rng", None)
    assert M.hash_vectors(texts) == want and [M.hash_vector(t) for t in texts] == want
    assert len(M._newer) <= 40 and len(M._older) <= 40
