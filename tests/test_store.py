import random
import time

import pytest
from pyspark.sql import functions as F

from quire.sources import files as Fi
from quire.sources import items as It
from quire.sources import schemas
from quire.sources.store import StaleWriter, Store
from quire.streaming import jobs as J



def at(clock):
    return F.lit(f"2024-01-01 {clock}").cast("timestamp")


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"), buckets=4)
    s.create("units", "id string, document_id string, text string")
    return s


def docs(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "document_id string")


def test_nothing_shows_before_publishing(spark, store):
    store.write("units", spark.createDataFrame([("u1", "d1", "old"), ("u2", "d2", "x")], "id string, document_id string, text string"), 1)
    assert store.read("units").count() == 0
    store.publish(docs(spark, "d1", "d2"), 1)
    assert store.read("units").count() == 2
    store.write("units", spark.createDataFrame([("u3", "d1", "new")], "id string, document_id string, text string"), 2)
    assert store.read("units", ["d1"]).first().text == "old"
    store.publish(docs(spark, "d1"), 2)
    assert [r.text for r in store.read("units", ["d1"]).collect()] == ["new"]
    with pytest.raises(StaleWriter):
        store.publish(docs(spark, "d1"), 1)
    store.delete_documents(docs(spark, "d2", "unknown"))
    assert [r.id for r in store.read("units").collect()] == ["u3"]
    store.write("units", spark.createDataFrame([("u9", "d3", "not yet")], "id string, document_id string, text string"), 1, "b2")
    store.compact("units")
    assert sorted(r.id for r in store.raw("units").collect()) == ["u3", "u9"] and store.read("units").count() == 1
    store.publish(docs(spark, "d3"), 1, "b2")
    store.fold_pointers()
    assert sorted(r.id for r in store.read("units").collect()) == ["u3", "u9"]
    store.unpublish(docs(spark, "d3"))
    store.compact("units")
    assert store.raw("units").count() == 2 and store.read("units").count() == 1


def test_writing_again_is_harmless(spark, store):
    rows = spark.createDataFrame([("u1", "d1", "a")], "id string, document_id string, text string")
    for _ in range(2):
        store.write("units", rows, 1)
    store.publish(docs(spark, "d1"), 1)
    assert store.read("units").count() == 1


def test_blobs(spark, tmp_path):
    b = Fi.Blobs(spark, str(tmp_path / "blobs"))
    b.save("figures/d/e.png", b"\x00\xffabc")
    b.save("figures/d/e.png", b"new\xfe")
    assert b.read("figures/d/e.png") == b"new\xfe" and b.exists("figures/d/e.png")
    b.move("figures/d/e.png", "pages/1.png")
    assert not b.exists("figures/d/e.png")
    b.delete_tree("pages")
    b.delete("pages/none")
    assert not b.exists("pages/1.png")
    for bad in ("", "/x", "a/../b", "a//b", "a\\b"):
        with pytest.raises(Fi.InvalidKey):
            b.exists(bad)


def test_uploads(spark, tmp_path):
    (tmp_path / "ok.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Type /Page>> 2 0 obj <</Type/Page >> 3 0 obj <</Type /Pages>>")
    (tmp_path / "locked.pdf").write_bytes(b"%PDF-1.4 /Encrypt 5 0 R /Type /Page ")
    (tmp_path / "not.pdf").write_bytes(b"hello")
    got = {r.file_name: r for r in Fi.inspect_pdf(Fi.read_uploads(spark, str(tmp_path), "*.pdf")).withColumn("problem", Fi.upload_problem(max_bytes=1000)).collect()}
    assert got["ok.pdf"].page_count == 2 and got["ok.pdf"].problem is None
    assert got["locked.pdf"].problem == "encrypted_document" and got["not.pdf"].problem == "unsupported_media_type"


def plain_owned(rows):
    """rows(document, item, parent, kind, text, position): what stays, with the labels of images, by climbing one item at a time."""
    of = {(d, i): (p, k) for d, i, p, k, _, _ in rows}
    labels, gone = {}, set()
    for d, i, p, k, text, n in rows:
        seen = set()
        while k not in ("image", "table", "caption") and (d, p) in of and p not in seen:
            seen.add(p)
            if of[d, p][1] in ("image", "table"):
                gone.add((d, i))
                if of[d, p][1] == "image" and (text or "").strip():
                    labels.setdefault((d, p), []).append((n, text))
            p = of[d, p][0]
    return {(d, i): [t for _, t in sorted(labels.get((d, i), []))] for d, i, *_ in rows if (d, i) not in gone}


def test_ownership_of_any_depth_and_of_ways_that_lead_back(spark):
    rng = random.Random(3)
    kinds = ["paragraph"] * 6 + ["image", "table", "caption"]
    rows = []
    for d in range(40):
        n = rng.choice([1, 5, 20])
        rows += [(f"d{d}", f"i{i}", rng.choice([None, "lost", *(f"i{j}" for j in range(n))]), rng.choice(kinds), rng.choice([None, " ", "a", "b"]), i) for i in range(n)]
    rows += [("deep", f"i{i}", f"i{i - 1}" if i else None, "image" if i == 3 else "paragraph", f"t{i}", i) for i in range(100)]
    items = spark.createDataFrame(rows, "document_id string, item string, parent string, kind string, text string, position int").withColumn("label", F.lit(None).cast("string"))
    got = {(r.document_id, r.item): r.labels for r in It.owned(items).collect()}
    assert got == plain_owned(rows) and len(got["deep", "i3"]) == 96
    assert It.owned(items.limit(0)).count() == 0


def test_ownership_gathers_documents_once(spark, data):
    from quire.plans import catalogue

    plan = catalogue.QUERIES["nested_ownership"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_items_to_elements(spark):
    box = (0.0, 0.0, 9.0, 9.0)
    rows = [
        ("d", "p", None, "picture", None, 1, box, 0, None, None),
        ("d", "g", "p", "text", "group", 1, box, 1, None, None),
        ("d", "t", "g", "text", "label A", 1, box, 2, None, None),
        ("d", "c", "p", "text", "Figure 1", 1, box, 3, "p", None),
        ("d", "x", None, "text", "lost", None, None, 4, None, None),
        ("d", "m", None, "text", "one two", 1, box, 5, None, [(1, box, 0, 3), (2, box, 4, 7)]),
        ("d", "h", None, "section_header", "Head", 2, box, 6, None, [(1, box, 0, 99), (2, box, 1, 2)]),
    ]
    b = schemas.BOX
    items = spark.createDataFrame(rows, f"document_id string, item string, parent string, label string, text string, page int, box {b}, position int, caption_of string, spans array<struct<page:int,box:{b},start:int,end:int>>")
    got = It.numbered(It.fragments(It.owned(It.kinds(items)))).orderBy("reading_order").collect()
    assert [(r.item, r.kind, r.text, r.page) for r in got] == [("p", "image", None, 1), ("c", "caption", "Figure 1", 1), ("m", "paragraph", "one", 1), ("m", "paragraph", "two", 2), ("h", "heading", "Head", 2)]
    assert got[0].labels == ["group", "label A"]
    linked = It.caption_links(spark.createDataFrame([("d", "p", "image", None, "e0"), ("d", "c", "caption", "p", "e1")], "document_id string, item string, kind string, caption_of string, id string")).first()
    assert (linked.source_id, linked.target_id, linked.kind) == ("e1", "e0", "caption_of")


def test_rules(spark):
    jobs = spark.createDataFrame([("1", "d", "failed", None, 0, 0, 3), ("2", "e", "pending", None, 4, 0, 3), ("3", "e", "pending", None, 0, 0, 3)], "id string, document_id string, status string, failure_code string, attempt int, pages_done int, max_attempts int").withColumn("pages_total", F.lit(None).cast("int"))
    broken = {k for k, v in schemas.job_rules(jobs).items() if not v.isEmpty()}
    assert broken == {"one_active_job", "attempts", "failure_code"}
    with pytest.raises(schemas.BrokenRule, match="attempts"):
        schemas.require(schemas.job_rules(jobs))


JOB = schemas.JOBS


def test_job_life(spark):
    none = spark.createDataFrame([], JOB)
    d = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    log = spark.createDataFrame(J.enqueue(d, none, at("00:00:00")).collect(), JOB)
    assert log.count() == 2
    assert J.enqueue(d, log, at("00:00:00")).count() == 0
    later = at("00:00:10")
    claimed = J.claim(log, later).collect()
    assert len(claimed) == 1 and claimed[0].status == "processing" and claimed[0].attempt == 1
    log = log.unionByName(spark.createDataFrame(claimed, JOB))
    token = claimed[0].lease_token
    events = spark.createDataFrame([(claimed[0].id, "complete", "stale", None)], "id string, event string, token string, failure_code string")
    assert J.fenced(log, events, later).count() == 0
    done = J.fenced(log, events.withColumn("token", F.lit(token)), at("00:00:20")).collect()
    assert [r.status for r in done] == ["completed"] and done[0].lease_token is None
    # the lease of a job that stopped runs out: it is claimed again, and failed once its attempts are used up
    stuck = log.where("status = 'processing'").withColumn("attempt", F.lit(3))
    end = J.claim(stuck, at("01:00:00")).collect()
    assert [(r.status, r.failure_code) for r in end] == [("failed", "interrupted_repeatedly")]


def test_streams_register_once(spark, tmp_path):
    schema = "id string, sha256 string"
    source = tmp_path / "in"
    for n, rows in enumerate(([("1", "x"), ("2", "y")], [("3", "x"), ("4", "z"), ("5", "z")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        time.sleep(0.1)
        seen = []
        J.ingest_stream(spark.readStream.schema(schema).parquet(str(source)), str(tmp_path / "register"), str(tmp_path / "check"), lambda rows, k, seen=seen: seen.append(rows.count())).awaitTermination()
        assert sum(seen) == (2 if n == 0 else 1)
    got = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "register"))
    assert sorted(r.sha256 for r in got.collect()) == ["x", "y", "z"]


def test_lease_states(spark, tmp_path):
    schema = "id string, event string, at timestamp"
    spark.sql("select '1' as id, 'claim' as event, timestamp '2024-01-01 00:00:00' as at union all select '1', 'complete', timestamp '2024-01-01 00:00:05' union all select '2', 'claim', timestamp '2024-01-01 00:00:01'").coalesce(1).write.parquet(str(tmp_path / "events"))
    out = J.lease_states(spark.readStream.schema(schema).parquet(str(tmp_path / "events")))
    q = out.writeStream.format("memory").queryName("leases").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            got = {r.id: r.status for r in spark.sql("select * from leases").collect()}
            if len(got) == 2:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert got == {"1": "completed", "2": "processing"}


def test_slots():
    s = J.Slots(running=1, waiting=0)
    with s.admit():
        with pytest.raises(J.Busy):
            with s.admit():
                pass
    with s.admit():
        pass


def test_deadline(spark):
    assert J.within(spark, 60, lambda: spark.range(5).count()) == 5


def test_blob_tables(spark, tmp_path):
    path = str(tmp_path / "blobs")
    Fi.save_blobs(spark.createDataFrame([("pages/d/1.png", bytearray(b"a")), ("pages/d/2.png", bytearray(b"b"))], "key string, content binary"), path, buckets=4)
    Fi.save_blobs(spark.createDataFrame([("pages/d/1.png", bytearray(b"c"))], "key string, content binary"), path, buckets=4)
    assert {r.key: bytes(r.content) for r in Fi.load_blobs(spark, path, ["pages/d/1.png", "none"], buckets=4).collect()} == {"pages/d/1.png": b"c"}
    pages = spark.createDataFrame([("d", 1), ("d", 3)], "document_id string, page int")
    assert [r.page for r in Fi.pages_without_image(pages, Fi.load_blobs(spark, path)).collect()] == [3]
    with pytest.raises(Exception, match="unsafe key"):
        Fi.save_blobs(spark.createDataFrame([("../x", bytearray(b"a"))], "key string, content binary"), path)


def test_extraction(spark):
    def lines(content):
        if content.startswith(b"!"):
            raise ValueError("partial")
        for i, line in enumerate(content.decode().split("\n")):
            yield f"i{i}", None, "text", line, 1, {"left": 0.0, "top": 0.0, "right": 1.0, "bottom": 1.0}, i, None, None

    files = spark.createDataFrame([("a", bytearray(b"x\ny")), ("b", bytearray(b"!")), ("c", bytearray(b" \n"))], "document_id string, content binary")
    got = It.extract(files, lines)
    assert {r.document_id: r.failure_code for r in It.failures(got).collect()} == {"b": "corrupt_document", "c": "no_extractable_text"}
    kept = It.numbered(It.fragments(It.kinds(It.succeeded(got))))
    assert [(r.text, r.reading_order) for r in kept.orderBy("reading_order").collect()] == [("x", 0), ("y", 1)]
