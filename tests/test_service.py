"""The whole way of a document: upload, job, ingestion, question, deletion."""

import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import ingestion as N
from quire.operators import relational as R
from quire.operators import service as S
from quire.sources import files as Fi
from quire.sources import items as It
from quire.sources import models as M
from quire.streaming import jobs as J


def pdf(text, more=b""):
    return b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n%TEXT " + text.encode() + more


def parse(content):
    """A stand-in for a layout parser: lines behind %TEXT, "# " for headings, "!" an image."""
    text = content.split(b"%TEXT ", 1)[1].decode()
    if text.startswith("BROKEN"):
        raise ValueError("cannot be read")
    for i, line in enumerate(text.split("\n")):
        label = "section_header" if line.startswith("# ") else "picture" if line == "!" else "caption" if line.startswith("Figure") else "text"
        box = {"left": 72.0, "top": 30.0 * i, "right": 500.0, "bottom": 30.0 * i + (125 if line == "!" else 25)}
        yield f"i{i}", None, label, line.removeprefix("# "), 1, box, i, None, None


@pytest.fixture
def library(spark, tmp_path):
    return S.Library(spark, str(tmp_path / "library"), lambda files: It.extract(files, parse), describe=lambda key, caption, context: f"A drawing of pump P-12 ({caption})", crops=lambda e: e.where("kind = 'image'").select(F.col("id").alias("element_id"), F.sha2("id", 256).alias("sha256")))


def test_a_document_from_upload_to_deletion(spark, library):
    text = "# Care\nChange the oil filter SPL-480 every year.\n!\nFigure 1\nKeep the pump dry."
    first = library.submit("C:\\manuals\\pump.pdf", [pdf(text)[:20], pdf(text)[20:]], "request-7")
    again = library.submit("copy.pdf", [pdf(text)])
    broken, blank = library.submit("broken.pdf", [pdf("BROKEN")]), library.submit("blank.pdf", [pdf(" ")])
    assert (first.decision, again.decision, again.document_id) == ("new_job", "in_progress", first.document_id)
    assert library.job(first.job_id).correlation_id == "request-7"
    with pytest.raises(S.Refused, match="document_busy"):
        library.delete(first.document_id)
    assert library.worker().work() == 3
    job = library.get(first.document_id).job
    assert job.status == "completed" and job.summary.images == 1 and job.summary.figures_described == 1 and job.summary.retrieval_units > 0
    assert [(library.job(x.job_id).status, library.job(x.job_id).failure_code) for x in (broken, blank)] == [("failed", "corrupt_document"), ("failed", "no_extractable_text")]
    assert library.submit("broken.pdf", [pdf("BROKEN")]).decision == "new_job"
    elements, more = library.elements(first.document_id, limit=3)
    assert [e.kind for e in elements] == ["heading", "paragraph", "image"] and more
    assert elements[2].description.startswith("A drawing") and elements[2].unverified_identifiers == ["P-12"]
    assert [x.kind for x in elements[2].edges] and library.elements(first.document_id, cursor=more)[0][0].kind == "caption"
    page, _ = library.list(limit=2)
    assert len(page) == 2
    got = library.question("what is SPL-480")
    assert got.status == "answered" and got.sources[0].document_name == "pump.pdf" and got.citations[0].document_id == first.document_id
    with pytest.raises(R.NotFound):
        library.figure(first.document_id, elements[2].id)
    library.blobs.save(elements[2].image_key, b"png")
    library.blobs.save(f"pages/{first.document_id}/1.png", b"page")
    assert library.figure(first.document_id, elements[2].id) == b"png" and library.page_image(first.document_id, 1) == b"page"
    library.delete(first.document_id)
    assert library.store.read("units").count() == 0 and not library.blobs.exists(elements[2].image_key)
    with pytest.raises(R.NotFound):
        library.get(first.document_id)
    assert library.question("what is SPL-480").reason == "no_searchable_documents"


def test_uploads_that_are_refused_leave_nothing(spark, library):
    for name, content, code in (("a.pdf", b"", "empty_file"), ("b.pdf", b"hello", "unsupported_media_type"), ("c.pdf", pdf("x", b" /Encrypt 5 0 R"), "encrypted_document")):
        with pytest.raises(S.Refused) as e:
            library.submit(name, [content])
        assert e.value.code == code
    with pytest.raises(S.Refused, match="file_too_large"):
        S.stage_upload(library.blobs, [b"x" * 60, b"y" * 60], most=100)
    path = library.blobs.jvm.org.apache.hadoop.fs.Path(library.blobs.root)
    files = path.getFileSystem(library.blobs.conf).listFiles(path, True)
    assert not files.hasNext()


def test_a_run_that_fails_shows_nothing_and_is_tried_again(spark, tmp_path):
    library = S.Library(spark, str(tmp_path / "l"), lambda files: It.extract(files, parse))
    one = library.submit("a.pdf", [pdf("Some words here.")])

    def down(*_):
        raise M.Unavailable("no model")

    broken = N.Worker(library.log, down)
    assert broken.step() == 1 and library.job(one.job_id).failure_code == "provider_unavailable"
    assert library.store.read("units").count() == 0
    second = library.submit("a.pdf", [pdf("Some words here.")])
    assert second.decision == "new_job" and second.job_id != one.job_id
    assert library.worker().work() == 1 and library.store.read("units").count() == 1


def test_progress_is_fenced(spark, library):
    one = library.submit("a.pdf", [pdf("Some words here.")])
    claimed = library.log.append(J.claim(library.log.rows(), F.current_timestamp())).first()
    assert claimed.id == one.job_id and claimed.started_at is not None
    event = spark.createDataFrame([(one.job_id, "advance", claimed.lease_token, None, "embedding", 3), (one.job_id, "advance", "stale", None, "indexing", 9)], "id string, event string, token string, failure_code string, stage string, pages_done int")
    library.log.append(J.fenced(library.log.rows(), event, F.current_timestamp()))
    job = library.job(one.job_id)
    assert (job.stage, job.pages_done, job.status) == ("embedding", 3, "processing")
    assert J.until_terminal(lambda: "completed") == "completed" and J.until_terminal(lambda: "pending", 0.01, 0.05) == "pending"


def test_pages_in_compressed_objects_are_counted():
    inner = b"5 0 6 40 <</Type /Page /Contents 8 0 R>> <</Type /Page /Contents 9 0 R>> <</Title (Care) /Parent 3 0 R>>"
    packed, shown = zlib.compress(inner), zlib.compress(b"BT (Hello) Tj ET")
    content = b"%PDF-1.5\n4 0 obj <</Type /ObjStm /Filter /FlateDecode>> stream\n" + packed + b"\nendstream endobj\n8 0 obj <</Filter /FlateDecode>> stream\n" + shown + b"\nendstream endobj\n9 0 obj <<>> stream\nq Q\nendstream endobj"
    assert Fi.pdf_facts(content) == (True, False, 2, 1, ["Care"])
    assert Fi.pdf_facts(b"") == (False, False, None, 0, []) and Fi.pdf_facts(b"%PDF-1.4")[:3] == (True, False, None)
