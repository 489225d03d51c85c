"""Uploads and blobs: bytes in any store that Spark can reach, through the Hadoop file system interface."""

from __future__ import annotations

import re
import uuid
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ids as I
from quire.functions import text as T

MAX_BYTES, MAX_PAGES = 200 * 1024 * 1024, 500


class InvalidKey(ValueError):
    """A storage key that is no safe relative path."""


def read_uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, file_name, size_bytes, sha256, content of the files under a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", T.base_name(F.col("path")).alias("file_name"), F.col("length").alias("size_bytes"), I.fingerprint(F.col("content")).alias("sha256"), "content")


#: Compressed streams of one file that are opened to look for pages, and bytes that one may grow to.
MOST_STREAMS, MOST_STREAM = 100_000, 64 << 20


def pdf_facts(content: bytes) -> tuple[bool, bool, int | None, int, list[str]]:
    """(is a PDF, encrypted, pages, pages without any text operator, titles of the outline), read off the objects of a file:
    those in the open and those in compressed object streams. Without a page object there is no page count."""
    if b"%PDF-" not in content[:1024]:
        return False, False, None, 0, []
    opened = [content]
    texts: dict[int, bool] = {}
    for n, m in enumerate(_OBJECT.finditer(content)):
        if n >= MOST_STREAMS:
            break
        head, body = m["head"], content[m.end() : content.find(b"endstream", m.end())]
        plain = body
        if b"/FlateDecode" in head:
            try:
                plain = zlib.decompressobj().decompress(body, MOST_STREAM)
            except zlib.error:
                continue
        elif b"/Filter" in head:
            continue
        if b"/ObjStm" in head:
            opened.append(plain)
        texts[int(m["id"])] = _SHOWS_TEXT.search(plain) is not None
    encrypted = any(re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", x) for x in opened)
    pages = [m for x in opened for m in _PAGE.finditer(x)]
    empty = 0
    for m in pages:
        around = _dictionary(m.string, m.start())
        refs = [int(r) for part in re.findall(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", around)[:1] for r in re.findall(rb"(\d+)\s+\d+\s+R", part)]
        empty += not any(texts.get(r, False) for r in refs)
    titles = [t.decode("latin-1") for x in opened if b"/Outlines" in content or x is not content for t in re.findall(rb"/Title\s*\(((?:[^()\\]|\\.)*)\)[^>]*/Parent", x)]
    return True, encrypted, len(pages) or None, empty, titles


def _dictionary(data: bytes, at: int, reach: int = 4000) -> bytes:
    """The dictionary that holds a place, as far as it is within reach."""
    first, opened = max(0, at - reach), []
    for m in re.finditer(rb"<<|>>", data[first : at + reach]):
        if m[0] == b"<<":
            opened.append(first + m.start())
        elif opened:
            begin = opened.pop()
            if begin <= at < first + m.end():
                return data[begin : first + m.end()]
    return b""


_OBJECT = re.compile(rb"(?P<id>\d+)\s+\d+\s+obj(?P<head>(?:(?!endobj).){0,2000}?)stream\r?\n", re.S)
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_SHOWS_TEXT = re.compile(rb"[)>\]]\s*(?:Tj|TJ|'|\")")


def inspect_pdf(uploads: DataFrame) -> DataFrame:
    """Adds is_pdf, encrypted, page_count, pages_without_text and outline_titles, read from the file's own structure, compressed
    object streams included."""

    @F.pandas_udf("is_pdf boolean, encrypted boolean, page_count int, pages_without_text int, outline_titles array<string>")
    def facts(contents: pd.Series) -> pd.DataFrame:
        rows = [pdf_facts(c or b"") for c in contents]
        return pd.DataFrame(rows, columns=["is_pdf", "encrypted", "page_count", "pages_without_text", "outline_titles"]).astype({"page_count": "Int32"})

    found = uploads.withColumn("_facts", facts("content"))
    return found.withColumns({c: F.col(f"_facts.{c}") for c in ("is_pdf", "encrypted", "page_count", "pages_without_text", "outline_titles")}).drop("_facts")


def upload_problem(max_bytes: int = MAX_BYTES, max_pages: int = MAX_PAGES):
    """Why an inspected upload is refused, null if it is not."""
    return (
        F.when(F.col("file_name").isNull(), "invalid_file_name")
        .when(F.col("size_bytes") <= 0, "empty_file")
        .when(F.col("size_bytes") > max_bytes, "file_too_large")
        .when(~F.col("is_pdf"), "unsupported_media_type")
        .when(F.col("encrypted"), "encrypted_document")
        .when(F.col("page_count") > max_pages, "too_many_pages")
    )


class Blobs:
    """Key -> bytes below a root folder. Saving writes a temporary file and renames it; deleting what is not there is no error."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")

    def _path(self, key: str):
        if not key or key.startswith("/") or "\\" in key or any(p in ("", ".", "..") for p in key.split("/")):
            raise InvalidKey(key)
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")

    def _fs(self, path):
        return path.getFileSystem(self.conf)

    def save(self, key: str, content: bytes) -> None:
        self.save_stream(key, [content])

    def save_stream(self, key: str, chunks) -> None:
        """Save what an iterable of chunks gives; only one of them is held at a time, and a stream that fails leaves nothing."""
        target = self._path(key)
        staged = self._path(f"{key}.{uuid.uuid4().hex}.part")
        fs = self._fs(target)
        out = fs.create(staged, True)
        try:
            for chunk in chunks:
                out.write(bytearray(chunk))
        except BaseException:
            out.close()
            fs.delete(staged, False)
            raise
        out.close()
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(staged, target):
            raise OSError(f"{key} could not be saved")

    def read(self, key: str) -> bytes:
        path = self._path(key)
        stream = self._fs(path).open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def exists(self, key: str) -> bool:
        path = self._path(key)
        return self._fs(path).exists(path)

    def move(self, key: str, to: str) -> None:
        a, b = self._path(key), self._path(to)
        self._fs(a).mkdirs(b.getParent())
        if not self._fs(a).rename(a, b):
            raise FileNotFoundError(key)

    def delete(self, key: str) -> None:
        path = self._path(key)
        self._fs(path).delete(path, True)

    delete_tree = delete


# Blob tables ------------------------------------------------------------------------------------------------------------

BLOB_BUCKETS = 64


def save_blobs(blobs: DataFrame, path: str, buckets: int = BLOB_BUCKETS) -> None:
    """blobs(key, content): many blobs at once, written by the executors as rows (page images, figure crops), with their
    SHA-256. A key that is no safe relative path fails the write; of a key that is saved again the newest row counts."""
    safe = F.when(I.is_safe_key(F.col("key")), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("unsafe key: "), F.coalesce("key", F.lit("null")))).cast("string"))
    rows = blobs.select(safe.alias("key"), "content", I.fingerprint(F.col("content")).alias("sha256"), F.current_timestamp().alias("saved_at"))
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    placed.repartition("bucket").sortWithinPartitions("key").write.partitionBy("bucket").mode("append").parquet(path)


def load_blobs(spark: SparkSession, path: str, keys: list[str] | None = None, buckets: int = BLOB_BUCKETS) -> DataFrame:
    """key, content, sha256 of these keys (which prunes to their buckets and row groups), or of all."""
    from quire.operators.relational import latest_per_key

    rows = spark.read.parquet(path)
    if keys is not None:
        at = [r.b for r in spark.createDataFrame([(k,) for k in keys], "k string").select(F.pmod(F.xxhash64("k"), F.lit(buckets)).alias("b")).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(at) & F.col("key").isin(keys))
    return latest_per_key(rows, "key", "saved_at").select("key", "content", "sha256")


def pages_without_image(pages: DataFrame, blobs: DataFrame) -> DataFrame:
    """pages(document_id, page) whose image was not stored: their documents fail."""
    keyed = pages.withColumn("key", I.page_blob_key(F.col("document_id"), F.col("page")))
    return keyed.join(blobs.select("key"), "key", "left_anti")
