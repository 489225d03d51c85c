"""Deterministic identifiers and storage keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name space of this library's own version 5 identifiers.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "quire:documents")


def fingerprint(content: Column) -> Column:
    """SHA-256 of bytes or text as 64 lower-case hex digits."""
    return F.sha2(content.cast("binary"), 256)


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """Version 5 UUID of a name, inside whole-stage code: SHA-1 of name space and name, then version and variant set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def element_id(sha256: Column, reading_order: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("element"), sha256, reading_order.cast("string")))


def unit_id(sha256: Column, key: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("unit"), sha256, key))


def document_blob_key(sha256: Column) -> Column:
    return F.concat(F.lit("documents/"), sha256, F.lit(".pdf"))


def figure_blob_key(document_id: Column, element: Column) -> Column:
    return F.concat(F.lit("figures/"), document_id, F.lit("/"), element, F.lit(".png"))


def page_blob_key(document_id: Column, page: Column) -> Column:
    return F.concat(F.lit("pages/"), document_id, F.lit("/"), page.cast("string"), F.lit(".png"))


def is_safe_key(key: Column) -> Column:
    """A storage key is a relative path without empty, "." or ".." parts and without back-slashes."""
    parts = F.split(key, "/")
    return key.isNotNull() & ~key.contains("\\") & ~F.exists(parts, lambda p: p.isin("", ".", ".."))
