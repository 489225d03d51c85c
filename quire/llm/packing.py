"""Packing token ids into windows of fixed length: bounded-space online best fit.

Each partition keeps `open_windows` windows open. A document's ids fill windows of their own as long as a whole window is
left; the rest goes to the open window that it fits most tightly. If it fits none, a new window is opened while there are
fewer than the fixed number; else the fullest one is topped up with the head of the rest and emitted. At the end of a
partition its open windows are merged, so that at most one part-filled window is left over; a second, small pass merges
the leftovers of `fan_in` partitions each in the same way. Only the last window of such a group is padded.

Ids come from the library: texts are cut at ASCII white space, which the vocabulary's splitter always drops, and each
distinct word's ids are kept (a bounded number); words not yet known go to the library together.

Nulls and odd input: a null text is an empty one (just the end id); a null doc_id stays null; repeated rows are packed
each; extra columns are ignored; an empty table gives an empty result; a long text is read block by block.
"""

from __future__ import annotations

import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialize, small_batches, table, utf8, worker_cache

WINDOW, END_ID = 4096, 2
OPEN_WINDOWS, FAN_IN = 8, 64
MAX_WORDS, BLOCK = 700_000, 1 << 22
#: Sequence ids of the merging pass start here.
MERGED = 1 << 62
_MARKS = re.compile(rb"[\xCC-\xF4]")
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row_id long"


def lowered(data: bytes) -> bytes:
    """A-Z in lower case, which the vocabulary's normaliser would do too; not where combining marks may follow a letter,
    as there the order of composing and lowering counts."""
    return data if not data.isascii() and _MARKS.search(data) else data.lower()


class WordIds:
    """Ids of texts by words; the library encodes the words that are not known yet."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer)
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        self.ends[[i for t, i in self.library.get_vocab(False).items() if t.endswith("</w>")]] = True
        self.marks = [self.library.encode(x, add_special_tokens=False).ids[0] for x in ".,"]
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begin, self.size, self.store, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32), 0

    def _learn(self, words: list[bytes]) -> None:
        """Words of Latin letters only are one piece each, so their ids end where an end-of-word id stands; one full stop or
        comma after them is one more; the others' ids are told apart by the offsets."""
        plain, other, marked = {}, [], []
        for w in words:
            t = w.decode()
            if t.isalpha() and max(t) < "\u0100":
                plain[w] = t
            elif t[-1] in ".," and (u := t[:-1]).isalpha() and max(u) < "\u0100":
                marked.append((w, t))  # the mark is a piece of its own
                if (w := w[:-1]) not in self.known:
                    plain[w] = u
            else:
                other.append((w, t))
        plain = [*plain.items()]
        for at in range(0, len(plain), 4000):
            some = plain[at : at + 4000]
            e = self.library.encode_batch_fast([" ".join([t for _, t in some])], add_special_tokens=False)[0]
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                self._keep(some, ids, np.diff(ends, prepend=0))
            else:
                other += some
        for at in range(0, len(other), 4000):
            some = other[at : at + 4000]
            sizes = np.array([len(t) + 1 for _, t in some])
            e = self.library.encode(" ".join([t for _, t in some]), add_special_tokens=False)
            of = np.searchsorted(np.cumsum(sizes) - sizes, np.array([x for x, _ in e.offsets], np.int64), side="right") - 1
            self._keep(some, np.array(e.ids, np.uint32), np.bincount(of, minlength=len(some)))
        if marked:
            at = np.array([self.known[w[:-1]] for w, _ in marked], np.int64)
            n = self.size[at] + 1
            ends = np.cumsum(n)
            ids = self.store[np.minimum(np.repeat(self.begin[at] - ends + n, n) + np.arange(ends[-1]), len(self.store) - 1)]
            ids[ends - 1] = np.where([w[-1:] == b"." for w, _ in marked], *self.marks)
            self._keep(marked, ids, n)

    def _keep(self, words: list[tuple[bytes, str]], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.known)
        while first + len(words) > len(self.begin):
            self.begin, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size))
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        self.store[self.used : self.used + len(ids)] = ids
        self.size[first : first + len(words)] = sizes
        self.begin[first : first + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip([w for w, _ in words], range(first, first + len(words))))

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and how many each word has."""
        if len(self.known) > MAX_WORDS:
            self._clear()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(at < 0)):
            new = new.tolist()
            self._learn([*dict.fromkeys([words[i] for i in new])])
            at[new] = [self.known[words[i]] for i in new]
        n = self.size[at]
        ends = np.cumsum(n)
        return self.store[np.repeat(self.begin[at] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n

    def _long(self, data: bytes) -> np.ndarray:
        parts, at = [], 0
        while at < len(data):
            cut = len(data) if at + BLOCK >= len(data) else (m.start() if (m := _SPACE.search(data, at + BLOCK)) else len(data))
            parts.append(self._ids(lowered(data[at:cut]).split())[0])
            at = cut
        return np.concatenate(parts)

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        out, at = [], 0
        while at < len(texts):
            if len(texts[at]) > BLOCK:
                out.append(self._long(texts[at]))
                at += 1
                continue
            words, counts, size = [], [], 0
            while at < len(texts) and size < BLOCK and len(texts[at]) <= BLOCK:
                more = lowered(texts[at]).split()
                words += more
                counts.append(len(more))
                size += len(texts[at])
                at += 1
            ids, n = self._ids(words)
            ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum(counts)]
            out += np.split(ids, ends[:-1])
        return out


def word_ids(tokenizer: str) -> WordIds:
    return worker_cache(("words", tokenizer), lambda: WordIds(tokenizer))


class Packer:
    """Open windows of one partition. Emitted rows: (doc_id, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, base: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.window, self.most, self.next = window, open_windows, base
        self.open: list[tuple[int, list]] = []
        self.rows: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self._emit([(doc, start, ids[: self.window], total)])
            ids, start = ids[self.window :], start + self.window
        while n := len(ids):
            fits = [(self.window - fill, i) for i, (fill, _) in enumerate(self.open) if self.window - fill >= n]
            if not fits and len(self.open) < self.most:
                self.open.append((0, []))
                continue
            i = min(fits)[1] if fits else max(range(len(self.open)), key=lambda k: self.open[k][0])
            fill, pieces = self.open[i]
            head = ids[: self.window - fill]
            pieces.append((doc, start, head, total))
            self.open[i] = (fill + len(head), pieces)
            if fill + len(head) == self.window:
                self._emit(self.open.pop(i)[1])
            ids, start = ids[len(head) :], start + len(head)

    def close(self) -> list:
        """Merge the open windows; the pieces of the one that stays part-filled."""
        left, self.open, self.most = [p for _, pieces in sorted(self.open, key=lambda x: -x[0]) for p in pieces], [], 1
        for p in left:
            self.add(*p)
        rest = self.open[0][1] if self.open else []
        self.open = []
        return rest

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [*zip(*rows)] or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row_id. The
    pieces of one row of docs share a row_id, which tells apart rows that share a doc_id."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = PIECES.format(id=kind)

    numbers = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "row_id")

    def flat(rows):
        """A packer's rows name a document by its id and its row."""
        return [(r[0][0], *r[1:], r[0][1]) for r in rows]

    def run(batches):
        part = TaskContext.get().partitionId()
        packer, encode, n = Packer(part << 32, window, open_windows), word_ids(tokenizer), part << 33
        schema = None
        for b in batches:
            schema = schema or pa.schema([pa.field("doc_id", b.schema.field(0).type), *((c, pa.int64()) for c in numbers), ("part", pa.int64()), ("ids", pa.binary())])
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                packer.add((doc, n), 0, np.append(ids, np.uint32(end_id)), len(ids) + 1)
                n += 1
            yield _batch([(*r, None, None) for r in flat(packer.take())], schema)
        if schema:
            left = packer.close()
            yield _batch([(*r, None, None) for r in flat(packer.take())] + [(doc, start, len(ids), None, total, None, i, row, part, ids.tobytes()) for i, ((doc, row), start, ids, total) in enumerate(left)], schema)

    def merge(batches):
        group, packer, schema = None, None, None
        for b in batches:
            schema = schema or pa.schema([b.schema.field("doc_id"), *((c, pa.int64()) for c in numbers)])
            for doc, row, start, total, ids, g in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row_id", "start", "doc_tokens", "ids", "g"))):
                if g != group:
                    if packer:
                        yield from last(packer, schema)
                    group, packer = g, Packer(MERGED + (g << 32), window, open_windows)
                packer.add((doc, row), start, np.frombuffer(ids, np.uint32), total)
            yield _batch(flat(packer.take()), schema)
        if packer:
            yield from last(packer, schema)

    def last(packer, schema):
        if rest := packer.close():
            packer._emit(rest)
        yield _batch(flat(packer.take()), schema)

    first = docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(run, f"{fields}, part long, ids binary")
    first = materialize(first, "pieces")
    left = first.where("part is not null").withColumn("g", F.floor(F.col("part") / fan_in))
    merged = left.repartition(F.col("g")).sortWithinPartitions("g", "part", "offset").mapInArrow(merge, fields)
    return first.where("part is null").drop("part", "ids").unionByName(merged)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
