"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of hashed features: each word, the 3-grams of its characters with word
borders, and a mark for a word that repeats the one before it. A softmax layer over the average gives the classes. Vectors
and layer are trained together by stochastic gradient descent in numpy. For scoring, the product of each vector with the
difference of the two output columns is tabulated once (the softmax of two classes needs no more), so a word costs one
look-up; scores are those of the full model.

The model is fitted on at most `sample` labelled documents, those with the least hashes of their ids; the driver gathers
just their hashed features. Everything else covers all documents and whole texts. Inputs of a score are the text alone.

Nulls and odd input: a null or blank text has no features, its score is the prior that the output layer learned; a null
doc_id counts as held out; labels that contradict each other are left out, repeated ones count once; repeated rows are
scored each; extra columns are ignored; without usable labels of both classes the score is 0.5 or the single class.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import small_batches, table, utf8, worker_cache

BUCKETS, DIMENSIONS, SAMPLE, STEPS, RATE, SEED = 1 << 17, 16, 4000, 24_000, 0.5, 17
CUTOFF = 0.3
AGAIN = crc32(b" again") % BUCKETS
MAX_WORDS, BLOCK = 300_000, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def features(word: bytes) -> list[int]:
    w = b"<" + word + b">"
    return [crc32(w) % BUCKETS, *(crc32(w[i : i + 3]) % BUCKETS for i in range(len(w) - 2))]


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(data):
        cut = len(data) if at + BLOCK >= len(data) else (m.start() if (m := _SPACE.search(data, at + BLOCK)) else len(data))
        yield data[at:cut].split()
        at = cut


def text_features(data: bytes) -> tuple[list[int], list[float]]:
    """The distinct features of a text and their shares."""
    words, again, last = Counter(), 0, None
    for block in word_blocks(data):
        words.update(block)
        again += sum(a == b for a, b in zip(block, block[1:])) + (bool(block) and block[0] == last)
        last = block[-1] if block else last
    found: Counter = Counter()
    for w, n in words.items():
        for f in features(w):
            found[f] += n
    if again:
        found[AGAIN] += again
    total = sum(found.values())
    return [*found], [n / total for n in found.values()]


@dataclass
class Model:
    margin: np.ndarray  # per feature: vector times (output of class 1 - output of class 0)
    bias: float

    def score(self, total: float, n: float) -> float:
        return float(1 / (1 + np.exp(-np.clip((total / n if n else 0.0) + self.bias, -60, 60))))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], steps: int = STEPS, rate: float = RATE, seed: int = SEED) -> Model:
    """rows: (class, features, shares). One document a step, in a new random order each time round."""
    good = sum(y for y, _, _ in rows)
    if good in (0, len(rows)):
        return Model(np.zeros(BUCKETS, np.float32), 0.0 if not rows else 60.0 if good else -60.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    order = np.concatenate([rng.permutation(len(rows)) for _ in range(-(-steps // len(rows)))])[:steps]
    for step, i in enumerate(order):
        y, f, s = rows[i]
        lr = np.float32(rate * (1 - step / steps))
        mean = s @ vectors[f]
        z = mean @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        down = out @ p
        out -= lr * np.outer(mean, p)
        bias -= lr * np.float32(0.1) * p
        vectors[f] -= lr * np.outer(s, down)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Every fifth document by the checksum of its id; their labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    small_batches(docs.sparkSession)
    once = labels.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z and doc_id is not null")
    chosen = once.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)

    @F.pandas_udf("f binary, s binary")
    def parts(texts: pd.Series) -> pd.DataFrame:
        found = [text_features(bytes(x)) for x in texts]
        return pd.DataFrame({"f": [np.array(f, np.int32).tobytes() for f, _ in found], "s": [np.array(s, np.float32).tobytes() for _, s in found]})

    # `chosen` has at most `sample` rows
    rows = docs.select("doc_id", utf8(F.col("text")).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("h").alias("h"), F.first("y").alias("y"), F.min("text").alias("text"))
    found = rows.select("h", "doc_id", "y", parts("text").alias("x")).collect()
    return fit([(int(r.y), np.frombuffer(r.x.f, np.int32), np.frombuffer(r.x.s, np.float32)) for r in sorted(found, key=lambda r: (r.h, r.doc_id))])


class Scorer:
    def __init__(self, model: Model):
        self.model, self.table = model, model.margin.tolist()
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.margin, self.size = np.zeros(1 << 16), np.zeros(1 << 16)

    def _learn(self, word: bytes) -> int:
        at = len(self.known)
        if at == len(self.margin):
            self.margin, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.margin, self.size))
        f = features(word)
        self.margin[at], self.size[at] = sum(map(self.table.__getitem__, f)), len(f)
        self.known[word] = at
        return at

    def __call__(self, data: bytes) -> float:
        total = n = 0.0
        last = None
        for block in word_blocks(data):
            if not block:
                continue
            if len(self.known) > MAX_WORDS:
                self._clear()
            at = [*map(self.known.get, block)]
            if None in at:
                again = sum(a == b for a, b in zip(block, block[1:]))
                for i, x in enumerate(at):
                    if x is None:
                        w = block[i]
                        if len(w) > 64:  # not kept
                            f = features(w)
                            total += sum(map(self.table.__getitem__, f))
                            n += len(f)
                        else:
                            at[i] = self.known.get(w)
                            if at[i] is None:
                                at[i] = self._learn(w)
                at = np.array([x for x in at if x is not None], np.int64)
            else:
                at = np.array(at, np.int64)
                again = int((at[1:] == at[:-1]).sum())
            again += block[0] == last
            last = block[-1]
            total += self.margin[at].sum() + again * self.table[AGAIN]
            n += self.size[at].sum() + again
        return self.model.score(total, n)


def _scorer(margin: bytes, bias: float) -> Scorer:
    return worker_cache(("scorer", crc32(margin), bias), lambda: Scorer(Model(np.frombuffer(margin, np.float32), bias)))


def score(text: Column, model: Model) -> Column:
    margin, bias = model.margin.tobytes(), model.bias

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _scorer(margin, bias)
        for texts in parts:
            yield pd.Series([one(bytes(x)) for x in texts], dtype="float64")

    return scored(utf8(text))


def keep_good(docs: DataFrame, labels: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    return docs.where(score(F.col("text"), train(docs, labels)) >= cutoff)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels)
    small_batches(spark)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
