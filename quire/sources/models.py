"""Model ports. The engine calls models through these functions only; the defaults are deterministic stand-ins, so plans run
without any model. Numbers measured with them tell of the data flow, not of answer quality."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

DIMENSIONS = 64


class ProviderError(RuntimeError):
    """A model call failed; code is stable for callers."""

    code = "provider_error"


class Unavailable(ProviderError):
    """A model can't be reached for now: worth another try."""

    code = "provider_unavailable"


class Rejected(ProviderError):
    """A model refused the request: another try gives the same."""

    code = "provider_rejected"


class InvalidReply(ProviderError):
    """A model's reply is not of the agreed form."""

    code = "provider_invalid_reply"


@dataclass(frozen=True)
class Retry:
    """Attempts with growing pauses inside a time budget; jitter spreads the pauses of many tasks by that share of them."""

    attempts: int = 4
    first: float = 0.5
    most: float = 10.0
    budget: float = 300.0
    jitter: float = 0.25

    def call(self, f: Callable, *args):
        began = time.monotonic()
        for n in range(self.attempts):
            try:
                return f(*args)
            except Unavailable:
                pause = min(self.most, self.first * 2**n) * (1 + random.uniform(-self.jitter, self.jitter))
                if n + 1 == self.attempts or time.monotonic() + pause - began > self.budget:
                    raise
                time.sleep(pause)


def post_json(url: str, body: dict, timeout: float = 60.0, most_bytes: int = 32 << 20, headers: dict | None = None) -> dict:
    """A JSON request of a model server. Connection faults, 429 and 5xx are Unavailable, other refusals Rejected, and a body
    that is too long or no JSON object is an InvalidReply."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            raw = reply.read(most_bytes + 1)
    except urllib.error.HTTPError as e:
        raise (Unavailable if e.code == 429 or e.code >= 500 else Rejected)(f"status {e.code}") from e
    except OSError as e:
        raise Unavailable(str(e)) from e
    if len(raw) > most_bytes:
        raise InvalidReply("the reply is too long")
    try:
        found = json.loads(raw)
    except ValueError as e:
        raise InvalidReply("the reply is no JSON") from e
    if not isinstance(found, dict):
        raise InvalidReply("the reply is no object")
    return found


#: Vectors of words that a worker keeps, in two halves: when the newer one is full, the older one goes.
WORDS = 25_000
_newer: dict[tuple[str, int], np.ndarray] = {}
_older: dict[tuple[str, int], np.ndarray] = {}


def _seeds(words: list[str]) -> list[tuple[int, int]]:
    """State and increment that np.random.default_rng() gives a generator for each word's seed, by the published hash of its seed
    sequences, of all words at once: making a generator for each word takes longer than all the rest of a text's vector."""
    u32, u64, half = np.uint32, np.uint64, np.uint64(32)
    seeds = np.array([int.from_bytes(sha256(w.encode()).digest()[:8], "big") for w in words], u64)
    key = 0x43B0D7E5

    def hashed(x):
        nonlocal key
        x = x ^ u32(key)
        key = key * 0x931E8875 & 0xFFFFFFFF
        x = x * u32(key)
        return x ^ (x >> u32(16))

    pool = [hashed(x) for x in ((seeds & u64(0xFFFFFFFF)).astype(u32), (seeds >> half).astype(u32), np.zeros(len(seeds), u32), np.zeros(len(seeds), u32))]
    for i, j in ((i, j) for i in range(4) for j in range(4) if i != j):
        x = pool[j] * u32(0xCA01F9DD) - hashed(pool[i]) * u32(0x4973F715)
        pool[j] = x ^ (x >> u32(16))
    key, parts = 0x8B51F9DD, []
    for i in range(8):
        x = pool[i % 4] ^ u32(key)
        key = key * 0x58F38DED & 0xFFFFFFFF
        x = x * u32(key)
        parts.append((x ^ (x >> u32(16))).astype(u64))
    whole, multiplier = (1 << 128) - 1, 0x2360ED051FC65DA44385DF649FCCF645
    out = []
    for a, b, c, d in zip(*((parts[2 * i] | parts[2 * i + 1] << half).tolist() for i in range(4))):
        step = (c << 65 | d << 1 | 1) & whole
        out.append((((step + (a << 64 | b)) * multiplier + step) & whole, step))
    return out


def _word_vectors(words: set[str], dimensions: int) -> dict[str, np.ndarray]:
    """The vector of each word: normal deviates of a generator that the word seeds."""
    global _newer, _older
    found, new = {}, []
    for w in words:
        v = _newer.get((w, dimensions))
        if v is None:
            v = _older.get((w, dimensions))
        if v is None:
            new.append(w)
        else:
            found[w] = v
    bits = np.random.PCG64(0)
    normal = np.random.Generator(bits).standard_normal
    for w, (state, step) in zip(new, _seeds(new)):
        bits.state = {"bit_generator": "PCG64", "state": {"state": state, "inc": step}, "has_uint32": 0, "uinteger": 0}
        found[w] = normal(dimensions)
    for w, v in found.items():
        if len(_newer) >= WORDS:
            _newer, _older = {}, _newer
        _newer[w, dimensions] = v
    return found


def hash_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """Unit vectors seeded by the words of texts: texts that share words are near each other."""
    words = [T.folded(t).split() for t in texts]
    of, out = _word_vectors(set().union(*words), dimensions), []
    for ws in words:
        total = np.array([of[w] for w in ws]).sum(axis=0) if ws else np.zeros(dimensions)
        n = np.linalg.norm(total)
        out.append((total / n if n else total).astype(np.float32).tolist())
    return out


def hash_vector(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    return hash_vectors([text], dimensions)[0]


#: Texts of one call of a model that takes a batch.
CALL = 64


def _batched(rows: list, model: Callable, retry: Retry) -> list:
    """The model's answers to the rows, a batch of CALL a call; rows that are null get null."""
    known = [i for i, r in enumerate(rows) if r is not None]
    out = [None] * len(rows)
    for at in range(0, len(known), CALL):
        part = known[at : at + CALL]
        replies = retry.call(model, [rows[i] for i in part])
        if len(replies) != len(part):
            raise InvalidReply(f"{len(replies)} replies to {len(part)} texts")
        for i, reply in zip(part, replies):
            out[i] = reply
    return out


def embed(text: Column, model: Callable[[list[str]], list[list[float]]] = hash_vectors, retry: Retry = Retry()) -> Column:
    """The vector of each text; the model takes a batch of texts."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in parts:
            yield pd.Series(_batched(x.tolist(), model, retry), dtype=object)

    return F.pandas_udf(run, "array<float>")(text)


INSTRUCTION = "Given a question, find the passages of technical documents that answer it"


def embed_query(text: Column, instruction: str = INSTRUCTION, **how) -> Column:
    """The vector of a question: models of this kind read it with an instruction in front, passages without."""
    return embed(F.concat(F.lit(f"Instruct: {instruction}\nQuery:"), text) if instruction else text, **how)


def overlap_judge(pairs: list[tuple[str, str]]) -> list[float]:
    """Share of each question's words that its passage holds."""
    words = lambda x: {w for w in T.folded(x).split() if len(w) >= T.MIN_WORD}
    sets = [(words(q), words(p)) for q, p in pairs]
    return [len(q & p) / len(q) if q else 0.0 for q, p in sets]


def judge(question: Column, passage: Column, model: Callable[[list[tuple[str, str]]], list[float]] = overlap_judge, retry: Retry = Retry()) -> Column:
    def run(q: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(_batched(list(zip(q, p)), model, retry), dtype="float64")

    return F.pandas_udf(run, "double")(question, passage)


def first_sentence(rules: str, prompt: str) -> dict:
    """Answers with the first sentence of the first source."""
    body = prompt.split(">\n", 2)[-1].split("\n</source>")[0] if "<source " in prompt else ""
    sentence = next((s for s in body.replace("\n", " ").split(". ") if s.strip()), "")
    return {"answer": f"{sentence.strip().rstrip('.')} [1]." if sentence.strip() else "", "not_covered": ""}


def generate(prompt: Column, rules: str = T.RULES, model: Callable[[str, str], dict] = first_sentence, retry: Retry = Retry()) -> Column:
    """struct<answer, not_covered>: the model gets the rules as its system part and the prompt as the user's. A reply with
    other fields fails."""

    def run(prompts: pd.Series) -> pd.DataFrame:
        replies = [retry.call(model, rules, p) for p in prompts]
        if any(set(r) != {"answer", "not_covered"} for r in replies):
            raise InvalidReply("the model's reply has other fields")
        return pd.DataFrame(replies, columns=["answer", "not_covered"]).astype(object)

    return F.pandas_udf(run, "answer string, not_covered string")(prompt)


def describe_figures(figures: DataFrame, model: Callable[[str, str, str], str], parallel: int = 2, retry: Retry = Retry(attempts=2)) -> DataFrame:
    """figures(id, image_key, caption, context) -> id, description, description_status. A task has a few calls under way at
    once; after the first failure to reach the model, retries included, it asks no more: the rest of its figures are not
    described."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reachable = True

        def one(row):
            nonlocal reachable
            if not reachable:
                return None
            try:
                return retry.call(model, row.image_key, row.caption, row.context)
            except Unavailable:
                reachable = False
            except (Rejected, InvalidReply):  # of this figure alone
                return None

        with ThreadPoolExecutor(parallel) as pool:
            for b in batches:
                rows = list(b.itertuples(index=False))
                texts = [t for at in range(0, len(rows), parallel) for t in pool.map(one, rows[at : at + parallel])]
                out = [(r.id, t, "described" if t else "not_described") for r, t in zip(rows, texts)]
                yield pd.DataFrame(out, columns=["id", "description", "description_status"])

    return figures.select("id", "image_key", "caption", "context").mapInPandas(run, "id string, description string, description_status string")


# Frequent short words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as on at by this are was",
    "es": "el la los las de que y en un una por con para del se es",
    "fr": "le la les des et en un une du que qui pour dans est pas au",
    "de": "der die das und in den von zu mit ist nicht ein eine auf dem sich",
}


def identify_language(text: Column, candidates: tuple[str, ...] = ("en", "es")) -> Column:
    """The candidate whose function words a text has most of; the first candidate where none leads. Built-in functions."""
    words = F.split(F.lower(text), r"[\s,.;:!?]+")

    def hits(language: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*FUNCTION_WORDS[language].split())))

    score = {c: hits(c) for c in candidates}
    best = F.greatest(*score.values(), F.lit(0))
    found = F.lit(candidates[0])
    for c in reversed(candidates):
        found = F.when((score[c] == best) & (best > 0), c).otherwise(found)
    return F.when(score[candidates[0]] == best, candidates[0]).otherwise(found)
