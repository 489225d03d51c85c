"""Token counts of a byte-level BPE vocabulary by compiled finite-state transducers.

Two machines are compiled from the tokenizer file:

* SPLIT reads characters by class and marks where pieces start (the library's split into contractions, letters, numbers,
  other characters and white space). Its ten states and twelve classes make a dense table. A block of texts is cut into
  lanes of equal length; all lanes are run in step from every state at once, which gives each lane's state map; the maps
  are composed by a parallel prefix scan, which gives each lane's true start state; a second run emits the marks.
* MERGE reads the bytes of one piece. Its state holds the places where the next token may still start, each with the last
  token before it; of the vocabulary entries that end at a byte just one may follow the encoding of what precedes it. Each
  transition is annotated with the change of the number of emitted tokens. States are compiled when first reached and
  dropped when too many are held, as in a lazy automaton; whole pieces are kept as one annotated step from the start.

The counts equal the library's, without begin, end or added special tokens; special strings inside a text count as the
library counts them by default (one token each). Nulls and odd input: a null text is an empty one (no tokens); a null
doc_id stays null; repeated rows each keep their row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import small_batches, table, worker_cache

TOKEN_LIMIT = 1024
LANE, BLOCK = 512, 1 << 21
MAX_STATES, MAX_PIECES = 200_000, 600_000

# Classes of characters and states of SPLIT.
STMD, R, V, E, EL, LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER, END = range(12)
START, LETTERS, NUMBERS, OTHERS, ON_SPACE, ON_BLANK, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L = range(10)
HERE, BEFORE = 1, 2  # marks: a piece starts at this character, at the one before


def _compile_split() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks), each states x classes."""
    to, marks = np.zeros((10, 12), np.uint8), np.zeros((10, 12), np.uint8)
    opened = {c: LETTERS for c in (STMD, R, V, E, EL, LETTER)} | {NUMBER: NUMBERS, SPACE: ON_SPACE, BLANK: ON_BLANK, QUOTE: QUOTED, OTHER: OTHERS, END: START}
    letters = (STMD, R, V, E, EL, LETTER)
    for s in range(10):
        for c in range(12):
            nxt, out = opened[c], HERE
            if s == LETTERS and c in letters or s == NUMBERS and c == NUMBER:
                out = 0
            elif s in (OTHERS, QUOTED) and c in (QUOTE, OTHER):
                nxt, out = OTHERS, 0
            elif s == QUOTED and c == STMD:
                nxt, out = START, 0
            elif s == QUOTED and c in (R, V, EL):
                nxt, out = {R: QUOTED_R, V: QUOTED_V, EL: QUOTED_L}[c], 0
            elif s in (QUOTED_R, QUOTED_V, QUOTED_L):
                if c == (EL if s == QUOTED_L else E):
                    nxt, out = START, 0
                else:  # no contraction after all: the letter after the quote starts a piece
                    out = BEFORE | (0 if c in letters else HERE)
            elif s in (ON_SPACE, ON_BLANK):
                if c in (SPACE, BLANK):
                    out = 0
                elif c == END:
                    out = HERE
                elif s == ON_SPACE:  # the last space of a run belongs to what follows
                    nxt, out = (OTHERS if c == QUOTE else nxt), BEFORE
                else:
                    out = BEFORE | HERE
            to[s, c], marks[s, c] = nxt, out
    return to, marks


TO, MARKS = _compile_split()


@cache
def char_classes(tokenizer: str) -> bytes:
    """The class of each code point, compressed. Where the two Unicode tables at hand disagree, and for the low planes, the
    library itself is asked."""
    import regex
    from tokenizers import Tokenizer

    every = "".join(map(chr, range(0x110000)))
    classes = np.full(0x110000, OTHER, np.uint8)
    for c, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            classes[m.start() : m.end()] = c
    general = {"L": LETTER, "N": NUMBER}
    ask = [x for x in range(0x110000) if not 0xD800 <= x < 0xE000 and (x < 0x3100 or (x < 0x3FFFE and classes[x] != general.get(unicodedata.category(chr(x))[0], OTHER)))]
    split = Tokenizer.from_file(tokenizer).pre_tokenizer.pre_tokenize_str
    for x in ask:
        one = chr(x)
        classes[x] = next((c for c, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(lead + one)) == 1), BLANK)
    classes[0x20] = SPACE
    for c, which in ((STMD, "stmd"), (R, "r"), (V, "v"), (E, "e"), (EL, "l"), (QUOTE, "'")):
        classes[[ord(x) for x in which]] = c
    return zlib.compress(classes.tobytes())


def lane_starts(classes: np.ndarray, state: int) -> np.ndarray:
    """Start state of each lane; classes: steps x lanes. State maps of all lanes, composed by a prefix scan."""
    flat = TO.ravel()
    maps = np.broadcast_to(np.arange(10, dtype=np.uint8), (classes.shape[1], 10)).copy()
    for c in classes:
        maps = flat[maps * np.uint8(12) + c[:, None]]
    step = 1
    while step < len(maps):  # maps[i] becomes the map of lanes 0..i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    return np.concatenate(([state], maps[:-1, state])).astype(np.uint8)


def piece_marks(classes: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Whether a piece starts at each character. The first character is taken to stand at the start of a piece."""
    n = len(classes)
    lanes = -(-n // lane)
    grid = np.full(lanes * lane, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(lanes, lane).T)
    state = lane_starts(grid, START)
    out, to, marks = np.empty_like(grid), TO.ravel(), MARKS.ravel()
    for i, c in enumerate(grid):
        at = state * np.uint8(12) + c
        out[i] = marks[at]
        state = to[at]
    out = out.T.ravel()
    found = (out & HERE).astype(bool)
    found[:-1] |= (out[1:] & BEFORE).astype(bool)
    return found[:n]


class Merge:
    """The lazily compiled transducer over the bytes of a piece."""

    def __init__(self, tokenizer: str):
        with open(tokenizer, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.vocab = {bytes(byte_of[c] for c in k): v for k, v in model["vocab"].items()}
        self.bytes_of = {v: k for k, v in self.vocab.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = model["vocab"]
        self.rank = {(ids[a], ids[b]): (i, ids[a + b]) for i, (a, b) in reversed([*enumerate(pairs)])}
        self.made_of = {made: (*pair, at) for pair, (at, made) in self.rank.items()}
        self.left_spine: dict[int, list] = {}
        self.right_spine: dict[int, list] = {}
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, int] = {}
        # the vocabulary as a tree: node << 8 | byte -> node, and the token that ends at a node
        self.tree: dict[int, int] = {}
        self.token, self.grows = [-1], [True]
        for data, token in self.vocab.items():
            node = 0
            for byte in data:
                self.grows[node] = True
                if (to := self.tree.get(node << 8 | byte)) is None:
                    to = self.tree[node << 8 | byte] = len(self.token)
                    self.token.append(-1)
                    self.grows.append(False)
                node = to
            self.token[node] = token
        self._clear()

    def _clear(self) -> None:
        first = ((-1, 0, 0),)
        self.step: dict[int, int] = {}
        self.states, self.number = [first], {first: 0}

    def _restart(self, state: int) -> int:
        """Forget all states but this one: its new number."""
        held = self.states[state]
        self._clear()
        if held not in self.number:
            self.number[held] = len(self.states)
            self.states.append(held)
        return self.number[held]

    def encode(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first: the definition that the compiled machine must agree with."""
        ids = [self.vocab[bytes([b])] for b in data]
        while True:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                return ids
            low, out, i = best[0], [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (r := self.rank.get((ids[i], ids[i + 1]))) and r[0] == low:
                    out.append(r[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols that stand at the left (0) or right (1) edge of a token while it is merged, each with the rank of the
        merge that replaces it."""
        found, until = [], float("inf")
        while True:
            found.append((token, until))
            if token not in self.made_of:
                return found[::-1]
            *parts, until = self.made_of[token]
            token = parts[side]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the text of token a and then of b is encoded as just these two: no merge across the border comes up
        before the edges have grown on. Of equal ranks the left merge comes first."""
        if (known := self.fits.get(a << 20 | b)) is not None:
            return known
        if len(self.fits) > 500_000:
            self.fits.clear()
        left = self.right_spine.get(a) or self.right_spine.setdefault(a, self._spine(a, 1))
        right = self.left_spine.get(b) or self.left_spine.setdefault(b, self._spine(b, 0))
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            if (across := self.rank.get((x, y))) and across[0] < x_until and across[0] <= y_until:
                known = False
                break
            if x_until == y_until == float("inf"):
                known = True
                break
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        self.fits[a << 20 | b] = known
        return known

    def _compile(self, state: int, byte: int) -> int:
        """The transition, as next state << 10 | annotation + 512.

        A state holds the places where the next token may start: the last token of the encoding up to there, the node that
        the bytes since then have reached, and the tokens emitted since then. Of the tokens that end here just one may
        follow the encoding before it; the annotation is the change of the number of tokens."""
        alive, emitted = [], None
        for last, node, since in self.states[state]:
            if (to := self.tree.get(node << 8 | byte)) is None:
                continue
            if emitted is None and (token := self.token[to]) >= 0 and (last < 0 or self.may_follow(last, token)):
                emitted, latest = 1 - since, token
            if self.grows[to]:
                alive.append((last, to, since))
        key = (*((last, to, since + emitted) for last, to, since in alive), (latest, 0, 0))
        if (number := self.number.get(key)) is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        found = self.step[state << 8 | byte] = number << 10 | emitted + 512
        return found

    def run(self, data: bytes) -> int:
        """The tokens of a piece: the sum of the annotations along its path."""
        get, state, total = self.step.get, 0, -512 * len(data)
        for byte in data:
            to = get(state << 8 | byte)
            if to is None:
                if len(self.states) > MAX_STATES or len(self.step) > 4 * MAX_STATES:
                    state = self._restart(state)  # within a piece too, however long it is
                    get = self.step.get
                to = self._compile(state, byte)
            state = to >> 10
            total += to & 1023
        return total

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.pieces
        if len(known) > MAX_PIECES:
            known.clear()
        out = [*map(known.get, pieces)]
        if None in out:
            for i, n in enumerate(out):
                if n is None:
                    if (n := known.get(p := pieces[i])) is None:
                        n = self.run(p.encode())
                        if len(p) <= 64:
                            known[p] = n
                    out[i] = n
        return out


def merge_machine(tokenizer: str) -> Merge:
    return worker_cache(("merge", tokenizer), lambda: Merge(tokenizer))


class Counter:
    """Counts tokens of texts: special strings, then SPLIT, then MERGE."""

    def __init__(self, tokenizer: str, classes: bytes):
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8)
        self.merge = merge_machine(tokenizer)
        with open(tokenizer, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f)["added_tokens"]]

    def _classes(self, text: str) -> np.ndarray:
        return self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _long(self, text: str) -> int:
        """A text of any length, block by block: each block goes on from the last start of a piece."""
        at, size, n = 0, BLOCK, 0
        while at < len(text):
            part = text[at : at + size]
            starts = np.flatnonzero(piece_marks(self._classes(part)))
            if at + size >= len(text):
                ends = np.append(starts[1:], len(part))
            elif len(starts) < 3:
                size *= 2
                continue
            else:
                # the two last starts may still move, as what follows is not read yet
                starts, ends = starts[:-2], starts[1:-1]
            n += sum(self.merge.counts([part[a:b] for a, b in zip(starts.tolist(), ends.tolist())]))
            at, size = at + int(ends[-1]), BLOCK
        return n

    def _block(self, texts: list[str]) -> np.ndarray:
        whole = "\0".join(texts)
        classes = self._classes(whole)
        ends = np.cumsum([len(x) + 1 for x in texts])[:-1] - 1
        classes[ends] = END
        starts = np.flatnonzero(piece_marks(classes))
        stops = np.append(starts[1:], len(whole))
        true = classes[starts] != END
        starts, stops = starts[true], stops[true]
        counts = self.merge.counts([whole[a:b] for a, b in zip(starts.tolist(), stops.tolist())])
        return np.bincount(np.searchsorted(ends, starts), weights=counts, minlength=len(texts)).astype(np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        n = np.zeros(len(texts), np.int64)
        parts, of = [], []
        for i, text in enumerate(texts):
            split = [text]
            for s in self.special:
                if s in text:
                    split = [y for x in split for y in x.split(s)]
            n[i] = len(split) - 1
            parts += split
            of += [i] * len(split)
        at = 0
        while at < len(parts):
            if len(parts[at]) > BLOCK:
                n[of[at]] += self._long(parts[at])
                at += 1
                continue
            end, size = at, 0
            while end < len(parts) and len(parts[end]) <= BLOCK and size < BLOCK:
                size += len(parts[end])
                end += 1
            np.add.at(n, of[at:end], self._block(parts[at:end]))
            at = end
        return n


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_tokens). tokenizer: path of a byte-level BPE tokenizer file, readable on
    every executor."""
    small_batches(docs.sparkSession)
    classes = char_classes(tokenizer)

    def run(batches):
        count = None
        for b in batches:
            count = count or Counter(tokenizer, classes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(count(b.column(1).to_pylist()), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)
