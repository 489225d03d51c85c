"""Personal data: plain identifiers, and disguised ones found through offset-preserving transducers.

Plain (base) spans are the leftmost non-overlapping matches per kind of the fixed patterns below that pass their checks.
Disguised ones: a first transducer maps characters (compatibility forms and digits of any script by their Unicode
decomposition, look-alike letters and signs by a table, format characters to nothing); a second reads signs and number words
and what lies on either side of them (state and class give the output: bracketed or spelled "at" and "dot", runs of spelled
digits, a spelled plus). Both write a tape that keeps for each piece of output the source characters it came from;
identifiers found in the output that cover a changed piece are mapped back and added, unless they overlap a base span
without containing it, or only lengthen a base number. Base spans always stay. Both run over every text, in time linear in
its length.

A spelled "at" or "dot" without brackets counts only in an address that ends in a known top-level domain; where only the "at"
is spelled so, the name must hold a dot, a digit or an underscore ("meet us at example.com" is prose).

Nulls and odd input: a null or empty text has no spans; a null doc_id stays null; repeated rows are searched each; extra
columns are ignored; an empty table gives an empty result. Positions are code points, the end exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# as [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), which can't start within a run of digits nor give one back
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """The base spans, by start and then kind."""
    found: list[Span] = []
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        # the local part is the whole run before the sign: any shorter start is further right
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL))
        if start < at and (m := _HOST.match(text, at + 1)):
            found.append((start, 0, m.end()))
            free = at = m.end()
        else:
            free = at = at + 1
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# Characters that look like ASCII ones and have no such decomposition, top-level domains, digits and signs in
# words, brackets.
ALIKE = dict(
    zip(
        "АВЕКМНОРСТХУІЈЅавекмнорстхуіјѕԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοιρνυκϲօսհցⲟɑɡıʟᴏᴄᴜᴠᴡᴢꜱ‐‑‒–—−⁃·•∙。ⓐ",
        "ABEKMHOPCTXYIJSaBekmhopctxyijsdqwhlABEZHIKMNOPTYXaoipvukcouhgoagilocuvwzs-------....@",
        strict=True,
    )
)
DOMAINS = "com org net edu gov io info biz int mil dev app co me us uk de fr es eu it nl ch at be pl ca au br mx ru in jp cn example test".split()
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|arroba|arobase", "dot|punto|punkt|point", "plus|más"
OPEN, CLOSE = "([{<", ")]}>"

_DIGIT_OF = {w: str(i) for words in DIGIT_WORDS for i, w in enumerate(words.split())} | {"oh": "0"}
_NUMBER = "|".join(sorted(map(re.escape, _DIGIT_OF), key=len, reverse=True))
_SIGN = re.compile(rf"\b(?:(?P<at>{AT_WORDS})|(?P<dot>{DOT_WORDS})|(?P<plus>{PLUS_WORDS}))\b|[(\[{{<]\s*+(?P<sign>[.@a])\s*+[)\]}}>]")
_RUN = re.compile(rf"\b(?:(?:{_NUMBER})\b|[0-9]++\b)(?:[\s,-]++(?:(?:{_NUMBER})\b|[0-9]++\b))*+")
_PART = re.compile(rf"(?P<word>{_NUMBER})|[0-9]+")
_HOST_BEGIN = re.compile(rf"[A-Za-z0-9-]++(?:\.[A-Za-z0-9]|\s++(?:{DOT_WORDS})\b|\s*+[(\[{{<]\s*+(?:{DOT_WORDS}|\.))", re.I)
_AFTER = re.compile(r"\s*+")
#: The second transducer: (what is on the left, the token's class, what is on the right) -> (output, whether it is loose).
SIGNS = {
    ("space", "at", "space"): ("@", True),
    ("space", "dot", "space"): (".", True),
    ("open", "at", "close"): ("@", False),
    ("open", "dot", "close"): (".", False),
    ("open", "@", "close"): ("@", False),
    ("open", "a", "close"): ("@", False),
    ("open", ".", "close"): (".", False),
}

Edit = tuple[int, int, str, bool]  # start, end, output, loose


class Tape:
    """Output of a transducer with the source of each piece: begins of output, begins and ends of source, changed or not."""

    def __init__(self, text: str, edits: list[Edit]):
        self.out, self.source, self.end, self.edit, parts = [], [], [], [], []
        at = n = 0
        for edit in [*edits, (len(text), len(text), "", False)]:
            for start, end, new, by in ((at, edit[0], text[at : edit[0]], None), (*edit[:3], edit)):
                if end > start:
                    for column, value in zip((self.out, self.source, self.end, self.edit, parts), (n, start, end, by, new)):
                        column.append(value)
                    n += len(new)
            at = edit[1]
        self.text = "".join(parts)

    def back(self, start: int, end: int) -> tuple[int, int, list[Edit]]:
        """Source span of an output span, and the edits in it."""
        i, j = bisect_right(self.out, start) - 1, bisect_right(self.out, end - 1) - 1
        begin = self.source[i] if self.edit[i] else self.source[i] + start - self.out[i]
        stop = self.end[j] if self.edit[j] else self.source[j] + end - self.out[j]
        return begin, stop, [e for e in self.edit[i : j + 1] if e]


@cache
def plain_char(c: str) -> str | None:
    """What a character beyond ASCII stands for, null if for itself."""
    if c in ALIKE:
        return ALIKE[c]
    kind = unicodedata.category(c)
    if kind == "Cf" or "\ufe00" <= c <= "\ufe0f":
        return ""
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if unicodedata.decomposition(c).startswith("<"):
        plain = "".join(ALIKE.get(x, x) for x in unicodedata.normalize("NFKC", c))
        return plain if plain.isascii() else None
    return None


def char_edits(text: str) -> list[Edit]:
    if text.isascii():
        return []
    odd = {c: plain for c in set(text) if c > "\x7f" and (plain := plain_char(c)) is not None}
    return [(m.start(), m.end(), odd[m[0]], False) for m in re.finditer(f"[{''.join(odd)}]", text)] if odd else []


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def token_edits(text: str) -> list[Edit]:
    low, n = _lower(text), len(text)
    runs = {m.end(): m for m in _RUN.finditer(low)}
    run_at = {m.start(): m for m in runs.values()}
    signs: list[Edit] = []
    plus: dict[int, int] = {}  # begin of what follows a spelled plus -> its own begin
    free = 0  # no sign looks back beyond the one before

    def left_of(at: int) -> int:
        return free + len(text[free:at].rstrip())

    for m in _SIGN.finditer(low):
        kind, start, end = m.lastgroup, *m.span()
        if kind == "plus":
            plus[_AFTER.match(text, end).end()] = start
            free = end
            continue
        if kind == "sign":
            state = ("open", m["sign"], "close")
        else:
            a, b = left_of(start), _AFTER.match(text, end).end()
            boxed = a > free and b < n and text[a - 1] in OPEN and text[b] in CLOSE
            state = ("open" if boxed else "space" if a < start else "", kind, "close" if boxed else "space" if b > end else "")
            start, end = (a - 1, b + 1) if boxed else (start, end)
        output, loose = SIGNS.get(state, (None, False))
        if output:
            a, b = left_of(start), _AFTER.match(text, end).end()
            before, behind = text[a - 1] if a > free else "", text[b] if b < n else ""
            if output == "@":
                fits = before and before in LOCAL and _HOST_BEGIN.match(text, b)
            else:
                fits = before.isascii() and before.isalnum() and behind.isascii() and behind.isalnum() or (a in runs and b in run_at)
            if fits:
                signs.append((a, b, output, loose))
                end = b
        free = end
    address = "@" in text or any(e[2] == "@" for e in signs)
    number = lambda a, b: (a in runs or text[a - 1 : a].isdigit()) and (b in run_at or text[b : b + 1].isdigit())
    signs = [e for e in signs if e[2] == "@" or address or number(*e[:2])]
    dots = {x for e in signs if e[2] == "." for x in e[:2]}
    edits = list(signs)
    for m in runs.values():
        start, end = m.span()
        parts = list(_PART.finditer(low, start, end))
        spelled = any(p["word"] for p in parts)
        a = plus.get(start)
        if a is None and start and spelled:  # a plus sign before a run, with or without a blank
            b = start - 1 if text[start - 1].isspace() else start
            a = b - 1 if b and text[b - 1] == "+" else None
        dotted = start in dots or end in dots or text[end : end + 1] == "." and number(end, end + 1) or text[start - 1 : start] == "." and number(start - 1, start)
        if spelled and (len(parts) > 1 or a is not None or dotted):
            digits = "".join(_DIGIT_OF[p[0]] if p["word"] else p[0] for p in parts)
            edits.append((start if a is None else a, end, digits if a is None else f"+{digits}", False))
        elif a is not None:
            edits.append((a, start, "+", False))
    edits.sort(key=lambda e: e[:2])
    at, out = 0, []
    for e in edits:
        if e[0] >= at:
            out.append(e)
            at = e[1]
    return out


def _address(text: str, start: int, end: int, changed: list[Edit]) -> int | None:
    """Where a disguised address ends: behind its last label that can be a domain; null if it is none."""
    loose = {e[2] for e in changed if e[3]}
    dots = any(e[2] == "." for e in changed)
    known = DOMAINS if loose else None
    name, host = text[start:end].split("@", 1)
    if "@" in loose and not dots and not re.search("[._0-9]", name):
        return None
    labels = host.split(".")
    while len(labels) > 1 and not (labels[-1].lower() in known if known else re.fullmatch("[A-Za-z]{2,}", labels[-1])):
        end -= len(labels.pop()) + 1
    return end if len(labels) > 1 else None


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    chars = char_edits(text)
    first = Tape(text, chars)
    tokens = token_edits(first.text)
    if not chars and not tokens:
        return []
    second = Tape(first.text, tokens)
    found: list[Span] = []
    of_kind = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]  # each in order and disjoint

    def overlapping(a, b):
        for k, spans in enumerate(of_kind):
            i = bisect_right(spans, a, key=lambda x: x[1])
            while i < len(spans) and spans[i][0] < b:
                yield spans[i][0], k, spans[i][1]
                i += 1

    for start, kind, end in plain_spans(second.text):
        a, b, changed = second.back(start, end)
        if kind == 0:
            end = _address(second.text, start, end, changed)
            if end is None:
                continue
            a, b, changed = second.back(start, end)
        a, b, odd = first.back(a, b)
        while a < b and text[b - 1].isspace():
            b -= 1
        while a < b and text[a].isspace():
            a += 1
        # number words behind a plain number do not lengthen it
        if (changed or odd) and a < b and all(a <= s and e <= b and (a, b) != (s, e) and (k != kind or not kind) for s, k, e in overlapping(a, b)):
            found.append((a, kind, b))
    return sorted(found)


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans)."""
    base = plain_spans(text)
    more = disguised_spans(text, base) if text else []
    return base, sorted(base + more) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def mask(text: str) -> str:
    """Every span (overlapping ones together) becomes the upper-case name of its first kind in brackets; again until none is
    left, as a span may stand free once its neighbour is masked."""
    while (masked := _mask_once(text)) != text:
        text = masked
    return text


def _mask_once(text: str) -> str:
    out, at = [], 0
    _, spans = find(text)
    i = 0
    while i < len(spans):
        start, kind, end = spans[i]
        while (i := i + 1) < len(spans) and spans[i][0] < end:
            end = max(end, spans[i][2])
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]]) if out else text


def find_pii(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_disguised."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, every = find(text)
                rows.append((*(sum(s[1] == k for s in base) for k in range(4)), sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip([*zip(*rows)] or [()] * 7, types))], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"])

    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")


def masked(text: Column) -> Column:
    @F.pandas_udf("string")
    def one(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(mask, na_action="ignore")

    return one(text)


def mask_pii(docs: DataFrame) -> DataFrame:
    """The same rows with identifiers masked in text, and n_chars, if there is such a column, counted anew; a null text stays
    null."""
    small_batches(docs.sparkSession)
    out = docs.withColumn("text", masked(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
