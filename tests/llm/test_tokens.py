import random

import pytest
from tokenizers import Tokenizer

from quire.llm import packing as P
from quire.llm import tokens as K

PARTS = ["'", "s", "t", "re", "ve", "ll", "l", "e", "r", "v", " ", "  ", "\n", "\t", "a", "B", "é", "é", "H̱", "ß", "Σ", "1", "23", "!", "..", " ", "　", "中", "😀", "<|endoftext|>", "don't", "\x1c", "\x85", "​", "½", "\0", "ﬁ", "word.", "word,"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(50))) for _ in range(1500)]
    return [*out, "a" * 3000, " " * 500 + "x", "-" * 300, "ab" * 200]


def test_counts_equal_the_library(texts, vocabulary, monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    count = K.Counter(path, K.char_classes(path))
    for block in (1 << 21, 40):
        monkeypatch.setattr(K, "BLOCK", block)
        assert count(texts).tolist() == want
    monkeypatch.setattr(K, "MAX_STATES", 5)
    monkeypatch.setattr(K, "MAX_PIECES", 5)
    assert count(texts[:300]).tolist() == want[:300]


def test_machine_agrees_with_plain_merging(vocabulary):
    m = K.Merge(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(4)
    for _ in range(400):
        data = bytes(rng.choice(b"thering tionAbc\xc3\xa90") for _ in range(rng.randrange(1, 25)))
        assert m.run(data) == len(m.encode(data))


def test_odd_rows(odd, none, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens) for r in K.count_tokens(odd, path).collect()), key=str)
    want = sorted(((r.doc_id is None, r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()), key=str)
    assert got == want
    assert K.count_tokens(none, path).count() == 0


def test_word_ids_equal_the_library(texts, vocabulary, monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    ids = P.WordIds(path)
    monkeypatch.setattr(P, "MAX_WORDS", 50)
    for block in (1 << 22, 30):
        monkeypatch.setattr(P, "BLOCK", block)
        got = ids([t.encode() for t in texts])
        assert all(g.tolist() == library.encode(t, add_special_tokens=False).ids for g, t in zip(got, texts))


@pytest.mark.parametrize("window,open_windows,fan_in", [(4096, 8, 64), (64, 3, 1), (64, 2, 2)])
def test_packing_is_a_round_trip(odd, none, vocabulary, window, open_windows, fan_in):
    import zlib

    import numpy as np

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = P.pack(odd, path, window, open_windows=open_windows, fan_in=fan_in).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.row_id, r.doc_id), []).append(r)
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
    assert sum(sum(r.length for r in rs) < window for rs in by_sequence.values()) <= (1 if fan_in > 2 else 3)
    # every row, those of null and repeated ids too, is packed whole, known by its row_id
    want = sorted((str(r.doc_id), tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in odd.collect())
    got = []
    for (_, d), rs in by_doc.items():
        rs = sorted(rs, key=lambda r: r.start)
        ids = next(np.array(x, "<u4") for y, x in want if y == str(d) and len(x) == rs[0].doc_tokens and zlib.crc32(np.array(x, "<u4")[: rs[0].length].tobytes()) == rs[0].ids_crc32)
        at = 0
        for r in rs:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        got.append((str(d), tuple(ids.tolist())))
    assert sorted(got) == want
    assert P.pack(none, path).count() == 0


def test_repeated_rows_are_packed_each(odd, vocabulary):
    rows = P.pack(odd, vocabulary("word_bpe_49k.json")).collect()
    assert sum(r.start == 0 for r in rows if r.doc_id == 3) == 3


def test_states_are_bounded_within_a_piece(vocabulary, monkeypatch):
    """One piece of many letters would make a state for each: the machine forgets them and goes on from where it is."""
    path = vocabulary("byte_bpe_50k.json")
    rng = random.Random(9)
    data = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    monkeypatch.setattr(K, "MAX_STATES", 300)
    m = K.Merge(path)
    assert m.run(data.encode()) == len(Tokenizer.from_file(path).encode(data, add_special_tokens=False).ids)
    assert len(m.states) <= 302 and len(m.step) <= 1202
