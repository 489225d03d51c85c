"""Classes against brute force over all pairs; fingerprints against their definition."""

import random

import numpy as np
import pytest
import xxhash

from quire.llm import components as C
from quire.llm import simhash as S


def defined(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, near):
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if near(fps[i], fps[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    least = {}
    for i, x in enumerate(ids):
        r = root(i)
        least[r] = min(least.get(r, float("inf")), float("inf") if x is None else x)
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprint_is_as_defined(odd_rows):
    for r in odd_rows:
        for block in (7, 1 << 20):
            assert S.fingerprint((r[1] or "").encode(), block=block) == defined(r[1])


def test_odd_rows_and_brute_force(odd, none):
    got = S.near_duplicates(odd).collect()
    rows = odd.collect()
    fps = [defined(r.text) for r in rows]
    want = classes([r.doc_id for r in rows], fps, lambda a, b: (a ^ b).bit_count() <= 4)
    want = sorted((r.doc_id is None, r.doc_id, f, w if w < float("inf") else None) for r, f, w in zip(rows, fps, want))
    assert sorted((r.doc_id is None, r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert S.near_duplicates(none).count() == 0


def signed(f):
    return f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("part_rows", [20, 100, 200_000])
def test_links_of_random_fingerprints(spark, part_rows):
    """Clusters and noise, with parts so small that most links lie between parts; many share a leading block."""
    rng = random.Random(part_rows)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(7))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    far = [rng.getrandbits(64) for _ in range(60)]
    fps |= {f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 3, 4, 5]))) for f in far for _ in (0, 1)}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, id long")
    roots = {r.node: r.root for r in C.components(S.index_links(nodes, ["fp"], S.blocks(), 4, part_rows)).collect()}
    want = classes(list(range(len(fps))), fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert [roots.get(i, i) for i in range(len(fps))] == want


def gray_sorted(fp):
    g = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        g ^= g >> np.uint64(k)
    order = np.argsort(g)
    return fp[order], (g[order] >> np.uint64(64 - 12)).astype(np.int64)


def test_tree_equals_all_pairs_and_drops_groups():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    near = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 12, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(30, 40, 150).astype(np.uint64)) for b in base])
    for fp in (np.unique(near), np.unique(np.concatenate([near, rng.integers(0, 1 << 63, 3000, dtype=np.uint64)]))):
        fp, lead = gray_sorted(fp)
        a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4, 1))
        want = S.spanning(len(fp), a, b)
        seen = {}
        assert np.array_equal(S.tree_labels(fp[:, None], np.zeros(len(fp), np.int64), seen=seen), want)
        # with leading blocks, links of fingerprints that agree on theirs
        same = (lead[a] == lead[b]) | (b == a + 1)
        led = {}
        got = S.tree_labels(fp[:, None], lead, seen=led)
        assert np.array_equal(got, S.spanning(len(fp), a[same], b[same]))
    assert seen["dropped"] > 0 and led["dropped"] > 0.3 * led["met"]


def test_index_reaches_the_tree_for_every_part(spark, monkeypatch):
    """No group is searched in another way, however small."""
    rng = random.Random(5)
    nodes = spark.createDataFrame([(signed(rng.getrandbits(64)), i) for i in range(40)], "fp long, id long")
    monkeypatch.setattr(S, "tree_labels", lambda fp, lead, radius: np.zeros(len(fp), int))
    links = S.index_links(nodes, ["fp"], S.blocks(), 4, 200_000)
    assert C.components(links).count() == 39


def test_one_block_agrees_within_four_differences():
    rng = random.Random(1)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x ^ sum(1 << b for b in rng.sample(range(64), 4))
        assert any((x ^ y) >> shift & (1 << width) - 1 == 0 for _, shift, width in S.blocks())


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 3)], "a long, b long")
    got = {r.node: r.root for r in C.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)}


def test_near_copies_go_and_others_stay(spark, odd, none):
    rng = random.Random(5)
    rows = []
    for d in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        copy = list(words)
        copy[rng.randrange(300)] = "changed"
        rows += [(2 * d, " ".join(words)), (2 * d + 1, " ".join(copy))]
    kept = S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [2 * d for d in range(40)]
    out = S.drop_near_duplicates(odd)
    assert out.columns == odd.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(3) == 1 and 4 not in ids and ids.count(None) == 2
    assert S.drop_near_duplicates(none).count() == 0


def jaccard(a, b):
    a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_are_those_of_exact_similarity(spark):
    """Pairs on both sides of 0.8, among them exactly 0.8, against brute force: none is missed and none is false."""
    rng = random.Random(8)
    texts = []
    for d in range(300):
        words = [f"w{d}x{i}" for i in range(304)]  # 300 shingles
        same = 267 if d < 100 else rng.randrange(240, 290)  # of 300 shingles, so the similarity is same / (600 - same)
        texts += [" ".join(words), " ".join(words[: same + 4] + [f"v{d}x{i}" for i in range(300 - same)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in S.drop_near_duplicates(docs).collect()}
    near = [jaccard(texts[2 * d], texts[2 * d + 1]) >= 0.8 for d in range(300)]
    assert 100 < sum(near) < 250
    assert [2 * d + 1 not in kept for d in range(300)] == near and all(2 * d in kept for d in range(300))


def test_one_least_node_does_not_hide_a_link(spark):
    """The node of least id is no near copy of the others, which are near copies of each other."""
    rng = random.Random(9)
    rows, want = [], []
    for d in range(30):
        base = [f"w{d}x{i}" for i in range(304)]
        far = base[:210] + [f"f{d}x{i}" for i in range(94)]
        near = base[:-1] + ["end"]
        three = [" ".join(x) for x in (far, base, near)]
        rng.shuffle(three)
        rows += [(3 * d + i, t) for i, t in enumerate(three)]
        want += sorted([3 * d + three.index(" ".join(far)), 3 * d + min(three.index(" ".join(base)), three.index(" ".join(near)))])
    kept = S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == want


def test_texts_of_one_id_stay_apart(spark):
    """Two texts that share a doc_id are no copies of each other, and each has a near copy of its own that goes."""
    one, two = ([f"{w}{i}" for i in range(304)] for w in "pq")
    near = lambda words: " ".join([*words[:-1], "end"])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (None, near(two))]
    kept = S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, " ".join(one)), (1, " ".join(two)), (0, near(two))])


def test_close_copies_come_from_the_index(spark):
    """Texts within the radius are candidates without MinHash; nodes that share a fingerprint too."""
    rng = random.Random(2)
    fps = [rng.getrandbits(63) for _ in range(50)]
    rows = [(i, f) for i, f in enumerate(fps)] + [(100 + i, f ^ 0b1001) for i, f in enumerate(fps[:20])] + [(200 + i, f) for i, f in enumerate(fps[:5])]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    got = {r.node: r.root for r in C.components(S.fingerprint_links(nodes)).collect()}
    assert got == {100 + i: i for i in range(20)} | {200 + i: i for i in range(5)}


def test_majority_is_the_fingerprint_of_distinct_shingles():
    text = " ".join(f"w{i}" for i in range(70000)).encode()
    assert S.majority(S.shingles(text)) % (1 << 64) == S.fingerprint(text, 5)
