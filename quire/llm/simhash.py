"""SimHash near-duplicate classes by a Gray-order hierarchical index.

Fingerprints: 64 bits over 4-word shingles. Links: at most `radius` (4) differing bits. Two fingerprints within 4 bits agree
on one of five blocks at least, so there are five tables, each one global order of all distinct fingerprints by the Gray rank
that they have with that block in front. A table is cut into parts, the upper nodes of the index; within a part, and between
parts that may hold a link, a tree of shared masked bit patterns is descended from the root, with the differences
accumulated on the way down, and whole groups are dropped once these exceed the radius. The tree gives spanning links only
(never all pairs); components() joins them.

Nulls and odd input: a null or blank text has fingerprint zero and is linked like any other; repeated rows each keep their
row; a null doc_id counts as larger than every other and component_id is null where a class has no other id; doc_id must
be below 2**62. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import materialize, shuffle_partitions, small_batches, table, utf8
from quire.llm.components import components

WORDS, SEED, RADIUS = 4, 42, 4
#: Bytes of a text that are split into words at once, and shingles that are hashed at once.
BLOCK = 1 << 20
#: Rows of one part of the index; children of a tree node, and pairs of nodes that are descended at once.
PART_ROWS, LEAF, NODE_PAIRS = 200_000, 16, 4096
#: Bits of a leading block by which parts look each other up.
CELL_BITS = 10
# similar_texts(): words of a shingle, MinHash bands and minima of each, least Jaccard similarity as a fraction.
SHINGLE_WORDS, BANDS, BAND_ROWS, SIMILARITY, GROUP_ROWS = 5, 32, 5, (4, 5), 1500
#: Ids of classes without any doc_id start here.
NO_ID = 1 << 62
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _word_runs(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, a bounded number at a time."""
    at = 0
    while at < len(data):
        cut = len(data) if at + size >= len(data) else (m.start() if (m := _SPACE.search(data, at + size)) else len(data))
        yield data[at:cut].lower().split()
        at = cut


def votes(data: bytes, words: int = WORDS, lanes: int = 1, block: int = BLOCK) -> tuple[np.ndarray, int]:
    """Per bit (64 a lane) the number of shingles whose hash sets it, and the number of shingles. The first lane has the
    hash itself, further lanes mix it anew."""
    from xxhash import xxh64_intdigest

    total, n, kept = np.zeros(64 * lanes, np.int64), 0, []

    def add(hashes: np.ndarray) -> None:
        for lane in range(lanes):
            h = hashes
            if lane:
                h = h + np.uint64(0x9E3779B97F4A7C15 * lane % (1 << 64))
                h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                h = h ^ h >> np.uint64(31)
            for i in range(0, len(h), 1 << 15):
                total[64 * lane : 64 * lane + 64] += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)

    for more in _word_runs(data, block):
        kept += more
        if len(kept) < words:
            continue
        add(np.fromiter((xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(islice(kept, i, None) for i in range(words)))), np.uint64, len(kept) - words + 1))
        n += len(kept) - words + 1
        kept = kept[len(kept) - words + 1 :] if words > 1 else []
    if not n and kept:
        add(np.array([xxh64_intdigest(b" ".join(kept), SEED)], np.uint64))
        n = 1
    return total, n


def fingerprint(data: bytes, words: int = WORDS, block: int = BLOCK) -> int:
    """The unsigned fingerprint of UTF-8 bytes."""
    total, n = votes(data, words, 1, block)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, words) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, fp long")


Block = tuple[int, int, int]  # word of the fingerprint, lowest bit, bits


def blocks(radius: int = RADIUS, bits: int = 64) -> list[Block]:
    """radius + 1 blocks of one word: fingerprints that differ in at most `radius` bits agree on one of them at least."""
    edge = [bits * i // (radius + 1) for i in range(radius + 2)]
    return [(0, a, b - a) for a, b in zip(edge, edge[1:])]


def spanning(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least member of each of n nodes' classes under the links a-b."""
    label = np.arange(n) if label is None else label
    while len(a):
        la, lb = label[a], label[b]
        if not (apart := la != lb).any():
            break
        la, lb = la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def differing(bits: np.ndarray) -> np.ndarray:
    """Set bits of each row."""
    return np.bitwise_count(bits).sum(axis=1, dtype=np.int16)


def tree_labels(fp: np.ndarray, lead: np.ndarray, radius: int = RADIUS, leaf: int = LEAF, seen: dict | None = None) -> np.ndarray:
    """Class of each fingerprint (row of 64-bit words) of one Gray-sorted run.

    The fingerprints are the leaves of a tree; an upper node holds the bits that all below it share (mask and pattern) and the
    range of their leading block. Pairs of nodes are descended together from the root. A pair carries the differences found
    so far and adds those in the bits that its two nodes share and their parents did not; it is dropped, with all that lies
    below, once these exceed `radius`, once the leading blocks can't be equal, or once all below are one class. seen counts
    pairs of nodes met and dropped above the leaves."""
    n = len(fp)
    near = np.flatnonzero(differing(fp[1:] ^ fp[:-1]) <= radius)
    label = spanning(n, near, near + 1)
    ands, ors, low, high, sizes = [fp], [fp], [lead], [lead], [n]
    while sizes[-1] > 1:
        at = np.arange(0, sizes[-1], leaf)
        for levels, merge in ((ands, np.bitwise_and), (ors, np.bitwise_or), (low, np.minimum), (high, np.maximum)):
            levels.append(merge.reduceat(levels[-1], at))
        sizes.append(len(at))
    masks = [~(x ^ y) for x, y in zip(ands, ors)]

    def only(label):
        """Per level: the class of a node whose fingerprints all have one, else -1."""
        least, most, out = label, label, [label]
        for size in sizes[:-1]:
            at = np.arange(0, size, leaf)
            least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            out.append(np.where(least == most, least, -1))
        return out

    one = only(label)
    stack = [(len(sizes) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int16))]
    i, j = (x.ravel() for x in np.divmod(np.arange(leaf * leaf), leaf))
    while stack:
        level, p, q, differ = stack.pop()
        if len(p) > NODE_PAIRS:
            stack += [(level, p[NODE_PAIRS:], q[NODE_PAIRS:], differ[NODE_PAIRS:]), (level, p[:NODE_PAIRS], q[:NODE_PAIRS], differ[:NODE_PAIRS])]
            continue
        open_ = (one[level][p] != one[level][q]) | (one[level][p] < 0)
        p, q, differ = p[open_], q[open_], differ[open_]
        if not level:
            if len(p):
                label = spanning(n, p, q, label)
                one = only(label)
            continue
        a, b = (p[:, None] * leaf + i).ravel(), (q[:, None] * leaf + j).ravel()
        above = np.repeat(np.arange(len(p)), leaf * leaf)
        met = (a <= b if level > 1 else a < b) & (b < sizes[level - 1])
        a, b, above = a[met], b[met], above[met]
        kept = (low[level - 1][a] <= high[level - 1][b]) & (low[level - 1][b] <= high[level - 1][a])
        a, b, above = a[kept], b[kept], above[kept]
        fresh = masks[level - 1][a] & masks[level - 1][b] & ~(masks[level][p] & masks[level][q])[above]
        differ = differ[above] + differing((ands[level - 1][a] ^ ands[level - 1][b]) & fresh)
        kept = differ <= radius
        if seen is not None and level > 1:
            seen["met"] = seen.get("met", 0) + int(met.sum())
            seen["dropped"] = seen.get("dropped", 0) + int(met.sum() - kept.sum())
        if kept.any():
            stack.append((level - 1, a[kept], b[kept], differ[kept]))
    return label


def filed(nodes: DataFrame, fps: list[str], tables: list[Block]) -> DataFrame:
    """nodes(*fps, id) -> (t, lead, *places, *fps, id), one row in each table: in table t the fingerprint is turned until block
    t leads; lead is the block's Gray rank and places are the Gray ranks of the words, as signed longs in unsigned order."""

    def turned(t: int, block: Block) -> Column:
        word, shift, width = block
        up, first = shift + width, F.col(fps[word])
        words = [F.shiftleft(first, 64 - up).bitwiseOR(F.shiftrightunsigned(first, up)) if up < 64 else first]
        words += [F.col(c) for k, c in enumerate(fps) if k != word]
        return F.struct(F.lit(t).alias("t"), F.lit(64 - width).alias("rest"), *(w.alias(f"place{k}") for k, w in enumerate(words)))

    out = nodes.select(*fps, "id", F.explode(F.array(*(turned(t, x) for t, x in enumerate(tables)))).alias("x")).select("x.*", *fps, "id")
    places = [f"place{k}" for k in range(len(fps))]
    # place in Gray order: each bit becomes the parity of those from it upwards, a column for each step
    for k in (1, 2, 4, 8, 16, 32):
        out = out.withColumns({c: F.col(c).bitwiseXOR(F.shiftrightunsigned(F.col(c), k)) for c in places})
    lead = F.expr("shiftrightunsigned(place0, rest)").alias("lead")
    return out.select("t", lead, *(F.col(c).bitwiseXOR(F.lit(-(1 << 63))).alias(c) for c in places), *fps, "id")


def index_links(nodes: DataFrame, fps: list[str], tables: list[Block], radius: int = RADIUS, part_rows: int = PART_ROWS) -> DataFrame:
    """nodes(*fps, id), a written table of distinct fingerprints -> (a, b): links that connect just what links of at most
    `radius` differing bits connect.

    Each table is one global Gray order, cut by range into parts of about part_rows, however many share a block: no bucket is
    too large for a task and none is cut into all pairs of pieces. The parts are the index's upper nodes, with mask, pattern
    and range of the leading block. Pairs of parts that can hold a link meet, and of a part only those rows that the other's
    node does not rule out; each part, and each such pair, is searched by tree_labels()."""
    spark = nodes.sparkSession
    places = [f"place{k}" for k in range(len(fps))]
    order = ["t", "lead", *places]
    parts = max(2 * shuffle_partitions(spark), -(-nodes.count() * len(tables) // part_rows))
    dealt = materialize(filed(nodes, fps, tables).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "gray-order")
    ends = [F.min("lead").alias("lo"), F.max("lead").alias("hi")]
    upper = materialize(dealt.groupBy("t", "part").agg(*ends, *(F.bit_and(c).alias(f"and_{c}") for c in fps), *(F.bit_or(c).alias(f"or_{c}") for c in fps)), "upper-nodes")
    # parts meet where their leading blocks do, looked up in cells of the block's range
    cell = [F.shiftrightunsigned(F.col(c), max(0, max(w for _, _, w in tables) - CELL_BITS)) for c in ("lo", "hi")]
    celled = upper.withColumn("cell", F.explode(F.sequence(*cell)))
    mine, other = celled, celled.select("t", "cell", *(F.col(c).alias(f"o_{c}") for c in upper.columns if c != "t"))
    mask = lambda c, side="": F.bitwise_not(F.col(f"{side}and_{c}").bitwiseXOR(F.col(f"{side}or_{c}")))
    shared = sum((F.bit_count(F.col(f"and_{c}").bitwiseXOR(F.col(f"o_and_{c}")).bitwiseAND(mask(c)).bitwiseAND(mask(c, "o_"))) for c in fps), F.lit(0))
    pairs = mine.join(other, ["t", "cell"]).where((F.col("lo") <= F.col("o_hi")) & (F.col("o_lo") <= F.col("hi")) & (shared <= radius)).drop("cell", "lo", "hi", *(f"{x}_{c}" for x in ("and", "or") for c in fps)).distinct()
    pairs = materialize(pairs, "part-pairs").withColumns({"i": F.least("part", "o_part"), "j": F.greatest("part", "o_part")})
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_and_{c}")).bitwiseAND(mask(c, "o_"))) for c in fps), F.lit(0))
    meets = (F.col("i") == F.col("j")) | (F.col("lead").between(F.col("o_lo"), F.col("o_hi")) & (apart <= radius))
    rows = dealt.join(pairs, ["t", "part"]).where(meets).select("t", "i", "j", "lead", *places, *fps, "id")

    def run(batches):
        kept = None
        for b in batches:
            t = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            new = np.zeros(len(t), bool)
            for c in ("t", "i", "j"):
                c = t.column(c).to_numpy()
                new[1:] |= c[1:] != c[:-1]
            starts = np.append(0, np.flatnonzero(new))
            for a, e in zip(starts[:-1], starts[1:]):
                yield from found(t.slice(a, e - a))
            kept = t.slice(int(starts[-1]))
        if kept is not None:
            yield from found(kept)

    def found(t):
        if len(t) > 1:
            fp = np.stack([t.column(c).to_numpy().view(np.uint64) for c in fps], axis=1)
            label, ids = tree_labels(fp, t.column("lead").to_numpy(), radius), t.column("id").to_numpy()
            moved = np.flatnonzero(label != np.arange(len(t)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[label[moved]], pa.int64())], ["a", "b"])

    small_batches(spark, 20_000)
    dealt_pairs = rows.repartition(shuffle_partitions(spark), "t", "i", "j").sortWithinPartitions("t", "i", "j", "lead", *places)
    out = materialize(dealt_pairs.select("t", "i", "j", "lead", *fps, "id").mapInArrow(run, "a long, b long"), "links")
    small_batches(spark)
    return out


def _classes(prints: DataFrame, fps: list[str], tables: list[Block], radius: int, part_rows: int) -> DataFrame:
    """prints(doc_id, *fps) -> (doc_id, *fps, component_id)."""
    own = F.coalesce(F.min("doc_id"), F.lit(NO_ID) + F.shiftrightunsigned(F.col(fps[0]), 2))
    nodes = materialize(prints.groupBy(*fps).agg(own.alias("id"), *(F.first(c).alias(c) for c in prints.columns if c not in (*fps, "doc_id"))), "nodes")
    roots = components(index_links(nodes, fps, tables, radius, part_rows))
    named = nodes.join(roots, nodes["id"] == roots["node"], "left").select(*(nodes[c].alias(f"_{c}") for c in fps), F.coalesce("root", "id").alias("root"))
    named = materialize(named, "named")
    same = [prints[c] == named[f"_{c}"] for c in fps]
    root = F.when(F.col("root") < NO_ID, F.col("root"))
    return prints.join(named, same).select("doc_id", *fps, root.alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, part_rows: int = PART_ROWS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp, component_id), one row per row of docs: classes of 64-bit fingerprints."""
    prints = materialize(fingerprints(docs, words), "prints")
    return _classes(prints, ["fp"], blocks(radius), radius, part_rows)


def shingles(data: bytes, words: int = SHINGLE_WORDS, block: int = BLOCK) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes; a text of fewer words is one shingle, one of no words has none."""
    from xxhash import xxh64_intdigest

    found, kept = [], []
    for more in _word_runs(data, block):
        kept += more
        if len(kept) >= words:
            found.append(np.unique(np.fromiter((xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(islice(kept, i, None) for i in range(words)))), np.uint64, len(kept) - words + 1)))
            kept = kept[len(kept) - words + 1 :] if words > 1 else []
    if not found and kept:
        found.append(np.array([xxh64_intdigest(b" ".join(kept), SEED)], np.uint64))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, (2, BANDS * BAND_ROWS), dtype=np.uint32)


_TIMES, _PLUS = _multipliers()


def band_keys(found: np.ndarray) -> np.ndarray:
    """MinHash keys of a set of shingles, one of each band: two sets of Jaccard similarity s share a given one with
    probability s to the power BAND_ROWS."""
    least = np.full(BANDS * BAND_ROWS, (1 << 32) - 1, np.uint32)
    low = (found >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 2048):
        np.minimum(least, (low[i : i + 2048, None] * (_TIMES | np.uint32(1)) + _PLUS).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def majority(found: np.ndarray) -> int:
    """The fingerprint of a set of hashed shingles."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 15):
        total += np.unpackbits(found[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(found), bitorder="little").view(np.int64)[0])


def shingled(docs: DataFrame) -> DataFrame:
    """docs(text_key, text) -> (text_key, node, n, fp, keys): node stands for the set of shingles, n is its size, fp its
    fingerprint."""
    from xxhash import xxh64_intdigest

    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            nodes, sizes, fps, keys = [], [], [], []
            for x in b.column(1).to_pylist():
                found = shingles(x)
                nodes.append(xxh64_intdigest(found.tobytes(), SEED) >> 1)
                sizes.append(len(found))
                fps.append(majority(found))
                keys.append(band_keys(found))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), lists], ["text_key", "node", "n", "fp", "keys"])

    return docs.select("text_key", utf8(F.col("text")).alias("text")).mapInArrow(run, "text_key long, node long, n int, fp long, keys array<long>")


def exact_links(ids: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> list[tuple[int, int]]:
    """Links (id, id) that connect just what all pairs of the Jaccard similarity connect: a pair shares a shingle among the
    rarest ones of both, as many as either may lack, and one more; pairs of one class are not compared again."""
    over, under = similarity
    every, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(every), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(every))
    ranked = np.split(rank[place], np.cumsum([len(x) for x in sets])[:-1])
    label, holders, links = list(range(len(sets))), {}, []

    def root(i):
        while label[i] != i:
            label[i] = i = label[label[i]]
        return i

    for x in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        size, seen = len(sets[x]), set()
        prefix = np.sort(ranked[x])[: size - -(-size * over // under) + 1].tolist()
        for t in prefix:
            for of, members in holders.get(t, {}).items():
                if root(of) == root(x):
                    continue
                for y in members:
                    if y in seen or len(sets[y]) * under < size * over:
                        continue
                    seen.add(y)
                    same = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if same * under >= (size + len(sets[y]) - same) * over:
                        links.append((int(ids[x]), int(ids[y])))
                        label[root(x)] = root(of)
                        break
        for t in prefix:
            holders.setdefault(t, {}).setdefault(root(x), []).append(x)
    return links


def confirmed(grouped: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """grouped(root, node, text) -> (a, b): the exact links within each group. A group of more than group_rows is cut into
    chunks and each pair of chunks is one group of its own."""
    spark = grouped.sparkSession
    sizes = grouped.groupBy("root").count().where(F.col("count") > group_rows)
    hot = materialize(sizes.select(F.col("root").alias("_root"), F.ceil(F.col("count") / group_rows).cast("int").alias("m")), "hot-groups")
    cut = grouped.join(hot, F.col("root") == F.col("_root"), "left").withColumn("c", F.pmod(F.xxhash64("node"), F.coalesce("m", F.lit(1))).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda o: o != F.col("c"))
    cut = cut.withColumn("o", F.explode(F.coalesce(others, F.array(F.lit(0)))))
    rows = cut.select("root", F.least("o", "c").alias("i"), F.greatest("o", "c").alias("j"), "node", "text")

    def run(batches):
        last, ids, sets = None, [], []
        for b in batches:
            for *key, node, text in zip(*(c.to_pylist() for c in b.columns)):
                if key != last:
                    yield from found(ids, sets)
                    last, ids, sets = key, [], []
                ids.append(node)
                sets.append(shingles(text))
        yield from found(ids, sets)

    def found(ids, sets):
        if len(ids) > 1 and (links := exact_links(ids, sets)):
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    small_batches(spark, 128)
    dealt = rows.repartition(shuffle_partitions(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    out = materialize(dealt.mapInArrow(run, "a long, b long"), "confirmed")
    small_batches(spark)
    return out


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, part_rows: int = PART_ROWS) -> DataFrame:
    """nodes(node, fp), several of which may share a fingerprint -> (a, b): links that connect just what links of at most
    `radius` differing bits connect, by the Gray-order index."""
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("id")), "firsts")
    equal = nodes.join(firsts.hint("merge"), "fp").where("node <> id").select(F.col("id").alias("a"), F.col("node").alias("b"))
    return index_links(firsts, ["fp"], blocks(radius), radius, part_rows).unionByName(equal)


def minhash_links(nodes: DataFrame) -> DataFrame:
    """nodes(node, keys) -> (a, b): every node with the least node of each MinHash key that it has."""
    rows = materialize(nodes.select("node", F.explode("keys").alias("k")), "filed")
    least = rows.groupBy("k").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a < most").select("k", "a")
    return rows.join(materialize(least, "least").hint("merge"), "k").where("a <> node").select("a", F.col("node").alias("b"))


def similar_texts(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """docs(text_key, text) -> (text_key, root): classes of texts that links of Jaccard similarity 0.8 or more connect.

    Texts are compared as sets of five-word shingles; equal sets are one node. Candidates come from two sides: fingerprints
    within RADIUS bits, by the Gray-order index, which is certain to give the closest copies; and MinHash, as a pair of just
    0.8 differs in 10 of 64 bits on average, beyond any radius that an index can prune: candidates share one of BANDS keys of
    BAND_ROWS minima each, and such a pair is missed with probability (1 - 0.8**5)**32 = 3e-6. Nodes that candidates connect
    form a group, and each group is searched for all links by exact similarity."""
    found = materialize(shingled(docs.dropDuplicates(["text_key"])), "shingled")
    nodes = found.where("n > 0").groupBy("node").agg(F.min(F.struct("text_key", "n", "fp", "keys")).alias("x")).select("node", "x.text_key", "x.fp", "x.keys")
    nodes = materialize(nodes, "nodes")
    edges = fingerprint_links(nodes.select("node", "fp")).unionByName(minhash_links(nodes.select("node", "keys")))
    groups = components(edges.distinct())
    members = groups.select("node", "root").unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    wanted = nodes.select("node", "text_key").join(materialize(members, "members").hint("merge"), "node").select("text_key", "node", "root")
    texts = docs.dropDuplicates(["text_key"]).join(materialize(wanted, "wanted").hint("merge"), "text_key")
    roots = components(confirmed(materialize(texts.select("root", "node", utf8(F.col("text")).alias("text")), "texts"), group_rows))
    return found.join(roots, "node", "left").select("text_key", F.coalesce("root", "node").alias("root"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class stays: the one with the least doc_id. Rows without an id all stay, as no rank orders them."""
    keyed = docs.withColumn("text_key", F.xxhash64(utf8(F.col("text"))))
    roots = materialize(similar_texts(keyed.select("text_key", "text")), "roots")
    ids = keyed.where("doc_id is not null").select(F.col("doc_id"), "text_key").join(roots, "text_key")
    low = ids.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
    low = materialize(low.select("x.doc_id", "x.text_key").withColumn("_kept", F.lit(True)), "low")
    # the same join at every size: texts are dealt by id, never the ids broadcast
    kept = keyed.join(low.hint("merge"), ["doc_id", "text_key"]).withColumn("_at", F.row_number().over(W.partitionBy("doc_id", "text_key").orderBy("doc_id")))
    return kept.where("_at = 1").select(docs.columns).unionByName(docs.where("doc_id is null").select(docs.columns))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
