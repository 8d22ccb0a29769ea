"""Near-duplicates: MinHash signatures in an LSH forest, confirmed on full shingle sets.

1. One pass computes, for each text, the digest of its normalised words, the size of its
   shingle set and a MinHash signature. Texts with equal words are one class from here on, so a
   group of exact copies is one row however large it is.
2. Forest: TREES sorted orders of the signatures, each beginning at another of its components.
   All orders are range-partitioned and sorted; rows that stand next to each other share the
   longest prefix, and are candidates from MIN_DEPTH common components on. How deep a row is
   matched adapts to its region (the rows that share MIN_DEPTH components): two or three rows are
   compared with each other at that depth, in a larger region a row meets those with which it has
   the deepest prefix. Rows at the partitions' edges are paired in a second, tiny pass.
3. Candidates whose signatures agree too little for the threshold (more than five standard errors
   below) go. The rest is confirmed on full sets in rounds: first the best candidate of each
   text, which joins most of a cluster; pairs inside one component need no further test, since
   only reachability counts; the last round tests every pair that still crosses components.
4. Where a region of CROWDED rows or more still has several components, close texts may stand apart
   in every order. All rows of such regions are joined exactly (`prefix_pairs`): two sets above the
   threshold share a shingle among the first of each in one order of all shingles, rarest first.
   Texts of one template that stay below the threshold have more shingles of their own than such a
   prefix holds, so what they have in common makes no pairs. The pairs are confirmed as in 3.
5. Components by smallest label with pointer jumping, on a written table in each step.

A pair at similarity 0.75 shares MIN_DEPTH components in one tree with chance 0.32, so all TREES
miss it with chance 5e-6; closer pairs less. A pair that shares them is either tested, or in one
component already.

Cases: a text that is null or without words has an empty set (0), no link, and is its own
component; fewer than `width` words make one shingle; a doc_id on several rows is one document
that has the links of all its texts (and is linked by them); rows without doc_id take part, their component_id is the
smallest id reachable (null if there is none) and kept is true only then; an empty table gives an
empty result. Extra columns are not read. Nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, Scratch, mix64, small_batches

WIDTH, PERCENT = 5, 75
TREES, MIN_DEPTH, MAX_DEPTH = 32, 4, 12
HASHES = TREES * MIN_DEPTH
#: Signatures that agree on a smaller share cannot belong to a link, but with chance below 1e-6.
MIN_AGREE = 0.55
#: A list of ids or regions up to this length is broadcast; longer ones are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Smaller regions are compared in full.
CROWDED = 4
#: Rows of a shingle that meet in one task; of a shingle with more, two blocks of so many.
TILE = 1024
PREFIX_ROW = ("shingle", "low", "high", "block", "label", "node", "n", "at", "short")
#: Rounds that test only the best pair of each text, before the one that tests all that is left.
BEST_ROUNDS = 2

_RNG = np.random.default_rng(20_240_229)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ODD = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 2**63, 64, dtype=np.uint64)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def shingle_set(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - k + 1, np.uint64(len(words) if len(words) < width else 0), np.uint64)
        for i in range(k):
            total = mix64(total + h[i : len(h) - k + 1 + i] * _ODD[i % len(_ODD)])
    return np.unique(total)


def signature(shingles: np.ndarray) -> bytes:
    """HASHES minima of 16 bits each, big-endian so that bytes sort as numbers."""
    best = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 256):
            part = shingles[at : at + 256, None] * _A + _B
            np.minimum(best, part.min(axis=0), out=best)
    return mix64(best).astype(np.uint64).__rshift__(np.uint64(48)).astype(">u2").tobytes()


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _signed(width: int):
    @F.arrow_udf("struct<cls:binary,n:long,sig:binary>")
    def signed(texts: pa.Array) -> pa.Array:
        cls, n, sig = [], [], []
        for t in texts.to_pylist():
            words = words_of(t)
            s = shingle_set(words, width)
            n.append(len(s))
            cls.append(digest(words) if words else None)
            sig.append(signature(s) if words else None)
        return pa.StructArray.from_arrays([pa.array(cls, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], names=["cls", "n", "sig"])

    return signed


def _sets(width: int):
    @F.arrow_udf("struct<cls:binary,shingles:binary>")
    def sets(texts: pa.Array) -> pa.Array:
        words = [words_of(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([digest(w) for w in words], pa.binary()), pa.array([shingle_set(w, width).tobytes() for w in words], pa.binary())], names=["cls", "shingles"])

    return sets


def _digested():
    @F.arrow_udf("binary")
    def digested(texts: pa.Array) -> pa.Array:
        """The class of a text; null without words."""
        words = [words_of(t) for t in texts.to_pylist()]
        return pa.array([digest(w) if w else None for w in words], pa.binary())

    return digested


@F.arrow_udf(T.DoubleType())
def agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal signature components."""
    x, y = (np.frombuffer(b"".join(v.to_pylist()), ">u2").reshape(-1, HASHES) for v in (a, b))
    return pa.array((x == y).mean(axis=1))


def _similar(percent: int):
    @F.arrow_udf("boolean")
    def similar(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            out.append(both > 0 and 100 * both >= percent * (len(x) // 8 + len(y) // 8 - both))
        return pa.array(out, pa.bool_())

    return similar


PAIRED = "tree int, a long, b long, key binary"


def _key(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * MAX_DEPTH).view(">u2")


class Regions:
    """Sorted rows (tree, key, node), batch by batch, to candidate pairs and rows of crowded regions.

    A region is a run of rows of one tree that share MIN_DEPTH components. Only the unfinished
    region is held: all of it below CROWDED rows, its last row beyond. What is found does not
    depend on where batches end."""

    def __init__(self):
        self.tree, self.key, self.node = np.zeros(0, np.int32), np.zeros((0, MAX_DEPTH), ">u2"), np.zeros(0, np.int64)
        self.first = True  # the region that is held began the partition, so it may go on before it
        self.told = False  # its held rows are known as crowded

    def add(self, tree: np.ndarray, key: np.ndarray, node: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends a and b of new pairs, and the positions in self of rows of crowded regions."""
        held = len(self.tree)
        self.tree, self.key, self.node = (np.concatenate(x) for x in ((self.tree, tree), (self.key, key), (self.node, node)))
        n = len(self.tree)
        if not n:
            return self.node, self.node, np.zeros(0, np.int64)
        same = (self.key[1:, :MIN_DEPTH] == self.key[:-1, :MIN_DEPTH]).all(axis=1) & (self.tree[1:] == self.tree[:-1])
        start = np.flatnonzero(np.concatenate([[True], ~same]))
        size = np.diff(np.append(start, n))
        i = np.flatnonzero(same)
        i = i[i + 1 >= held]
        pairs = [(i, i + 1)]
        # a region of three rows is searched in full
        done = len(start) if last else len(start) - 1
        three = start[:done][size[:done] == 3]
        if self.told:
            three = three[three > 0]
        pairs.append((three, three + 2))
        crowd = size >= CROWDED
        crowd[0] |= self.first or self.told
        crowd[-1] |= last
        rows = np.flatnonzero(np.repeat(crowd, size))
        if self.told:
            rows = rows[rows >= held]
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        return self.node[a], self.node[b], rows

    def cut(self) -> None:
        """Lets go what later rows cannot meet."""
        n = len(self.tree)
        if not n:
            return
        same = (self.key[:, :MIN_DEPTH] == self.key[-1, :MIN_DEPTH]).all(axis=1) & (self.tree == self.tree[-1])
        other = np.flatnonzero(~same)
        at = int(other[-1]) + 1 if len(other) else 0
        self.told = self.told and at == 0
        self.first = self.first and at == 0
        if self.told or self.first or n - at >= CROWDED:
            self.told, at = True, n - 1
        self.tree, self.key, self.node = self.tree[at:].copy(), self.key[at:].copy(), self.node[at:].copy()


def _batch(tree, a, b, key) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.binary())], names=["tree", "a", "b", "key"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (tree, key, node) -> candidates (null, a, b, null), rows of crowded regions and of the
    partition's first and last (tree, node, 0, key), and its two outermost rows (tree, node, null, key)."""
    found, edge = Regions(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, node, key = batch["tree"].to_numpy(), batch["node"].to_numpy(), _key(batch["key"])
        if edge is None:
            yield _batch(tree[:2], node[:2], [None] * len(tree[:2]), [k.tobytes() for k in key[:2]])
            edge = tree[:0], node[:0], key[:0]
        a, b, rows = found.add(tree, key, node)
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        yield _batch([None] * len(a), a, b, [None] * len(a))
        yield _batch(found.tree[rows], found.node[rows], [0] * len(rows), [k.tobytes() for k in found.key[rows]])
        found.cut()
        edge = tuple(np.concatenate(x)[-2:] for x in zip(edge, (tree, node, key)))
    if edge is not None:
        none = edge[0][:0]
        a, b, rows = found.add(none, edge[2][:0], edge[1][:0], last=True)
        yield _batch([None] * len(a), np.minimum(a, b), np.maximum(a, b), [None] * len(a))
        yield _batch(found.tree[rows], found.node[rows], [0] * len(rows), [k.tobytes() for k in found.key[rows]])
        yield _batch(edge[0], edge[1], [None] * len(edge[0]), [k.tobytes() for k in edge[2]])


def candidates(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a, b), a < b, of classes (node, sig), and the rows (tree, key, node) of crowded regions."""
    twice = F.concat("sig", "sig")
    rows = classes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(twice, t * 2 * MIN_DEPTH + 1, F.lit(2 * MAX_DEPTH)))).alias("tree", "key"))
    found = scratch(rows.repartitionByRange("tree", "key").sortWithinPartitions("tree", "key", "node").mapInArrow(_pairs, PAIRED), "forest")
    # four rows of each partition: their neighbours may stand in the next one
    edges = found.where("key IS NOT NULL AND b IS NULL").select("tree", F.col("a").alias("node"), "key").distinct()
    beside = Window.partitionBy("tree").orderBy("key", "node")
    across = [edges.select(F.col("node").alias("a"), F.lead("node", k).over(beside).alias("b"), "key", F.lead("key", k).over(beside).alias("far")) for k in (1, 2)]
    across = across[0].unionAll(across[1]).where(F.substring("key", 1, 2 * MIN_DEPTH) == F.substring("far", 1, 2 * MIN_DEPTH)).where("a <> b")
    pairs = found.where(F.col("key").isNull()).select("a", "b").unionAll(across.select(F.least("a", "b"), F.greatest("a", "b")))
    return pairs.distinct(), found.where("key IS NOT NULL AND b IS NOT NULL").select("tree", "key", F.col("a").alias("node")).distinct()


def mixed_nodes(dense: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of all rows in crowded regions that have several components; three rows that a
    partition's edge parts count as crowded. Regions are counted with partial sums, and the few that
    are mixed go to the rows, so that no task holds a region."""
    rows = scratch(dense.join(label, "node", "left").select("tree", F.substring("key", 1, 2 * MIN_DEPTH).alias("prefix"), "node", F.coalesce("label", "node").alias("label")), "regions")
    mixed = rows.groupBy("tree", "prefix").agg(F.count("*").alias("k"), F.min("label").alias("low"), F.max("label").alias("high")).where("k > 2 and low < high")
    mixed = scratch(mixed.select("tree", "prefix"), "mixed")
    few = F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed
    return rows.join(few, ["tree", "prefix"], "left_semi").select("node", "label").distinct()


@F.arrow_udf(T.ArrayType(T.LongType()))
def _longs(shingles: pa.Array) -> pa.Array:
    parts = shingles.to_pylist()
    ends = np.cumsum([0, *(len(x) // 8 for x in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int64)))


def _across(percent: int):
    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefix rows sorted by (shingle, low, high, label) -> pairs of different labels that may be above the threshold."""
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch[c].to_numpy(zero_copy_only=False) for c in PREFIX_ROW]
            if held is not None:
                rows = [np.concatenate([h, x]) for h, x in zip(held, rows)]
            # the last tile may go on in the next batch; it has some 2 * TILE rows at most
            cut = int(_tiles(rows)[-1])
            yield from _joined([x[:cut] for x in rows], percent)
            held = [x[cut:] for x in rows]
        if held is not None:
            yield from _joined(held, percent)

    return across


def _tiles(rows: list[np.ndarray]) -> np.ndarray:
    """Where tiles (shingle, low, high) begin in sorted rows."""
    other = np.zeros(len(rows[0]) - 1, bool)
    for x in rows[:3]:
        other |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(other) + 1])


def _joined(rows: list[np.ndarray], percent: int) -> Iterator[pa.RecordBatch]:
    _, low_block, high_block, block, label, node, n, at, short = rows
    if len(label) < 2:
        return
    first = _tiles(rows)
    tile = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(label))))
    new = np.flatnonzero((tile[1:] != tile[:-1]) | (label[1:] != label[:-1])) + 1
    starts = np.concatenate([[0], new, [len(label)]])
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    # each row meets the rows after its own label, to the end of its tile
    low, high = starts[group + 1], np.searchsorted(tile, tile, side="right")
    left = np.maximum(high - low, 0)
    ends = np.cumsum(left)
    i = 0
    while i < len(left):
        # about a million pairs at once
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + 1_000_000, side="right")))
        x = np.repeat(np.arange(i, j), left[i:j])
        y = np.arange(len(x)) - np.repeat(np.cumsum(left[i:j]) - left[i:j], left[i:j]) + low[x]
        i = j
        apart = (low_block[x] == high_block[x]) | (block[x] != block[y])  # rows of one block meet in that block's own tile
        x, y = x[apart], y[apart]
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        ok = (n[x] < n[y]) & short[x] | (n[y] < n[x]) & short[y] | (n[x] == n[y]) & (short[x] | short[y])
        ok &= 100 * small >= percent * large
        # what can still be common from this shingle on, if it is the first common one
        ok &= (100 + percent) * np.minimum(n[x] - at[x], n[y] - at[y]) >= percent * (n[x] + n[y])
        a, b = node[x[ok]], node[y[ok]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def prefix_pairs(sets: DataFrame, label: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Distinct pairs (a, b), a < b, of different labels, among them every one of `sets` (node, cls,
    shingles) above the threshold.

    Of sets x and y, x not the larger, with at least t of the union in common, the first common
    shingle in any order of all shingles is among the first n - ceil(t n) + 1 of y and the first
    n - ceil(2 t n / (1 + t)) + 1 of x. The order is by the number of sets that have the shingle.
    """
    rows = sets.join(label, "node").select("node", "cls", "label", _longs("shingles").alias("s"))
    rows = scratch(rows.select("node", "cls", "label", F.size("s").cast("long").alias("n"), F.explode("s").alias("shingle")), "shingles")
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).where("df > 1")
    own = rows.join(shared.select("shingle", "df", (F.col("low") < F.col("high")).alias("mixed")), "shingle")
    # a shingle of one set alone comes first and makes no pair: it only takes a place
    own = own.groupBy("node", "cls", "label", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle", "mixed"))).alias("w"))
    own = own.select("node", "label", "n", F.size("w").alias("k"), F.posexplode("w").alias("i", "w")).withColumn("at", F.col("n") - F.col("k") + F.col("i"))
    own = own.where(F.expr(f"w.mixed and at <= n - (n * {percent} + 99) div 100"))
    short = F.expr(f"at <= n - (2 * {percent} * n + {99 + percent}) div {100 + percent}")
    own = scratch(own.select(F.col("w.shingle").alias("shingle"), "label", "node", "n", "at", short.alias("short")), "prefixes")
    # a shingle with many rows is split in blocks of about TILE, and each two blocks meet in a tile of their own
    crowded = own.groupBy("shingle").agg(F.count("*").alias("rows")).where(F.col("rows") > TILE).select("shingle", F.ceil(F.col("rows") / TILE).cast("int").alias("blocks"))
    crowded = scratch(crowded, "crowded")
    few = F.broadcast(crowded) if crowded.count() <= BROADCAST_IDS else crowded
    own = own.join(few, "shingle", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = own.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = own.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).select(*PREFIX_ROW)
    tile = PREFIX_ROW[:3]
    return own.repartition(*tile).sortWithinPartitions(*tile, "label").mapInArrow(_across(percent), "a long, b long").where("a <> b").distinct()


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, label): the smallest node reachable over links (a, b). Only nodes that have a link."""
    scratch = scratch or Scratch(links.sparkSession, "components")
    both = scratch(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = scratch(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    few = F.broadcast if label.count() <= BROADCAST_IDS else lambda rows: rows
    while True:
        step = both.join(few(label.select(F.col("node").alias("b"), F.col("label").alias("seen"))), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        low = step.join(few(label), "node").select("node", "label", F.least("label", "seen").alias("next"))
        # pointer jumping: the label's own label
        jump = low.join(few(label.select(F.col("node").alias("next"), F.col("label").alias("far"))), "next").select("node", F.col("label").alias("before"), F.least("next", "far").alias("label"))
        jump = scratch(jump, "labels")
        changed = jump.where("label < before").limit(1).count()
        label = jump.select("node", "label")
        if not changed:
            return label


def _crossing(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(label.select(F.col("node").alias(side), F.col("label").alias(f"l{side}")), side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
    return pairs.where("la <> lb").select("a", "b", "agree")


def _node() -> Column:
    """A class by its smallest doc_id; without one, a negative number that no id has."""
    return F.coalesce("rep", F.xxhash64("cls").bitwiseOR(F.lit(-(2**63))))


def resolved(docs: DataFrame, scratch: Scratch, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, cls (digest of the words), n_shingles, component_id, and `part`, a
    number for the component that it has without ids too (null without words)."""
    small_batches(docs)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = scratch(own.select("doc_id", _signed(width)("text").alias("s")).select("doc_id", "s.*"), "signed")
    classes = signed.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    classes = scratch(classes.withColumn("node", _node()), "classes")
    signed = signed.select("doc_id", "cls", F.col("n").alias("n_shingles"))

    # an id on rows of several classes is one document: its classes are linked
    blank = F.coalesce("cls", F.lit(b""))
    several = signed.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(blank).alias("low"), F.max(blank).alias("high")).where("low < high").select("doc_id")
    several = scratch(several, "several")
    links, repeated = [], several.limit(1).count() > 0
    if repeated:
        members = signed.join(several, "doc_id").join(classes.select("cls", "node"), "cls").select("doc_id", "node").distinct()
        least = members.groupBy("doc_id").agg(F.min("node").alias("a"))
        links.append(scratch(members.join(least, "doc_id").where("a < node").select("a", F.col("node").alias("b")).distinct(), "links"))

    pairs, dense = candidates(classes, scratch)
    sig = classes.select("node", "sig")

    def agreeing(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sig.select(F.col("node").alias(side), F.col("sig").alias(f"sig_{side}")), side)
        return scratch(pairs.select("a", "b", agreement("sig_a", "sig_b").alias("agree")).where(F.col("agree") >= MIN_AGREE), "candidates")

    def sets_of(nodes: DataFrame) -> DataFrame:
        nodes = scratch(nodes, "nodes")
        few = F.broadcast(nodes) if nodes.count() <= BROADCAST_IDS else nodes
        shaped = _sets(width)
        named = own.where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "node").join(few, "node").select("node", shaped("text").alias("s")).select("node", "s.*")
        unnamed = own.where(F.col("doc_id").isNull()).select(shaped("text").alias("s")).select(F.lit(None).cast("long").alias("rep"), "s.*").select(_node().alias("node"), "cls", "shingles").join(few, "node")
        return scratch(named.unionByName(unnamed).groupBy("node", "cls").agg(F.first("shingles").alias("shingles")), "sets")

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"s_{side}")), side)
        return scratch(pairs.select("a", "b", _similar(percent)("s_a", "s_b").alias("ok")).where("ok").select("a", "b").distinct(), "links")

    def joined() -> DataFrame:
        return reduce(DataFrame.unionAll, links)

    def rounds(left: DataFrame, sets: DataFrame, best_rounds: int) -> DataFrame:
        """Tests pairs that cross components, the best of each text first; each round keeps only those that still cross."""
        for turn in range(best_rounds + 1):
            if turn == best_rounds:
                now = left
            else:
                ends = left.select(F.col("a").alias("n"), F.struct("agree", F.col("b").alias("o")).alias("w")).unionAll(left.select(F.col("b").alias("n"), F.struct("agree", F.col("a").alias("o")).alias("w")))
                now = scratch(ends.groupBy("n").agg(F.max("w").alias("w")).select(F.least("n", "w.o").alias("a"), F.greatest("n", "w.o").alias("b")).distinct(), "best")
            links.append(confirmed(now.select("a", "b"), sets))
            label = components(joined(), scratch)
            if turn < best_rounds:
                left = scratch(_crossing(left.join(now, ["a", "b"], "left_anti"), label), "left")
                if not left.limit(1).count():
                    break
        return label

    found = agreeing(pairs)
    label = rounds(found, sets_of(found.select(F.col("a").alias("node")).unionAll(found.select(F.col("b").alias("node"))).distinct()), BEST_ROUNDS)
    dense = scratch(mixed_nodes(dense, label, scratch), "dense")
    if dense.limit(1).count():
        sets = sets_of(dense.select("node"))
        wide = agreeing(prefix_pairs(sets, dense, percent, scratch).join(found.select("a", "b"), ["a", "b"], "left_anti"))
        if wide.limit(1).count():
            label = rounds(wide, sets, 1)

    reached = label.join(classes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("least"))
    by_node = label.join(reached, "label").select("node", "label", "least")
    of_class = classes.select("cls", "rep", "node").join(by_node, "node", "left").select("cls", F.coalesce("least", "rep").alias("least"), F.coalesce("label", "node").alias("part"))
    out = signed.join(of_class, "cls", "left").withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    if repeated:  # an id on a row without words too
        least = out.join(several, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("lowest"))
        out = out.join(least, "doc_id", "left").withColumn("component_id", F.coalesce("lowest", "component_id"))
    return out.select("doc_id", "cls", "n_shingles", "component_id", "part")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "near")
    out = resolved(docs, scratch, text, doc_id, width, percent)
    return scratch.done(out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "near")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """`docs` with one document of each component: that with the smallest id; without any id, the text
    with the smallest digest. Of rows repeated with one id and equal words, one stays. Rows without id
    and words all stay."""
    scratch = Scratch(docs.sparkSession, "near")
    own = resolved(docs, scratch, **how)
    own = scratch.done(own.select("doc_id", "cls", "component_id", "part"), "near")
    named, unnamed = docs.where(F.col("doc_id").isNotNull()), docs.where(F.col("doc_id").isNull())

    def few(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows

    gone = own.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_id")).distinct()
    gone = few(gone)
    kept = named.join(gone, named["doc_id"] == gone["gone_id"], "left_anti")
    digest_of = _digested()
    again = own.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("again_id")).count().where("count > 1").select("again_id")
    if again.limit(1).count():
        again = few(again)
        twice = kept.join(again, kept["doc_id"] == again["again_id"], "left_semi").select(F.struct("*").alias("row"), F.coalesce(digest_of("text"), F.lit(b"")).alias("cls"))
        twice = twice.select("row", F.col("row.doc_id").alias("again_id"), "cls").dropDuplicates(["again_id", "cls"]).select("row.*")
        kept = kept.join(again, kept["doc_id"] == again["again_id"], "left_anti").unionByName(twice)
    if own.where(F.col("doc_id").isNull()).limit(1).count():
        first = few(own.where(F.col("component_id").isNull() & F.col("cls").isNotNull()).groupBy("part").agg(F.min("cls").alias("cls")).select("cls"))
        rows = unnamed.select(F.struct("*").alias("row"), digest_of("text").alias("cls"))
        blank = rows.where(F.col("cls").isNull()).select("row.*")
        kept = kept.unionByName(blank).unionByName(rows.join(first, "cls", "left_semi").dropDuplicates(["cls"]).select("row.*"))
    return kept


def oracle(width: int = WIDTH, percent: int = PERCENT) -> str:
    """The result of near_duplicates for ids that occur once, in DuckDB's SQL: an exact join of all shingles, and all that is reachable."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + {width - 1}], ' ') FOR i IN range(1, len(w) - {width - 2})] END)) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""
