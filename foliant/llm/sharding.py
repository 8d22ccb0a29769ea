"""Sharding by a minimax contiguous partition.

Rows with equal texts form a group that stays together. Groups stand in the order of a hash of
their text, and `shards` runs of them are cut so that the largest shard is as small as it can be:
the capacity is found by binary search, each candidate checked greedily. A group larger than the
capacity has a shard to itself; that changes nothing in the largest shard and keeps the others level.

The sizes of all groups never reach the driver. It sees sums over ranges of the hash, 2^FIRST_BITS at
first; a range through which a cut might pass for any capacity still possible is split further, with
the ranges elsewhere left whole, until all such ranges are single groups: the capacity is then exact
over the atomic groups, from a few bounded aggregations. Grouping pre-aggregates in each task, so a
group of a third of all rows is one row for each task. Slots are numbered by blocks of each shard,
about sqrt(rows) of them, so that no task holds a whole shard.

Cases: a null text is a group of its own with size 8 and CRC 0; an empty one likewise; repeated
rows get slots of their own; null doc_ids come first within a block; an empty table gives an empty
result; fewer groups than shards leave shards empty. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 24
#: The driver's first view has so many ranges of the hash at most; each step splits a range in 2^STEP_BITS.
FIRST_BITS, STEP_BITS = 14, 8
OVERHEAD = 8


@dataclass
class Ranges:
    """Ranges of the hash in order: sums, whether they are one group, where they begin, their level."""

    size: np.ndarray
    atomic: np.ndarray
    low: np.ndarray
    bits: np.ndarray

    def __post_init__(self):
        self.before = np.concatenate([[0], np.cumsum(self.size)])


def greedy(r: Ranges, capacity: int, shards: int, split: bool) -> list[float] | None:
    """Ends of the shards (as running sums) at this capacity; None if they do not suffice. With
    `split`, ranges of several groups may be cut anywhere, which gives a bound from below."""
    pos, cuts, total = 0.0, [], float(r.before[-1])
    large = np.flatnonzero(r.atomic & (r.size > capacity))
    while pos < total:
        if len(cuts) == shards:
            return None
        i = int(np.searchsorted(r.before, pos, side="right")) - 1
        if pos == r.before[i] and r.atomic[i] and r.size[i] > capacity:
            pos = float(r.before[i + 1])
        else:
            end = pos + capacity
            k = np.searchsorted(large, i if pos == r.before[i] else i + 1)
            if k < len(large):
                end = min(end, float(r.before[large[k]]))
            end = min(end, total)
            j = int(np.searchsorted(r.before, end, side="right")) - 1
            if not split or (j < len(r.size) and r.atomic[j]):
                end = float(r.before[j])
            if end <= pos:
                return None  # a range of several groups is larger than the capacity
            pos = end
        cuts.append(pos)
    return cuts


def least_capacity(r: Ranges, shards: int, split: bool) -> int:
    total = int(r.before[-1])
    low, high = max(1, -(-total // shards) // shards), max(total, 1)
    while low < high:
        middle = (low + high) // 2
        if greedy(r, middle, shards, split) is None:
            low = middle + 1
        else:
            high = middle
    return low


def open_ranges(r: Ranges, shards: int) -> np.ndarray:
    """Ranges of several groups in which a cut of the best partition may lie."""
    low, high = least_capacity(r, shards, True), least_capacity(r, shards, False)
    several = ~r.atomic
    loose = several & (r.size > low)
    first, last = greedy(r, low, shards, False), greedy(r, high, shards, True)
    mark = loose.copy()
    if first is None or last is None:
        # greedy from below runs out of shards: every place from its last cut on is open
        first = []
        pos, i = 0.0, 0
        for _ in range(shards):
            j = int(np.searchsorted(r.before, pos + low, side="right")) - 1
            pos = float(r.before[max(j, i)])
            i = max(j, i)
            first.append(pos)
    last = (last or []) + [float(r.before[-1])] * (shards - len(last or []))
    first = first + [float(r.before[-1])] * (shards - len(first))
    for a, b in zip(first, last):
        i, j = int(np.searchsorted(r.before, a, side="right")) - 1, int(np.searchsorted(r.before, b, side="left"))
        mark[max(i, 0) : j] |= several[max(i, 0) : j]
    return np.flatnonzero(mark)


def _sums(groups: DataFrame, bits: int) -> DataFrame:
    cell = F.shiftright("group", 64 - bits).alias("cell")
    return groups.groupBy(cell).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.min("group").alias("low"))


def ranges_of(groups: DataFrame, shards: int) -> Ranges:
    """Bounded sums over (group, size), fine enough for an exact partition."""

    def read(df: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
        return [(r["low"], r["size"], r["n"], bits) for r in df.collect()]

    rows = read(_sums(groups, FIRST_BITS), FIRST_BITS)
    while True:
        rows.sort()
        r = Ranges(*(np.array([x[k] for x in rows], dtype=np.int64) for k in (1, 2, 0, 3)))
        r = Ranges(r.size, r.atomic == 1, r.low, r.bits)
        todo = open_ranges(r, shards)
        if not len(todo) or not len(rows):
            return r
        bits = int(r.bits[todo].min())
        todo = todo[r.bits[todo] == bits]
        # split the largest first, a bounded number at a time
        todo = todo[np.argsort(-r.size[todo], kind="stable")][:1024]
        cells = [int(x) >> (64 - bits) for x in r.low[todo]]
        deeper = min(bits + STEP_BITS, 64)
        part = groups.where(F.shiftright("group", 64 - bits).isin(cells))
        gone = set(todo.tolist())
        rows = [x for i, x in enumerate(rows) if i not in gone] + read(_sums(part, deeper), deeper)


def cut_points(groups: DataFrame, shards: int) -> list[int]:
    """First group of each shard but the first, for the smallest feasible capacity."""
    r = ranges_of(groups, shards)
    if not len(r.size):
        return []
    cuts = greedy(r, least_capacity(r, shards, False), shards, False)
    return [int(r.low[np.searchsorted(r.before, c)]) for c in cuts if c < r.before[-1]]


def assign(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot."""
    raw = F.col(text).cast("binary")
    sized = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"), (F.coalesce(F.length(raw), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(raw).alias("group"),
        ),
        "sized",
    )
    groups = stored(sized.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    cuts = cut_points(groups.select("group", "size"), shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("group") >= F.lit(c)).cast("int")
    rows = sized.count()
    blocks = max(1, int(np.ceil(np.sqrt(rows) / 4)))
    placed = sized.withColumns({"shard": shard.cast("int"), "block": F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int")})
    counts = placed.groupBy("shard", "block").agg(F.count("*").alias("n"))
    offsets = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "group", "size")) - 1
    return placed.withColumn("within", within).join(offsets, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("within")).cast("long").alias("slot"))
