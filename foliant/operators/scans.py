"""Scans and selection over clips of any length: the work of one clip is spread over tasks.

A scan is made in two levels. Rows lie in blocks of a clip, named by their place (`frame` by BLOCK, or a span of
time), so a block is the same in every run and holds a bounded number of places. Each block is scanned by itself and
aggregated to one row; the blocks' rows of a clip, a BLOCKth of its rows, are scanned in order; and each block's rows take
what its predecessors carry, by a join on (clip, block).

Selection narrows the range of values that holds the wanted rank, by rounds of histograms. Edges of BINS bins of about
equal numbers come from a sketch, so a round leaves a BINth of the rows whatever their distribution; then each bin is
counted exactly, and the one that the rank falls into is kept, with the smallest and largest value in it. The largest value is
always an edge, so a round never leaves all. A clip is done when the two are equal, or when at most LEAF rows are
left to rank; short clips are ranked at once. Sketches and counts are combined in tasks.

Cases: null values take no part in selection and count as silence; null clips are a clip of their own; equal places
of a clip are ordered by nothing else, so their scans end alike (`low` and `silence` are those after all of them);
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

BLOCK = 1 << 16
BINS, LEAF = 32, 4096


def block_of(place: Column, size: int = BLOCK) -> Column:
    return F.floor(place / F.lit(size)).cast("long")


def carried(rows: DataFrame, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """Rows (clip, block, ...) with what the blocks before theirs give: `summary` aggregates a block,
    `carry` the summaries of all earlier blocks of the clip (null for the first)."""
    blocks = rows.groupBy("clip", "block").agg(*[c.alias(k) for k, c in summary.items()])
    before = Window.partitionBy("clip").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("clip").alias("clip_"), F.col("block").alias("block_"), *[c.over(before).alias(k) for k, c in carry.items()])
    return rows.join(blocks, F.col("clip").eqNullSafe(F.col("clip_")) & (F.col("block") == F.col("block_"))).drop("clip_", "block_")


def running_minimum(frames: DataFrame, size: int = BLOCK) -> DataFrame:
    """Lowest energy so far with its place, the first on a tie: frames (clip, frame, rms) with low, low_frame."""
    rows = frames.withColumn("block", block_of(F.col("frame"), size))
    one = F.when(F.col("rms").isNotNull(), F.struct("rms", "frame"))
    rows = carried(rows, {"least": F.min(one)}, {"least": F.min("least")})
    own = F.min(one).over(Window.partitionBy("clip", "block").orderBy("frame"))
    rows = rows.withColumn("low_", F.least(own, "least"))
    return rows.withColumns({"low": F.col("low_.rms"), "low_frame": F.col("low_.frame")}).drop("low_", "least", "block")


def silence_runs(frames: DataFrame, threshold: float, size: int = BLOCK) -> DataFrame:
    """Places of silence up to each frame since the last voiced one, or since the clip's first frame."""
    rows = frames.withColumn("block", block_of(F.col("frame"), size))
    voiced = F.when(F.col("rms") >= threshold, F.col("frame"))
    rows = carried(rows, {"voiced": F.max(voiced), "begin": F.min("frame")}, {"voiced": F.max("voiced"), "begin": F.min("begin")})
    w = Window.partitionBy("clip", "block").orderBy("frame")
    last = F.coalesce(F.max(voiced).over(w), "voiced")
    first = F.coalesce("begin", F.min("frame").over(w))
    return rows.withColumn("silence", F.when(last.isNull(), F.col("frame") - first + 1).otherwise(F.col("frame") - last)).drop("voiced", "begin", "block")


def sessions(events: DataFrame, key: str | None, ts: str, gap_seconds: int, span_seconds: int = 3600) -> DataFrame:
    """Sessions of events closer than the gap, of any length: key, session (from 1), begins, ends, n. A block is `span_seconds` of time."""
    place = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    rows = events.where(F.col(ts).isNotNull()).select((F.col(key) if key else F.lit(0)).alias("clip"), place.alias("at"), F.col(ts).alias("ts"))
    rows = rows.withColumn("block", block_of(F.col("at"), span_seconds * 1_000_000))
    w = Window.partitionBy("clip", "block").orderBy("at")
    rows = rows.withColumn("new", F.when(F.col("at") - F.lag("at").over(w) < gap, 0).otherwise(1))
    return _numbered(rows, gap).groupBy(F.col("clip").alias(key or "key"), "session").agg(F.min("ts").alias("begins"), F.max("ts").alias("ends"), F.count("*").alias("n"))


def _numbered(rows: DataFrame, gap: int) -> DataFrame:
    """Rows (clip, block, at, new) with `session`. Each block's first event counts as new in it; whether it
    is, and how many sessions began before, comes from the blocks' summaries."""
    blocks = rows.groupBy("clip", "block").agg(F.min("at").alias("head"), F.max("at").alias("tail"), F.sum("new").alias("inner"))
    in_order = Window.partitionBy("clip").orderBy("block")
    blocks = blocks.withColumn("joins", F.when(F.col("head") - F.lag("tail").over(in_order) < gap, 1).otherwise(0))
    # sessions that began in earlier blocks, less one if this block's first event goes on with the last of them
    begun = F.sum(F.col("inner") - F.col("joins")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("clip").alias("clip_"), F.col("block").alias("block_"), (F.coalesce(begun, F.lit(0)) - F.col("joins")).alias("before"))
    rows = rows.join(blocks, F.col("clip").eqNullSafe(F.col("clip_")) & (F.col("block") == F.col("block_"))).drop("clip_", "block_")
    own = F.sum("new").over(Window.partitionBy("clip", "block").orderBy("at").rangeBetween(Window.unboundedPreceding, 0))  # events of one time together
    return rows.withColumn("session", F.col("before") + own)


def selected(values: DataFrame, rank: Column, leaf: int = LEAF, bins: int = BINS) -> DataFrame:
    """For each clip of (clip, x) the value at place `rank` (from 0; of column n, the number of its values): clip, n, value."""
    known = values.where(F.col("x").isNotNull()).select("clip", F.col("x").cast("double").alias("x"))
    state = known.groupBy("clip").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    state = kept(state.withColumns({"left": F.col("n"), "rank": rank.cast("long")}).where("rank >= 0 AND rank < n"))
    done = []
    while True:
        done.append(state.where("low = high").select("clip", "n", F.col("low").alias("value")))
        short = state.where(f"low < high AND left <= {leaf}")
        rows = _within(known, short)
        ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("clip").orderBy("x")) - 1)
        done.append(ranked.where("at = rank").select("clip", "n", F.col("x").alias("value")))
        long = state.where(f"low < high AND left > {leaf}")
        if not long.limit(1).count():
            return _union(done)
        inside = kept(_within(known, long).select("clip", "n", "rank", "x"))
        edges = F.percentile_approx("x", [k / bins for k in range(1, bins)], 10 * bins)
        edges = inside.groupBy("clip").agg(F.array_distinct(F.concat(edges, F.array(F.max("x")))).alias("edges")).withColumnRenamed("clip", "clip_")
        counted = inside.join(edges, F.col("clip").eqNullSafe(F.col("clip_"))).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("x"))))
        counted = counted.groupBy("clip", "n", "rank", "bin").agg(F.count("*").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"))
        below = F.coalesce(F.sum("rows").over(Window.partitionBy("clip").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        here = counted.withColumn("below", below).where("rank >= below AND rank < below + rows")
        state = kept(here.select("clip", "n", "low", "high", F.col("rows").alias("left"), (F.col("rank") - F.col("below")).alias("rank")))


def _within(known: DataFrame, state: DataFrame) -> DataFrame:
    """Values in their clip's range."""
    state = state.select(F.col("clip").alias("clip_"), "n", "low", "high", "rank")
    return known.join(state, F.col("clip").eqNullSafe(F.col("clip_")) & (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))).drop("clip_")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def upper_median(values: DataFrame, leaf: int = LEAF, bins: int = BINS) -> DataFrame:
    """sorted[n / 2] of each clip's values: clip, n, median."""
    return selected(values, F.floor(F.col("n") / 2), leaf, bins).withColumnRenamed("value", "median")
