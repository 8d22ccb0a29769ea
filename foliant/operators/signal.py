"""Signals: framing, silence, resampling, cuts, sessions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds of a cut's target, longest piece, overlap, least silence and frame; thresholds of silence.
TARGET, LONGEST, OVERLAP, LEAST_SILENCE, FRAME = 45.0, 120.0, 0.8, 0.25, 0.02
FLOOR, SHARE_OF_MEDIAN = 0.008, 0.35
RATE = 16_000


def downmix(samples: DataFrame) -> DataFrame:
    """(clip, frame, channel, sample) to the mean of the channels."""
    return samples.groupBy("clip", "frame").agg(F.avg("sample").alias("sample"))


def ms_to_frames(ms: Column, rate: int = RATE) -> Column:
    """Rounded up."""
    return F.floor((ms * rate + 999) / 1000).cast("long")


def frames_to_ms(frames: Column, rate: int = RATE) -> Column:
    """Rounded down."""
    return F.floor(frames * 1000 / rate).cast("long")


def sample_scale(bits: Column) -> Column:
    return F.when(bits == 8, 128.0).when(bits == 16, 32768.0).when(bits == 24, float(1 << 23)).when(bits == 32, float(1 << 31))


def frame_rms(samples: DataFrame, size: int, clip: str = "clip", at: str = "i", value: str = "x") -> DataFrame:
    """Root mean square of frames of `size` samples; the last may be short: clip, frame, rms. One aggregation with
    partial sums in each task."""
    frame = F.floor(F.col(at) / size).cast("long").alias("frame")
    return samples.groupBy(clip, frame).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def upper_median_of(frames: DataFrame, clip: str = "clip", value: str = "rms") -> DataFrame:
    """sorted[n / 2] of each clip by rank, without an array of all its values."""
    w = Window.partitionBy(clip)
    ranked = frames.withColumns({"rank": F.row_number().over(w.orderBy(value)), "n": F.count("*").over(w)})
    return ranked.where(F.col("rank") == F.floor(F.col("n") / 2) + 1).select(clip, F.col(value).alias("median"))


def silence_threshold(frames: DataFrame, clip: str = "clip") -> DataFrame:
    return upper_median_of(frames, clip).withColumn("threshold", F.greatest(F.lit(FLOOR), F.col("median") * SHARE_OF_MEDIAN))


def resample(samples: DataFrame, rate_in: int, rate_out: int) -> DataFrame:
    """Linear, by clip (clip, i, x): floor(n * out / in) samples, one at least; beyond the end the last one holds.
    Each output needs two neighbours: a window brings the next sample, a generator the outputs between them."""
    w = Window.partitionBy("clip")
    own = samples.withColumns({"n": F.count("*").over(w), "next": F.lead("x").over(w.orderBy("i"))})
    own = own.withColumn("m", F.greatest(F.lit(1), F.floor(F.col("n") * rate_out / F.lit(rate_in))))
    # outputs o with floor(o * in / out) = i
    first = F.ceil(F.col("i") * rate_out / F.lit(rate_in))
    last = F.least(F.ceil((F.col("i") + 1) * rate_out / F.lit(rate_in)) - 1, F.col("m") - 1)
    own = own.where(first <= last).withColumn("o", F.explode(F.sequence(first, last)))
    position = F.col("o") * rate_in / F.lit(float(rate_out))
    part = position - F.floor(position)
    return own.select("clip", F.col("o").alias("i"), (F.col("x") + (F.coalesce("next", "x") - F.col("x")) * part).alias("x"))


def running_minimum(frames: DataFrame, clip: str = "clip") -> DataFrame:
    """Lowest energy so far with its place, the first on a tie: clip, frame, rms, low, low_frame."""
    w = Window.partitionBy(clip).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    m = F.min(F.struct("rms", "frame")).over(w)
    return frames.withColumns({"low": m["rms"], "low_frame": m["frame"]})


def silence_runs(frames: DataFrame, threshold: float, clip: str = "clip") -> DataFrame:
    """Frames of silence up to each frame since the last voiced one."""
    w = Window.partitionBy(clip).orderBy("frame")
    voiced = F.max(F.when(F.col("rms") >= threshold, F.col("frame"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.min("frame").over(Window.partitionBy(clip))
    return frames.withColumn("silence", F.when(voiced.isNull(), F.col("frame") - first + 1).otherwise(F.col("frame") - voiced))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of events closer than the gap: key, session (from 1), begins, ends, n."""
    w = Window.partitionBy(key).orderBy(ts)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.when(us - F.lag(us).over(w) < gap_seconds * 1_000_000, 0).otherwise(1)
    own = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(key, "session").agg(F.min(ts).alias("begins"), F.max(ts).alias("ends"), F.count("*").alias("n"))


def pre_roll(segments: DataFrame, samples: DataFrame, length: int) -> DataFrame:
    """Samples (clip, i, x) of each segment (clip, segment, begin, end) and up to `length` before it."""
    s, x = segments.alias("s"), samples.alias("x")
    return s.join(x, (F.col("s.clip") == F.col("x.clip")) & (F.col("x.i") >= F.col("s.begin") - length) & (F.col("x.i") < F.col("s.end"))).select("s.clip", "s.segment", "x.i", "x.x")


def cuts(x: np.ndarray, rate: int = RATE, target: float = TARGET, longest: float = LONGEST, overlap: float = OVERLAP, least_silence: float = LEAST_SILENCE, frame_s: float = FRAME) -> list[tuple[int, int]]:
    """(begin, end) of pieces of about `target` seconds: each ends shortly after the start of the last silence before the
    target, if one lies within `least_silence` of it, and overlaps the next."""
    n, frame = len(x), max(1, int(frame_s * rate))
    if not n or rate <= 0:
        return []
    size, most, over, quiet = int(target * rate), int(longest * rate), int(overlap * rate), int(least_silence * rate)
    edges = np.arange(0, n, frame)
    power = np.add.reduceat(np.asarray(x, dtype=np.float64) ** 2, edges)
    rms = np.sqrt(power / np.diff(np.append(edges, n))).astype(np.float32)
    limit = max(np.float32(FLOOR), np.sort(rms)[len(rms) // 2] * np.float32(SHARE_OF_MEDIAN))
    silent = np.append(rms < limit, False)
    # the sample before the silence that a frame lies in
    at = np.arange(len(silent))
    before = np.maximum.accumulate(np.where(silent & ~np.append(False, silent[:-1]), at, 0)) * frame - 1

    def end_of(begin: int) -> int:
        goal = begin + size
        if goal >= n:
            return n
        low = goal - quiet if goal > quiet else begin
        late = np.arange(-(-(low + 2) // frame) - 1, goal // frame + 1)[::-1] if goal > low else at[:0]
        late = late[silent[late]]
        edge = np.maximum(before[late], begin)
        edge = edge[goal - edge >= quiet // 2]
        return max(begin + frame, min(n, int(edge[0]) + quiet // 4)) if len(edge) else goal

    out, begin = [], 0
    while not out or out[-1][1] < n:
        end = min(end_of(begin), begin + most)
        out.append((begin, end if end > begin else min(n, begin + frame)))
        length = out[-1][1] - begin
        begin = out[-1][1] - (over if 0 < over < length else 0)
    return out


def slice_clips(clips: DataFrame, **how) -> DataFrame:
    """(clip, samples array) to rows clip, slice, begin, end: a piece depends on the one before it, so clips are worked
    one by one, in parallel over clips."""

    def work(frames):
        for f in frames:
            rows = [(c, k, b, e) for c, x in zip(f["clip"], f["samples"]) for k, (b, e) in enumerate(cuts(np.asarray(x, dtype=np.float32), **how))]
            yield pd.DataFrame(rows, columns=["clip", "slice", "begin", "end"])

    return clips.select("clip", "samples").mapInPandas(work, f"clip {clips.schema['clip'].dataType.simpleString()}, slice int, begin long, end long")
