"""Speech segments from a stream of window energies, and sessions of events.

A clip is followed by one pure transition, `step`: from what is known of the open segment (`Voice`) and one
more window to what is known then and the events that this makes. The same function serves a finished clip and,
per clip, a streaming query whose state is that tuple of numbers. All rules read times, not counters: a pause is the
time since the last voiced window. Time is the sum of windows pushed, so there is no late data within a clip.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import rolled_overlap_removed, stable_prefix


@dataclass(frozen=True)
class Params:
    """Milliseconds, and the energy from which a window is voiced (fixed values of the stream's contract)."""

    window: int = 20
    endpoint: int = 800
    pre_roll: int = 200
    chunk: int = 2000
    roll_target: int = 30_000
    roll_hard: int = 45_000
    roll_search: int = 6_000
    roll_pause: int = 200
    roll_overlap: int = 1_600
    threshold: float = 0.004

    def check(self) -> Params:
        if not (0 < self.window <= 1000 and 100 <= self.endpoint <= 10_000 and 0 <= self.pre_roll <= 5000 and 100 <= self.chunk <= 60_000 and 0 < self.threshold < 1 and self.roll_target <= self.roll_hard):
            raise ValueError("stream parameters out of range")
        return self


class Voice(NamedTuple):
    """The open segment of a clip, times in ms."""

    now: int = 0  # sound so far
    begin: int = 0  # where the segment would begin
    number: int = 1
    parent: int = 0  # the segment whose end this one repeats
    loud: int = -1  # end of the last voiced window; -1: nothing voiced yet
    told: int = 0  # chunks that a PARTIAL has shown
    dip: float = float("inf")  # weakest window late in the segment, and its end
    dip_at: int = -1


class Close(NamedTuple):
    """How a segment ends: where, where the next begins, and whether that repeats its sound and goes on speaking."""

    end: int
    then: int
    bridged: bool = False


EVENT = ["kind", "segment", "begin_ms", "end_ms", "parent", "bridged"]


def rolled(p: Params, v: Voice) -> Close | None:
    """A long segment ends at a pause, or, at the limit, at its weakest late window with a bridge to the next."""
    length = v.now - v.begin
    if length >= p.roll_target and v.now - v.loud >= p.roll_pause:
        return Close(v.now, v.now)
    if length < p.roll_hard:
        return None
    end = v.dip_at if v.dip_at > v.begin else min(v.begin + p.roll_hard, v.now)
    return Close(end, max(v.begin, end - p.roll_overlap), True)


def ended(p: Params, v: Voice) -> Close | None:
    """Silence as long as the endpoint ends a segment."""
    return Close(v.now, v.now) if v.now - v.loud >= p.endpoint else None


def partial(p: Params, v: Voice) -> tuple[Voice, list[tuple]]:
    """A PARTIAL with all of the segment so far, each time that another chunk is full."""
    chunks = (v.now - v.begin) // p.chunk
    if chunks <= v.told:
        return v, []
    return v._replace(told=chunks), [("PARTIAL", v.number, v.begin, v.now, v.parent, False)]


def closed(v: Voice, how: Close) -> tuple[Voice, tuple]:
    """The FINAL of a segment, and the voice that begins after it."""
    after = Voice(v.now, how.then, v.number + 1, v.number if how.bridged else 0, v.loud if how.bridged else -1)
    return after, ("FINAL", v.number, v.begin, how.end, v.parent, how.bridged)


def step(p: Params, v: Voice, rms: float) -> tuple[Voice, list[tuple]]:
    """One more window."""
    now = v.now + p.window
    v = v._replace(now=now, loud=now if rms >= p.threshold else v.loud)
    if v.loud < 0:  # only the pre-roll is kept before speech
        return v._replace(begin=max(v.begin, now - p.pre_roll)), []
    v, out = partial(p, v)
    if now - v.begin >= p.roll_hard - p.roll_search and rms < v.dip:
        v = v._replace(dip=rms, dip_at=now)
    for rule in (rolled, ended):
        how = rule(p, v) if v.loud >= 0 else None
        if how:
            v, final = closed(v, how)
            out.append(final)
            if v.loud >= 0:
                v, more = partial(p, v)
                out += more
    return v, out


def flush(v: Voice) -> tuple[Voice, list[tuple]]:
    """Ends what is open."""
    if v.loud < 0:
        return v, []
    v, final = closed(v, Close(v.now, v.now))
    return v, [final]


def segments(energies: Iterable[float], params: Params | None = None) -> list[tuple]:
    """Events of a whole clip, the last segment closed."""
    p, v, out = (params or Params()).check(), Voice(), []
    for x in energies:
        v, more = step(p, v, float(x))
        out += more
    return out + flush(v)[1]


OUT = "clip {}, kind string, segment int, begin_ms long, end_ms long, parent int, bridged boolean"


def segment_clips(frames: DataFrame, params: Params | None = None) -> DataFrame:
    """Events of finished clips: rows (clip, frame, rms), one for each window."""

    def work(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        out = segments(f.sort_values("frame")["rms"], params)
        return pd.DataFrame([(key[0], *e) for e in out], columns=["clip", *EVENT])

    return frames.select("clip", "frame", "rms").groupBy("clip").applyInPandas(work, OUT.format(frames.schema["clip"].dataType.simpleString()))


STATE = "now long, begin long, number int, parent int, loud long, told long, dip double, dip_at long, seen long"
#: Energies that are no sound: the clip ends with a FINAL of what is open, or is given up without one.
FINISH, CANCEL = -1.0, -2.0


def segment_stream(frames: DataFrame, params: Params | None = None, idle: int | None = None) -> DataFrame:
    """The same over a stream of (clip, frame, rms) whose windows reach a clip in order; windows behind those of earlier
    batches are told by an ERROR from the first to the last of them (`ordered.segment_disorder` waits for such windows instead).
    FINISH and CANCEL end a clip, whose state then goes; so does that of a clip without windows for `idle` ms of
    processing time, after a FINAL."""
    p = (params or Params()).check()

    def rows(key: tuple, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *e) for e in out], columns=["clip", *EVENT])

    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *held, seen = state.get if state.exists else (*Voice(), -1)
        v = Voice(*held)
        if state.hasTimedOut:
            state.remove()
            yield rows(key, flush(v)[1])
            return
        out: list[tuple] = []
        new = [w for b in batches for w in zip(b["frame"].tolist(), b["rms"].tolist())]
        over = False
        behind = [f for f, _ in new if f <= seen]
        if behind:
            out.append(("ERROR", v.number, min(behind), max(behind), 0, False))
        # of windows with one time the loudest; an end comes after its sound
        for frame, rms in sorted((w for w in new if w[0] > seen), key=lambda w: (w[0], w[1] < 0, -w[1])):
            if frame == seen and rms >= 0:
                continue
            seen, over = frame, rms < 0
            if over:
                out += flush(v)[1] if rms > CANCEL else []
                v = Voice()
            else:
                v, more = step(p, v, float(rms))
                out += more
        if over:
            if state.exists:
                state.remove()
        else:
            state.update((*v, seen))
            if idle:
                state.setTimeoutDuration(idle)
        if out:
            yield rows(key, out)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return frames.groupBy("clip").applyInPandasWithState(work, OUT.format(frames.schema["clip"].dataType.simpleString()), STATE, "append", timeout)


def latest(events: DataFrame) -> DataFrame:
    """What stands after all events: a FINAL, else the newest PARTIAL, of each segment."""
    best = events.groupBy("clip", "segment").agg(F.max(F.struct((F.col("kind") == "FINAL").alias("final"), "end_ms", "begin_ms", "parent", "bridged")).alias("e"))
    return best.select("clip", "segment", F.when(F.col("e.final"), "FINAL").otherwise("PARTIAL").alias("kind"), "e.begin_ms", "e.end_ms", "e.parent", "e.bridged")


def rolled_texts(finals: DataFrame) -> DataFrame:
    """Texts of FINAL segments (clip, segment, parent, bridged, text): the repeated start goes, and a segment whose end
    is repeated by the next holds its unstable end back."""
    w = Window.partitionBy("clip").orderBy("segment")
    previous = F.when(F.col("parent") == F.lag("segment").over(w), F.lag("text").over(w))
    own = finals.withColumn("previous", previous)
    body = F.when(F.col("previous").isNull(), F.col("text")).otherwise(rolled_overlap_removed(F.coalesce("previous", F.lit("")), F.col("text")))
    own = own.withColumn("body", body)
    return own.withColumn("shown", F.when(F.col("bridged"), stable_prefix(F.col("body"))).otherwise(F.col("body"))).drop("previous")


def session_stream(events: DataFrame, key: str, ts: str, gap: str, watermark: str = "1 day") -> DataFrame:
    """Sessions of a stream of events: key, begins, ends (of the last event's gap), n."""
    return events.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("begins"), F.max(ts).alias("ends")).select(key, "begins", "ends", "n")


def windowed_rms(samples: DataFrame, ts: str = "ts", value: str = "x", width: str = "20 milliseconds", by: Column | None = None) -> DataFrame:
    """Energy of tumbling windows of event time."""
    keys = [F.window(ts, width).alias("w")] + ([by] if by is not None else [])
    return samples.groupBy(*keys).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
