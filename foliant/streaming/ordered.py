"""Speech segments of windows that arrive in any order, and event queues of consumers, as keyed state of a stream.

`segment_disorder` follows a clip by the transition of `speech`, but a window is taken only when the watermark has
passed it: until then it waits in the clip's value, or, of more than WAITING windows, in its list state. So the result does not depend on how windows fall into files
and batches, as long as none is later than the watermark allows; one that is, and can no longer be put in its place, is
told by an ERROR event with the number of such windows. Event-time timers release what waits, and end a clip that has been
without windows for `idle` ms. A clip's end (a window of energy FINISH, CANCEL, or the idle timer) is told by END.
Where a segment repeats the end of the one before (a bridge), the earlier one's end is kept in map state until
the later one's FINAL takes it, once; state that nobody takes expires after `ttl` ms.

`queued` keeps a bounded queue of events for each consumer: what no longer fits pushes out the oldest PARTIAL, a FINAL never
goes, a PARTIAL that finds no room is refused. A POLL takes events from its front.

Both need the RocksDB state store (`with_state_store`). State of a clip: its open segment, a list of waiting windows as
long as the watermark's delay, one number for each bridge. Nothing depends on the number of clips.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .speech import CANCEL, Params, Voice, flush, step

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

VOICE = "now long, begin long, number int, parent int, loud long, told long, dip double, dip_at long, seen long, late long, wakes long, listed long, frames array<bigint>, energies array<double>"
EVENTS = "clip {}, kind string, segment int, begin_ms long, end_ms long, parent int, bridged boolean, overlap_ms long"
COLUMNS = ["clip", "kind", "segment", "begin_ms", "end_ms", "parent", "bridged", "overlap_ms"]


def with_state_store(spark: SparkSession) -> None:
    """Keyed state of these operators lives in RocksDB; a session that names another store than Spark's first one is left as it is."""
    if spark.conf.get(STORE, "HDFSBackedStateStoreProvider").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)


#: Windows that wait in the clip's own value; more of them wait in its list.
WAITING = 256

Told = Row(*COLUMNS)
Polled = Row("consumer", "polled_at", "seq", "kind", "payload", "left", "lost")


class Segmenter(StatefulProcessor):
    """One clip: windows wait in order until the watermark lets them pass. A call reads and writes the clip's value once, since
    each question to the state store costs more than a window's work."""

    def __init__(self, params: Params, idle: int | None, ttl: int | None):
        self.params, self.idle, self.ttl = params, idle, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.voice = handle.getValueState("voice", VOICE)
        self.waiting = handle.getListState("waiting", "frame long, rms double")
        self.bridges = handle.getMapState("bridges", "segment int", "end_ms long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        v, seen, late, wakes, listed, held = self.known()
        new = [(int(r["frame"]), float(r["rms"])) for r in rows]
        behind = [f for f, _ in new if f <= seen]
        if behind:
            late += len(behind)
            yield Told(key[0], "ERROR", v.number, min(behind), max(behind), None, None, late)
        fresh = [(f, x) for f, x in new if f > seen]
        if fresh:
            if listed or len(held) + len(fresh) > WAITING:
                self.waiting.appendList(fresh)
                listed += len(fresh)
            else:
                held += fresh
            wakes = self.wake(min(f for f, _ in fresh) + 1, wakes)
        self.keep(v, seen, late, wakes, listed, held)

    def wake(self, at: int, wakes: int) -> int:
        """The earliest timer for what waits; one that is there already is not asked for again."""
        if 0 <= wakes <= at:
            return wakes
        self.handle.registerTimer(at)
        return at

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Releases the windows that the watermark has passed."""
        now = timerValues.getCurrentWatermarkInMs()
        v, seen, late, wakes, listed, held = self.known()
        if listed:
            held += [(int(f), float(x)) for f, x in self.waiting.get()]
        held.sort()
        due: dict[int, list[float]] = {}
        for f, x in held:
            if f < now:
                due.setdefault(f, []).append(x)
        if not due and not self.idle:
            return  # an earlier timer released it
        rest = [(f, x) for f, x in held if f >= now]
        out: list[tuple] = []
        for frame, values in due.items():
            if values[-1] >= 0:  # of windows with one time the loudest
                v, more = step(self.params, v, values[-1])
                out += more
            if values[0] < 0:
                if values[0] > CANCEL:
                    v, more = flush(v)
                    out += more
                out.append(("END", v.number, v.now, v.now, None, None))
                v = Voice()
            seen = frame
        if due and listed:
            self.waiting.clear()
            listed = len(rest) if len(rest) > WAITING else 0
            if listed:
                self.waiting.put(rest)
        over = bool(out) and out[-1][0] == "END" and not rest
        if self.idle and not rest and not over:
            if seen >= 0 and now - seen > self.idle:
                v, more = flush(v)
                out += [*more, ("END", v.number, v.now, v.now, None, None)]
                over = True
            else:
                self.handle.registerTimer(seen + self.idle + 1)
        wakes = self.wake(rest[0][0] + 1, -1) if rest else -1
        for e in out:
            yield Told(key[0], *e, self.overlap(e))
        if over and not late:
            self.voice.clear()
            self.bridges.clear()
        else:
            self.keep(Voice() if over else v, seen, late, wakes, listed, [] if listed else rest)

    def overlap(self, event: tuple) -> int | None:
        """How much of its predecessor's sound a FINAL repeats; the predecessor's end is taken from the map once."""
        kind, number, begin, end, parent, bridged = event
        if kind != "FINAL":
            return None
        out = None
        if parent and self.bridges.containsKey((parent,)):
            out = self.bridges.getValue((parent,))[0] - begin
            self.bridges.removeKey((parent,))
        if bridged:
            self.bridges.updateValue((number,), (end,))
        return out

    def known(self) -> tuple[Voice, int, int, int, int, list[tuple[int, float]]]:
        own = self.voice.get()
        if own is None:
            return Voice(), -1, 0, -1, 0, []
        *held, seen, late, wakes, listed, frames, rms = own
        return Voice(*held), seen, late, wakes, listed, list(zip(frames, rms))

    def keep(self, v: Voice, seen: int, late: int, wakes: int, listed: int, held: list[tuple[int, float]]) -> None:
        self.voice.update((*v, seen, late, wakes, listed, [f for f, _ in held], [x for _, x in held]))

    def close(self) -> None:
        pass


def segment_disorder(windows: DataFrame, delay: str, params: Params | None = None, idle: int | None = None, ttl: int | None = None) -> DataFrame:
    """Events of a stream of (clip, ts, rms) whose windows may be late by `delay`; times in ms of sound, as in `speech`. Rows
    without time or energy are no windows; a null clip is a clip of its own."""
    with_state_store(windows.sparkSession)
    rows = windows.withWatermark("ts", delay).selectExpr("clip", "unix_millis(ts) AS frame", "rms").where("frame IS NOT NULL AND rms IS NOT NULL")
    kind = windows.schema["clip"].dataType.simpleString()
    return rows.groupBy("clip").transformWithState(Segmenter((params or Params()).check(), idle, ttl), EVENTS.format(kind), "append", "EventTime")


class Queue(StatefulProcessor):
    """Events of one consumer; those of one batch are put in order, those of a later one follow."""

    def __init__(self, limit: int, order: list[str]):
        self.limit, self.order = limit, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        # one value, read and written once: each question to the state store costs more than an event's work
        self.held = handle.getValueState("queue", "lost long, seq array<bigint>, kind array<string>, payload array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.held.get()
        lost = held[0] if held else 0
        queue = list(zip(*held[1:])) if held else []
        for r in sorted(rows, key=lambda r: [(r[c] is None, r[c]) for c in self.order]):
            seq, kind, payload = r["seq"], r["kind"], r["payload"]
            if kind == "POLL":
                take = min(int(payload or 0), len(queue))
                for e in queue[:take]:
                    yield Polled(key[0], seq, *e, len(queue) - take, lost)
                queue = queue[take:]
                continue
            if len(queue) >= self.limit:
                old = next((i for i, q in enumerate(queue) if q[1] == "PARTIAL"), None)
                if old is not None:
                    del queue[old]
                    lost += 1
                elif kind == "PARTIAL":
                    lost += 1
                    continue
            queue.append((seq, kind, payload))
        self.held.update((lost, *([q[k] for q in queue] for k in range(3))))

    def close(self) -> None:
        pass


def queued(events: DataFrame, limit: int = 128, order: list[str] | None = None) -> DataFrame:
    """What consumers poll of a stream of (consumer, seq, kind, payload): kind is PARTIAL, FINAL, or POLL with the
    number wanted as payload. `order`: columns that order a batch, seq by itself. `left`: how many stay; `lost`: PARTIALs
    that found no room so far. Rows without seq or kind are no events; a POLL without a number takes none."""
    with_state_store(events.sparkSession)
    kind = events.schema["consumer"].dataType.simpleString()
    out = f"consumer {kind}, polled_at long, seq long, kind string, payload string, left long, lost long"
    order = order or ["seq"]
    rows = events.where("seq IS NOT NULL AND kind IS NOT NULL").select(*dict.fromkeys(["consumer", "seq", "kind", "payload", *order]))
    return rows.groupBy("consumer").transformWithState(Queue(limit, order), out, "append", "None")
