"""Streams with state: disorder, late windows, ends of clips, bounded queues, a pushed source."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliant.sources import published
from foliant.streaming import ordered as O
from foliant.streaming import pushed, speech

WINDOWS = "clip long, ts timestamp, rms double"
SHORT = speech.Params(endpoint=200, pre_roll=40, chunk=100, roll_target=160, roll_hard=240, roll_search=100, roll_pause=40, roll_overlap=60)


def stream(spark, folder, batches):
    """Batches of (clip, ms, rms), a file and a trigger for each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "clip long, ms long, rms double").selectExpr("clip", "timestamp_millis(ms) AS ts", "rms").coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    return spark.readStream.schema(WINDOWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{folder}/in")


def ran(df, folder, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return q, [tuple(r) for r in df.sparkSession.sql(f"select * from {name}").collect()]


def clips(seed, n=200):
    rng = random.Random(seed)
    return {c: [rng.choice([0.1, 0.2, 0.05]) if rng.random() < (0.95 if (i // 40) % 3 else 0.1) else 0.0 for i in range(n)] for c in (1, 2)}


CLOCK = (-1, 10**10, 0.0)  # moves the watermark past everything; silent


@pytest.mark.parametrize("seed", [1, 2])
def test_disorder_gives_what_order_gives(spark, tmp_path, seed):
    """Windows dealt to files at random, some of them twice; bridges keep what they overlap."""
    energies = clips(seed)
    rows = [(c, i * 20, x) for c, own in energies.items() for i, x in enumerate(own)]
    rng = random.Random(seed)
    rows += rng.sample(rows, 30)
    rng.shuffle(rows)
    nulls = [(1, None, 0.1), (2, 40, None), (None, 0, 0.0)]
    df = O.segment_disorder(stream(spark, tmp_path, [rows[0::3], rows[1::3] + nulls, [*rows[2::3], CLOCK]]), "10 seconds", SHORT)
    q, got = ran(df, tmp_path, f"disorder{seed}")
    assert not [r for r in got if r[1] in ("ERROR", "END")]
    for c, own in energies.items():
        want = speech.segments(own, SHORT)
        mine = sorted(r[1:7] for r in got if r[0] == c)
        last = max(e for e in want if e[0] == "FINAL")
        assert mine in (sorted(want), sorted(e for e in want if e != last))  # nothing ends the clip
        ends = {r[2]: r[4] for r in got if r[0] == c and r[1] == "FINAL" and r[6]}
        for r in got:
            if r[0] == c and r[1] == "FINAL":
                assert r[7] == (ends[r[5]] - r[3] if r[5] else None)
    assert any(r[7] for r in got)


def test_late_windows_are_told(spark, tmp_path):
    """A window behind what was released is an ERROR with the number of those so far; one that can still be placed is not."""
    on = [(1, i * 20, 0.1) for i in range(50)]
    late = [(1, 300, 0.1), (1, 320, 0.1)]
    df = O.segment_disorder(stream(spark, tmp_path, [[r for r in on if r not in late], [(-1, 900, 0.0)], late + [(1, 1000, 0.1)], [CLOCK]]), "0 seconds", SHORT)
    _, got = ran(df, tmp_path, "late")
    errors = [r for r in got if r[1] == "ERROR"]
    assert [(r[3], r[4], r[7]) for r in errors] == [(300, 320, 2)]


def test_ends_leave_no_state(spark, tmp_path):
    """FINISH, CANCEL and idle clips: END for each, a FINAL but for the cancelled one."""
    loud = [(c, i * 20, 0.1) for c in (1, 2, 3) for i in range(8)]
    df = O.segment_disorder(stream(spark, tmp_path, [[*loud[::2], (1, 160, speech.FINISH)], [*loud[1::2], (2, 160, speech.CANCEL), (-1, 5000, 0.0)], [(4, 10_000, 0.0), (-1, 20_000, 0.0)], [CLOCK]]), "1 second", SHORT, idle=1000)
    q, got = ran(df, tmp_path, "ends")
    assert sorted(r[0] for r in got if r[1] == "END" and r[0] > 0) == [1, 2, 3, 4]
    assert sorted((r[0], r[3], r[4]) for r in got if r[1] == "FINAL") == [(1, 0, 160), (3, 0, 160)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6  # of the clock alone


def plain_queue(rows, limit):
    queue, lost, out = [], 0, []
    for consumer, seq, kind, payload in rows:
        if kind == "POLL":
            n = min(int(payload), len(queue))
            out += [(consumer, seq, *e, len(queue) - n, lost) for e in queue[:n]]
            queue = queue[n:]
            continue
        if len(queue) >= limit:
            at = next((i for i, e in enumerate(queue) if e[1] == "PARTIAL"), None)
            if at is not None:
                queue.pop(at)
                lost += 1
            elif kind == "PARTIAL":
                lost += 1
                continue
        queue.append((seq, kind, payload))
    return out


def test_queues(spark, tmp_path):
    rng = random.Random(5)
    rows = {c: [(c, k, *rng.choice([("PARTIAL", f"p{k}")] * 5 + [("FINAL", f"f{k}")] * 2 + [("POLL", "2")])) for k in range(120)] + [(c, 120, "POLL", "999")] for c in (1, 2)}
    for k in range(0, 121, 11):
        spark.createDataFrame([r for own in rows.values() for r in own[k : k + 11]], "consumer long, seq long, kind string, payload string").coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    df = O.queued(spark.readStream.schema("consumer long, seq long, kind string, payload string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in"), 4)
    _, got = ran(df, tmp_path, "queues")
    assert sorted(got) == sorted(r for own in rows.values() for r in plain_queue(own, 4))
    finals = {(c, k) for own in rows.values() for c, k, kind, _ in own if kind == "FINAL"}
    assert {(r[0], r[2]) for r in got if r[3] == "FINAL"} == finals and any(r[6] for r in got)


def rows_at(spark, low, high):
    return spark.range(low, high, 20).select(F.col("id").alias("at"), (F.col("id") % 7).alias("x"))


def test_push_is_refused_until_consumers_have_worked(spark, tmp_path):
    path, seen = f"{tmp_path}/spool", []
    assert pushed.push(rows_at(spark, 0, 100_000), path) == 99_981
    with pytest.raises(pushed.Backpressure):
        pushed.push(rows_at(spark, 100_000, 130_000), path)
    with pytest.raises(ValueError):
        pushed.push(rows_at(spark, 50_000, 60_000), path)
    with pytest.raises(ValueError):
        pushed.push(rows_at(spark, 100_000, 100_040).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS at, 1L AS x")), path)
    assert pushed.push(rows_at(spark, 100_000, 110_000), path) == 109_981 and pushed.push(rows_at(spark, 0, 0), path) == 109_981

    def note(batch, epoch):
        r = batch.agg(F.min("at"), F.max("at"), F.count("*"), F.sum("x")).first()
        if r[2]:
            seen.append((epoch, *r))

    def start():
        return pushed.read_pushed(spark, path, limit=30_000).writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/cp").start()

    q = start()
    q.processAllAvailable()
    q.stop()
    assert [(s[1], s[2]) for s in seen] == [(k, min(k + 29_980, 109_980)) for k in range(0, 110_000, 30_000)]
    # consumed: there is room, and what was taken leaves the manifest
    assert pushed.push(rows_at(spark, 110_000, 215_000), path) == 214_981
    assert published.manifest(path)["rows"] <= 215_000 // 20
    q = start()  # goes on from its checkpoint
    q.processAllAvailable()
    q.stop()
    assert sum(s[3] for s in seen) == 215_000 // 20 and sum(s[4] for s in seen) == sum(k % 7 for k in range(0, 215_000, 20))
    assert max(s[2] - s[1] for s in seen) < 30_000 and len({s[0] for s in seen}) == len(seen)


def test_a_batch_that_failed_is_run_again(spark, tmp_path):
    path, seen, broken = f"{tmp_path}/spool", {}, [True]
    pushed.push(rows_at(spark, 0, 50_000), path)

    def note(batch, epoch):
        n = batch.count()
        if epoch == 1 and broken[0]:
            raise RuntimeError("lost")
        if n:
            seen[epoch] = seen.get(epoch, 0) + n

    def start():
        return pushed.read_pushed(spark, path, limit=20_000).writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/cp").start()

    with pytest.raises(PySparkException):
        start().processAllAvailable()
    broken[0] = False
    q = start()
    q.processAllAvailable()
    q.stop()
    assert seen == {0: 1000, 1: 1000, 2: 500}
