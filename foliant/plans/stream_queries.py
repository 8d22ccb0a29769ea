"""Streaming queries, run to the end of their input and read back."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import nearest_millis
from ..sources.shared import kept, shared_folder
from ..streaming import ordered, pushed, speech
from .base import query, table
from .signal_queries import SESSIONS, SHORT, speech_sql


#: Files into which a table is split, and files that a batch takes at most: what is not yet worked on waits in the source.
PARTS, FILES_PER_BATCH = 5, 2


#: Bytes of a row group of such a file.
GROUP = 8 << 20


def dealt(rows: DataFrame, part: Column, parts: int) -> list[DataFrame]:
    """Rows by their part, from 0: they are made and dealt once, by all tasks, and each part's file is then written from its own rows alone."""
    spark, folder = rows.sparkSession, f"{shared_folder(rows.sparkSession)}/dealt"
    rows = rows.withColumn("part_", part.cast("int"))
    rows.write.partitionBy("part_").parquet(folder)
    own = spark.read.schema(rows.schema).parquet(folder)
    return [own.where(F.col("part_") == k).drop("part_") for k in range(parts)]


def arriving(parts: list[DataFrame], files: int = FILES_PER_BATCH) -> DataFrame:
    """A stream of these rows: a file for each part, written in this order, a few in each batch."""
    spark, folder = parts[0].sparkSession, shared_folder(parts[0].sparkSession)
    for k, rows in enumerate(parts):
        # small row groups, so that several tasks read a file
        rows.coalesce(1).write.option("parquet.block.size", GROUP).parquet(f"{folder}/in/part-{k:04d}")
    return spark.readStream.schema(parts[0].schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


def timed(rows: DataFrame) -> DataFrame:
    """Event time needs instants; the tables' times have no zone and are read in the session's."""
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"})


def stream_of(spark: SparkSession, sf_dir: str, name: str, ts: str = "ts", parts: int = PARTS, columns: tuple[str, ...] = ("*",)) -> DataFrame:
    """A table's columns as a stream in order of time: its span is cut in equal parts, a file each, so that state crosses batches."""
    rows = timed(table(spark, sf_dir, name).select(*columns))
    place = F.unix_micros(ts)
    low, high = rows.agg(F.min(place), F.max(place)).first()
    if low is None:
        return arriving([rows])
    part = F.least(F.lit(parts - 1), F.floor((place - low) * parts / (high - low + 1)))
    return arriving(dealt(rows, part, parts))


def finished(out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming query over all that its source has and reads its result: in complete mode the last one. Each
    epoch has a folder of its own, so one that is run again replaces what it wrote before."""
    spark = out.sparkSession
    folder = shared_folder(spark)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows" if mode == "complete" else f"{folder}/rows/epoch={epoch}")

    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if q.lastProgress is None:  # the source had nothing
        return spark.createDataFrame([], out.schema)
    return spark.read.schema(out.schema).parquet(f"{folder}/rows") if mode == "complete" else spark.read.schema(out.schema).parquet(f"{folder}/rows/epoch=*")


def zoneless(df: DataFrame) -> DataFrame:
    """Times as the tables have them."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema if f.dataType.typeName() == "timestamp"})


@query(SESSIONS)
def stream_sessions(spark, sf_dir):
    """Sessions of users with gaps of four hours, over a stream; the same as in batch."""
    out = speech.session_stream(stream_of(spark, sf_dir, "events"), "user_id", "ts", "4 hours")
    return zoneless(finished(out, "complete").select("user_id", "begins", "ends", "n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begins, event_type, round(sqrt(avg(value * value)), 6) AS rms FROM events GROUP BY ALL")
def stream_window_energy(spark, sf_dir):
    events = stream_of(spark, sf_dir, "events").withWatermark("ts", "1 day")
    out = speech.windowed_rms(events, value="value", width="1 hour", by=F.col("event_type"))
    return zoneless(finished(out, "complete").select(F.col("w.start").alias("begins"), "event_type", F.round("rms", 6).alias("rms")))


@query("SELECT user_id, event_type, count(*) AS n, max(ts) AS latest FROM events GROUP BY ALL")
def stream_latest(spark, sf_dir):
    """The latest event of each key, updated as events come."""
    events = stream_of(spark, sf_dir, "events")
    return zoneless(finished(events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest")), "complete"))


_WINDOWS = "w AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts)) AS k, CASE WHEN max(value) > 40 THEN max(value) / 100 ELSE 0.0 END AS rms FROM events GROUP BY user_id, epoch_ms(ts))"


def _rms():
    return F.when(F.col("value") > 40, F.col("value") / 100).otherwise(0.0).alias("rms")


@query(speech_sql(_WINDOWS, SHORT, False))
def stream_segments(spark, sf_dir):
    """Speech segments of the events' values, a user a clip, with state in a streaming query; nothing ends the clips."""
    events = stream_of(spark, sf_dir, "events", columns=("user_id", "ts", "value"))
    rows = events.select(F.col("user_id").alias("clip"), nearest_millis("ts").alias("frame"), _rms())
    return finished(speech.segment_stream(rows, SHORT))


#: How late an event may be, and so how long windows wait for those before them.
LATE = "3 days"


def disordered(spark: SparkSession, sf_dir: str, ends: bool) -> DataFrame:
    """Events as windows of (clip, ts, rms), late by up to LATE: each goes to the file of a time after its own. With `ends`
    a window after each clip's last one says so. A clock without sound moves the watermark to the end."""
    rows = timed(table(spark, sf_dir, "events")).select(F.col("user_id").alias("clip"), "ts", _rms())
    if ends:
        rows = rows.unionByName(rows.groupBy("clip").agg((F.max("ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), F.lit(speech.FINISH).alias("rms")))
    clock = rows.agg((F.max("ts") + F.expr(f"INTERVAL {LATE} 1 HOUR")).alias("ts")).select(F.lit(-1).cast("long").alias("clip"), "ts", F.lit(0.0).alias("rms")).where("ts IS NOT NULL")
    late = F.pmod(F.xxhash64("clip", "ts", "rms"), F.lit(3 * 86_400))  # seconds
    rows = rows.withColumn("arrives", F.unix_seconds("ts") + late)
    low, high = rows.agg(F.min("arrives"), F.max("arrives")).first()
    part = F.floor((F.col("arrives") - (low or 0)) * PARTS / ((high or 0) - (low or 0) + 1))
    return arriving([*(r.drop("arrives") for r in dealt(rows, part, PARTS)), clock], files=1)


@query(speech_sql(_WINDOWS, SHORT, False))
def segments_from_disorder(spark, sf_dir):
    """The same segments, though windows arrive up to three days late, in files in no order: they wait for the watermark."""
    out = ordered.segment_disorder(disordered(spark, sf_dir, ends=False), LATE, SHORT)
    return finished(out).select("clip", "kind", "segment", "begin_ms", "end_ms", "parent", "bridged")


@query(
    f"""WITH e AS ({speech_sql(_WINDOWS, SHORT, True)}), b AS (SELECT clip, segment, end_ms FROM e WHERE kind = 'FINAL' AND bridged)
SELECT e.clip, kind, e.segment, begin_ms, e.end_ms, b.end_ms - begin_ms AS overlap_ms FROM e LEFT JOIN b ON kind = 'FINAL' AND b.clip = e.clip AND b.segment = e.parent
UNION ALL SELECT user_id, 'END', NULL, count(DISTINCT epoch_ms(ts)) * {SHORT.window}, count(DISTINCT epoch_ms(ts)) * {SHORT.window}, NULL FROM events GROUP BY user_id"""
)
def segments_ended(spark, sf_dir):
    """Clips that end: the last FINAL, and END; each FINAL with what it repeats of the segment before, from state that is taken once."""
    rows = finished(ordered.segment_disorder(disordered(spark, sf_dir, ends=True), LATE, SHORT))
    return rows.select("clip", "kind", F.when(F.col("kind") != "END", F.col("segment")).alias("segment"), "begin_ms", "end_ms", "overlap_ms")


QUEUE = 3


@query(
    f"""WITH RECURSIVE o AS (SELECT user_id AS consumer, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'FINAL' WHEN 'signup' THEN 'POLL' ELSE 'PARTIAL' END AS kind FROM events),
s AS (SELECT consumer, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(seq BIGINT, kind VARCHAR)[]) AS q, CAST(0 AS BIGINT) AS lost, CAST(NULL AS BIGINT) AS polled_at, CAST([] AS STRUCT(seq BIGINT, kind VARCHAR)[]) AS told FROM (SELECT DISTINCT consumer FROM o)
UNION ALL SELECT consumer, k, CASE WHEN kind = 'POLL' THEN q[3:] WHEN len(q) < {QUEUE} THEN list_append(q, {{'seq': seq, 'kind': kind}}) WHEN old IS NOT NULL THEN list_append(list_concat(q[:old - 1], q[old + 1:]), {{'seq': seq, 'kind': kind}}) WHEN kind = 'FINAL' THEN list_append(q, {{'seq': seq, 'kind': kind}}) ELSE q END,
  lost + CASE WHEN kind <> 'POLL' AND len(q) >= {QUEUE} AND (old IS NOT NULL OR kind = 'PARTIAL') THEN 1 ELSE 0 END, CASE WHEN kind = 'POLL' THEN seq END, CASE WHEN kind = 'POLL' THEN q[:2] ELSE [] END
FROM (SELECT s.consumer, o.k, s.q, s.lost, o.seq, o.kind, list_position(list_transform(s.q, lambda x: x.kind), 'PARTIAL') AS old FROM s JOIN o ON o.consumer = s.consumer AND o.k = s.k + 1))
SELECT consumer, polled_at, e.seq AS seq, e.kind AS kind, len(q)::BIGINT AS "left", lost FROM (SELECT consumer, polled_at, q, lost, unnest(told) AS e FROM s)"""
)
def event_queues(spark, sf_dir):
    """A queue of three events for each user, over several batches: a purchase is FINAL and stays, a signup takes two from the front."""
    kind = F.when(F.col("event_type") == "purchase", "FINAL").when(F.col("event_type") == "signup", "POLL").otherwise("PARTIAL")
    events = stream_of(spark, sf_dir, "events", columns=("user_id", "ts", "event_id", "event_type")).select(F.col("user_id").alias("consumer"), "ts", "event_id", kind.alias("kind"))
    rows = events.select("consumer", F.struct(F.unix_micros("ts").alias("at"), F.col("event_id").alias("id")).alias("place"), "kind")
    rows = rows.select("consumer", F.col("place.id").alias("seq"), "kind", F.lit("2").alias("payload"), F.col("place.at").alias("at"))
    return finished(ordered.queued(rows, QUEUE, order=["at", "seq"])).select("consumer", "polled_at", "seq", "kind", "left", "lost")


#: Pushes into which a table is dealt, and how long (in seconds) a producer waits for its consumer.
PUSHES, PATIENCE = 24, 120


def pushed_when_taken(q, chunk: DataFrame, spool: str) -> None:
    """Pushes again until the consumer has made room: it notes what it took when it asks for its next batch, which may come
    after all that lay there was worked on."""
    ends = time.monotonic() + PATIENCE
    while True:
        q.processAllAvailable()
        try:
            pushed.push(chunk, spool)
            return
        except pushed.Backpressure:
            if time.monotonic() > ends:
                raise
            time.sleep(0.1)


@query("SELECT user_id, count(*) AS n, round(sum(value), 6) AS total, true AS within FROM events GROUP BY user_id")
def pushed_events(spark, sf_dir):
    """Events pushed as windows of 20 ms by a producer that is refused while two minutes lie unprocessed, and taken by a stream
    whose batches never pass two minutes; in the middle the query stops and goes on from its checkpoint."""
    folder = shared_folder(spark)
    rows = timed(table(spark, sf_dir, "events")).select("event_id", "ts", "user_id", "value")
    # dealt once: bounds are sampled anew in each run, and places that were counted by other bounds would leave gaps
    ranges = kept(rows.repartitionByRange(8, "ts", "event_id").withColumn("part", F.spark_partition_id()))
    sizes = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(sizes), F.lit(0))).drop("n")
    own = Window.partitionBy("part").orderBy("ts", "event_id")
    step = 90_000
    # a larger table has several events in each window, so pushes and batches stay as many while they grow
    together = max(1, -(-rows.count() * 20 // (step * PUSHES)))
    windows = ranges.join(F.broadcast(before), "part").withColumn("at", F.floor((F.row_number().over(own) - 1 + F.col("before")) / together) * 20).select("at", "user_id", "value")
    windows.write.parquet(f"{folder}/windows")
    windows = spark.read.parquet(f"{folder}/windows")
    end = (windows.agg(F.max("at")).first()[0] or 0) + 1

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/epoch={epoch}")

    def start():
        stream = pushed.read_pushed(spark, f"{folder}/spool", "at long, user_id long, value double")
        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").start()

    q = None
    for k in range(0, end, step):
        chunk = windows.where((F.col("at") >= k) & (F.col("at") < k + step)).coalesce(2)
        try:
            pushed.push(chunk, f"{folder}/spool")
        except pushed.Backpressure:
            if q is None or k // step == 2:  # starts, or starts again
                if q is not None:
                    q.stop()
                q = start()
            pushed_when_taken(q, chunk, f"{folder}/spool")
    q = q or start()
    q.processAllAvailable()
    q.stop()
    taken = spark.read.schema("at long, user_id long, value double, epoch int").parquet(f"{folder}/rows")
    longest = taken.groupBy("epoch").agg((F.max("at") - F.min("at")).alias("ms")).agg(F.max("ms")).first()[0] or 0
    return taken.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.lit(longest < pushed.LIMIT).alias("within"))
