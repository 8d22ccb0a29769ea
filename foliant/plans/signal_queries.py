"""Queries over signals. The events' values of a user, in order of time, stand for samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import signal as S
from ..streaming import speech
from .base import query, table

SAMPLES = "samples AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value / 100.0 AS x FROM events)"
FRAMES = f"{SAMPLES}, frames AS (SELECT clip, i // 4 AS frame, sqrt(avg(x * x)) AS rms FROM samples GROUP BY ALL)"


def samples(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), (F.row_number().over(w) - 1).cast("long").alias("i"), (F.col("value") / 100.0).alias("x"))


def frames(spark, sf_dir) -> DataFrame:
    return S.frame_rms(samples(spark, sf_dir), 4)


@query(f"WITH {FRAMES} SELECT clip, frame, round(rms, 9) AS rms FROM frames")
def frame_energy(spark, sf_dir):
    return frames(spark, sf_dir).select("clip", "frame", F.round("rms", 9).alias("rms"))


@query(f"WITH {FRAMES} SELECT clip, round(list_extract(list_sort(list(rms)), CAST(count(*) // 2 + 1 AS BIGINT)), 9) AS median, round(greatest(0.008, 0.35 * list_extract(list_sort(list(rms)), CAST(count(*) // 2 + 1 AS BIGINT))), 9) AS threshold FROM frames GROUP BY clip")
def silence_thresholds(spark, sf_dir):
    return S.silence_threshold(frames(spark, sf_dir)).select("clip", F.round("median", 9).alias("median"), F.round("threshold", 9).alias("threshold"))


@query(f"WITH {FRAMES}, r AS (SELECT *, min(rms) OVER (PARTITION BY clip ORDER BY frame) AS low FROM frames) SELECT clip, frame, round(low, 9) AS low FROM r")
def running_minimum(spark, sf_dir):
    return S.running_minimum(frames(spark, sf_dir)).select("clip", "frame", F.round("low", 9).alias("low"))


@query(
    f"""WITH {FRAMES}, v AS (SELECT *, max(CASE WHEN rms >= 0.5 THEN frame END) OVER (PARTITION BY clip ORDER BY frame) AS voiced, min(frame) OVER (PARTITION BY clip) AS f0 FROM frames)
SELECT clip, frame, CASE WHEN voiced IS NULL THEN frame - f0 + 1 ELSE frame - voiced END AS silence FROM v"""
)
def silence_runs(spark, sf_dir):
    return S.silence_runs(frames(spark, sf_dir), 0.5).select("clip", "frame", "silence")


@query(
    f"""WITH {SAMPLES}, n AS (SELECT clip, greatest(1, count(*) * 3 // 2) AS m, count(*) AS n FROM samples GROUP BY clip), o AS (SELECT clip, n, unnest(range(m)) AS o FROM n),
p AS (SELECT clip, n, o, o * 2 // 3 AS i0, o * 2 / 3.0 - o * 2 // 3 AS part FROM o)
SELECT p.clip, p.o AS i, round(a.x + (b.x - a.x) * part, 6) AS x FROM p JOIN samples a ON a.clip = p.clip AND a.i = p.i0 JOIN samples b ON b.clip = p.clip AND b.i = least(p.i0 + 1, p.n - 1)"""
)
def resampled(spark, sf_dir):
    return S.resample(samples(spark, sf_dir), 2, 3).select("clip", "i", F.round("x", 6).alias("x"))


@query("SELECT user_id AS clip, event_type AS channel, round(avg(value), 6) AS sample FROM events GROUP BY ALL")
def downmixed(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), F.col("event_type").alias("frame"), F.lit(0).alias("channel"), F.col("value").alias("sample"))
    return S.downmix(own).select("clip", F.col("frame").alias("channel"), F.round("sample", 6).alias("sample"))


@query("SELECT event_id, (event_id * 16000 + 999) // 1000 AS frames, event_id * 1000 // 16000 AS ms FROM events")
def time_conversion(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.ms_to_frames(F.col("event_id")).alias("frames"), S.frames_to_ms(F.col("event_id")).alias("ms"))


SESSIONS = """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT user_id, min(ts) AS begins, max(ts) AS ends, count(*) AS n FROM s GROUP BY user_id, session"""


@query(SESSIONS)
def event_sessions(spark, sf_dir):
    return S.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 4 * 3600).select("user_id", "begins", "ends", "n")


@query(
    f"""WITH {SAMPLES}, s AS (SELECT clip, 1 AS segment, 5 AS b, 8 AS e FROM samples GROUP BY clip) SELECT s.clip, CAST(count(*) AS BIGINT) AS n, round(sum(x), 6) AS total FROM s JOIN samples x ON x.clip = s.clip AND x.i >= s.b - 3 AND x.i < s.e GROUP BY s.clip"""
)
def segments_with_pre_roll(spark, sf_dir):
    own = samples(spark, sf_dir)
    segments = own.select("clip").distinct().select("clip", F.lit(1).alias("segment"), F.lit(5).alias("begin"), F.lit(8).alias("end"))
    return S.pre_roll(segments, own, 3).groupBy("clip").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("total"))


#: Every place where a piece may begin, and where it then ends: after the silence found last before its goal.
SLICES = f"""WITH RECURSIVE {SAMPLES}, n AS (SELECT clip, count(*) AS n FROM samples GROUP BY clip),
e AS (SELECT clip, i // 2 AS f, CAST(sqrt(avg(CAST(CAST(x AS FLOAT) AS DOUBLE) ** 2)) AS FLOAT) AS rms FROM samples GROUP BY ALL),
m AS (SELECT clip, greatest(CAST(0.008 AS FLOAT), CAST(list_extract(list_sort(list(rms)), CAST(count(*) // 2 + 1 AS BIGINT)) * CAST(0.35 AS FLOAT) AS FLOAT)) AS least FROM e GROUP BY clip),
q AS (SELECT e.clip, f, rms < least AS silent, max(CASE WHEN rms < least THEN -1 ELSE f END) OVER (PARTITION BY e.clip ORDER BY f) + 1 AS run FROM e JOIN m USING (clip)),
b AS (SELECT samples.clip, i AS b, i + 20 AS goal, n FROM samples JOIN n USING (clip)),
c AS (SELECT b.clip, b, max_by(greatest(run * 2 - 1, b), f) AS edge FROM b JOIN q ON q.clip = b.clip AND silent AND f <= goal // 2 AND (f = goal // 2 OR f * 2 + 1 > CASE WHEN goal > 5 THEN goal - 5 ELSE b END)
  AND goal - greatest(run * 2 - 1, b) >= 2 WHERE goal < n GROUP BY ALL),
z AS (SELECT b.clip, b, n, CASE WHEN goal >= n THEN n WHEN edge IS NULL THEN goal ELSE greatest(b + 2, least(n, edge + 1)) END AS e FROM b LEFT JOIN c USING (clip, b)),
r AS (SELECT clip, 0 AS slice, b, least(e, b + 40) AS e, n FROM z WHERE b = 0
  UNION ALL SELECT r.clip, slice + 1, z.b, least(z.e, z.b + 40), z.n FROM r JOIN z ON z.clip = r.clip AND z.b = r.e - CASE WHEN r.e - r.b > 5 THEN 5 ELSE 0 END WHERE r.e < r.n)
SELECT clip, slice, b AS begin, e AS end FROM r"""


@query(SLICES)
def silence_slices(spark, sf_dir):
    own = samples(spark, sf_dir).groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("clip", F.transform("s", lambda s: s["x"]).alias("samples"))
    return S.slice_clips(own, rate=10, target=2.0, longest=4.0, overlap=0.5, least_silence=0.5, frame_s=0.2)


#: Short enough that the clips roll over, at pauses and at the limit.
SHORT = speech.Params(endpoint=200, pre_roll=40, chunk=100, roll_target=160, roll_hard=240, roll_search=100, roll_pause=40, roll_overlap=60)


def speech_sql(windows: str, p: speech.Params, flush: bool) -> str:
    """The segmenter's events in DuckDB's SQL, a window in each step; `windows`: CTEs that end with w (clip, k from 1, rms)."""
    events = [
        ("PARTIAL", "told_now", "num", "beg", "now", "parent", "false"), ("FINAL", "pause OR hard", "num", "beg", "cut", "parent", "hard"),
        ("PARTIAL", "told_after", "num2", "beg2", "now", "parent2", "false"), ("FINAL", "over", "num2", "beg2", "now", "parent2", "false"),
    ]
    out = [f"SELECT clip, '{kind}' AS kind, {num} AS segment, {beg} AS begin_ms, {end} AS end_ms, {par} AS parent, {br} AS bridged FROM s WHERE {when}" for kind, when, num, beg, end, par, br in events]
    if flush:
        out.append("SELECT clip, 'FINAL', num3, beg3, now, parent3, false FROM s WHERE loud3 >= 0 AND k = (SELECT max(k) FROM w WHERE w.clip = s.clip)")
    return f"""WITH RECURSIVE {windows},
s AS (SELECT DISTINCT clip, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS now, CAST(0 AS BIGINT) AS beg, 0 AS num, 0 AS parent, false AS told_now, false AS pause, false AS hard, CAST(0 AS BIGINT) AS cut, 0 AS num2, CAST(0 AS BIGINT) AS beg2, 0 AS parent2,
  false AS told_after, false AS over, 1 AS num3, CAST(0 AS BIGINT) AS beg3, 0 AS parent3, CAST(-1 AS BIGINT) AS loud3, CAST(0 AS BIGINT) AS told3, CAST('inf' AS DOUBLE) AS dip3, CAST(-1 AS BIGINT) AS dip_at3 FROM w
UNION ALL SELECT clip, k, now, beg, num, parent, told_now, pause, hard, cut, num2, beg2, parent2, told_after, over,
  num2 + CASE WHEN over THEN 1 ELSE 0 END, CASE WHEN over THEN now ELSE beg2 END, CASE WHEN over THEN 0 ELSE parent2 END, CASE WHEN over THEN -1 ELSE loud2 END, CASE WHEN over THEN 0 ELSE told2 END, CASE WHEN over THEN 'inf' ELSE dip2 END, CASE WHEN over THEN -1 ELSE dip_at2 END
FROM (SELECT *, hard AND told2 > 0 AS told_after, loud2 >= 0 AND now - loud2 >= {p.endpoint} AS over
FROM (SELECT *, CASE WHEN pause OR hard THEN num + 1 ELSE num END AS num2, CASE WHEN hard THEN num WHEN pause THEN 0 ELSE parent END AS parent2, CASE WHEN pause THEN -1 ELSE loud END AS loud2,
  CASE WHEN pause THEN now WHEN hard THEN greatest(beg, cut - {p.roll_overlap}) ELSE beg END AS beg2, CASE WHEN pause THEN 0 WHEN hard THEN (now - greatest(beg, cut - {p.roll_overlap})) // {p.chunk} WHEN told_now THEN (now - beg) // {p.chunk} ELSE told END AS told2,
  CASE WHEN pause OR hard THEN 'inf' ELSE dip END AS dip2, CASE WHEN pause OR hard THEN -1 ELSE dip_at END AS dip_at2
FROM (SELECT *, loud >= 0 AND (now - beg) // {p.chunk} > told AS told_now, long AND now - loud >= {p.roll_pause} AS pause, loud >= 0 AND now - beg >= {p.roll_hard} AND NOT (long AND now - loud >= {p.roll_pause}) AS hard,
  CASE WHEN long AND now - loud >= {p.roll_pause} THEN now WHEN dip_at > beg THEN dip_at ELSE least(beg + {p.roll_hard}, now) END AS cut
FROM (SELECT *, loud >= 0 AND now - beg >= {p.roll_target} AS long, CASE WHEN weak THEN rms ELSE dip0 END AS dip, CASE WHEN weak THEN now ELSE dip_at0 END AS dip_at
FROM (SELECT *, loud >= 0 AND now - beg >= {p.roll_hard - p.roll_search} AND rms < dip0 AS weak
FROM (SELECT *, CASE WHEN loud >= 0 THEN beg0 ELSE greatest(beg0, now - {p.pre_roll}) END AS beg
FROM (SELECT s.clip, w.k, rms, s.now + {p.window} AS now, CASE WHEN rms >= {p.threshold} THEN s.now + {p.window} ELSE loud3 END AS loud, beg3 AS beg0, num3 AS num, parent3 AS parent, told3 AS told, dip3 AS dip0, dip_at3 AS dip_at0 FROM s JOIN w ON w.clip = s.clip AND w.k = s.k + 1))))))))
{" UNION ALL ".join(out)}"""


@query(speech_sql(f"{FRAMES}, w AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY frame) AS k, CASE WHEN rms > 0.4 THEN rms ELSE 0.0 END AS rms FROM frames)", SHORT, True))
def speech_segments(spark, sf_dir):
    own = frames(spark, sf_dir).withColumn("rms", F.when(F.col("rms") > 0.4, F.col("rms")).otherwise(0.0))
    return speech.segment_clips(own, SHORT)
