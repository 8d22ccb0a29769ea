"""Scans and medians where one clip has all rows. Blocks are short here, so that there are many of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans as C
from .base import query, table

BLOCK = 500


def one_clip(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.lit(0).alias("clip"), F.col("event_id").alias("frame"), F.col("value").alias("rms"))


@query("SELECT event_id AS frame, min(value) OVER w AS low, arg_min(event_id, value) OVER w AS low_frame FROM events WINDOW w AS (ORDER BY event_id)")
def minimum_of_one_clip(spark, sf_dir):
    return C.running_minimum(one_clip(spark, sf_dir), BLOCK).select("frame", "low", "low_frame")


@query("SELECT frame, frame - coalesce(max(CASE WHEN value >= 30 THEN frame END) OVER w, min(frame) OVER w - 1) AS silence FROM (SELECT event_id AS frame, value FROM events) WINDOW w AS (ORDER BY frame)")
def silence_of_one_clip(spark, sf_dir):
    return C.silence_runs(one_clip(spark, sf_dir), 30.0, BLOCK).select("frame", "silence")


@query(
    """WITH o AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT session::BIGINT AS session, min(ts) AS begins, max(ts) AS ends, count(*) AS n FROM s GROUP BY session"""
)
def sessions_of_one_key(spark, sf_dir):
    """Sessions of all users together, numbered through."""
    return C.sessions(table(spark, sf_dir, "events"), None, "ts", 300).select("session", "begins", "ends", "n")


@query("SELECT 'all' AS clip, count(value) AS n, list_sort(list(value))[count(value) // 2 + 1] AS median FROM events UNION ALL SELECT event_type, count(value), list_sort(list(value))[count(value) // 2 + 1] FROM events GROUP BY event_type")
def medians_of_long_clips(spark, sf_dir):
    """The upper median of all events, and of each type, by rounds of histograms."""
    rows = table(spark, sf_dir, "events").select(F.explode(F.array(F.lit("all"), "event_type")).alias("clip"), F.col("value").alias("x"))
    return C.upper_median(rows, leaf=50, bins=16)
