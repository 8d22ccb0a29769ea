"""Joins of boxes and intervals where one page, or one key, has all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import nearest_millis
from ..operators import spatial as G
from .base import query, table

#: One strip of a page with a box for each line; every seventh line is a large one.
ALL_BOXES = """b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber AS kind, l_orderkey * 6.0 + l_partkey % 50 AS xmin, (l_suppkey * 37.0 + l_partkey) % 1000 AS ymin,
  l_orderkey * 6.0 + l_partkey % 50 + l_quantity * CASE WHEN l_linenumber = 7 THEN 20 ELSE 1 END AS xmax, (l_suppkey * 37.0 + l_partkey) % 1000 + l_quantity * CASE WHEN l_linenumber = 7 THEN 10 ELSE 0.5 END AS ymax FROM lineitem)"""


def all_boxes(spark, sf_dir):
    large = F.col("l_linenumber") == 7
    xmin, ymin = F.col("l_orderkey") * 6.0 + F.col("l_partkey") % 50, (F.col("l_suppkey") * 37.0 + F.col("l_partkey")) % 1000
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").alias("kind"), xmin.alias("xmin"), ymin.alias("ymin"),
        (xmin + F.col("l_quantity") * F.when(large, 20).otherwise(1)).alias("xmax"), (ymin + F.col("l_quantity") * F.when(large, 10.0).otherwise(0.5)).alias("ymax"),
    )


_SHARED = "greatest(0, least(l.xmax, r.xmax) - greatest(l.xmin, r.xmin)) * greatest(0, least(l.ymax, r.ymax) - greatest(l.ymin, r.ymin))"


@query(
    f"""WITH {ALL_BOXES}, p AS (SELECT l.id AS a, r.id AS b, {_SHARED} AS shared, (l.xmax - l.xmin) * (l.ymax - l.ymin) + (r.xmax - r.xmin) * (r.ymax - r.ymin) AS areas
  FROM b l JOIN b r ON l.xmin < r.xmax AND l.xmax > r.xmin AND l.ymin < r.ymax AND l.ymax > r.ymin AND l.id < r.id)
SELECT a, b, round(shared / nullif(areas - shared, 0), 9) AS iou FROM p WHERE shared / nullif(areas - shared, 0) >= 0.05"""
)
def overlaps_on_one_page(spark, sf_dir):
    """Boxes of the whole table on one page: all pairs with an overlap of a twentieth of their union."""
    pairs = G.boxes_meeting_each_other(all_boxes(spark, sf_dir).drop("kind"), "id", page=None)
    area = lambda s: (F.col(f"{s}.xmax") - F.col(f"{s}.xmin")) * (F.col(f"{s}.ymax") - F.col(f"{s}.ymin"))
    iou = F.try_divide("shared", area("l") + area("r") - F.col("shared"))
    return pairs.where(iou >= 0.05).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.round(iou, 9).alias("iou"))


@query(
    f"""WITH {ALL_BOXES}, p AS (SELECT l.id AS id, r.id AS o, {_SHARED} / nullif((l.xmax - l.xmin) * (l.ymax - l.ymin), 0) AS covered FROM b l JOIN b r ON r.kind = 7 AND l.kind < 7 AND l.xmin < r.xmax AND l.xmax > r.xmin AND l.ymin < r.ymax AND l.ymax > r.ymin)
SELECT id, o AS "outer", round(covered, 9) AS covered FROM p WHERE covered >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY covered DESC, o) = 1"""
)
def covered_on_one_page(spark, sf_dir):
    """For each small box the large one that covers most of it, half at least."""
    boxes = all_boxes(spark, sf_dir)
    out = G.covering(boxes.where("kind < 7"), boxes.where("kind = 7"), 0.5, "id", "id", page=None)
    return out.select("id", "outer", F.round("covered", 9).alias("covered"))


@query(
    """WITH e AS (SELECT event_id, event_type, epoch_ms(ts) AS b, epoch_ms(ts) + CAST(floor(value * 6000) AS BIGINT) AS e FROM events)
SELECT l.event_id AS event_id, count(*) AS n, min(r.event_id) AS first FROM e l JOIN e r ON l.event_type = 'purchase' AND r.event_type = 'error' AND l.b <= r.e AND l.e >= r.b GROUP BY 1"""
)
def intervals_of_one_key(spark, sf_dir):
    """Purchases and errors as intervals of up to minutes: how many errors each purchase meets, over all users at once."""
    begin = nearest_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", begin.alias("begin"), (begin + F.floor(F.col("value") * 6000)).alias("end"))
    pairs = G.intervals_meeting(rows.where("event_type = 'purchase'"), rows.where("event_type = 'error'"))
    return pairs.groupBy(F.col("l.event_id").alias("event_id")).agg(F.count("*").alias("n"), F.min("r.event_id").alias("first"))
