"""Queries of documents beside each other and of damaged packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sidecars as D
from .base import query, table


@query(
    """WITH s AS (SELECT l_orderkey, l_discount AS score FROM lineitem WHERE l_orderkey % 2 = 0 UNION ALL SELECT l_orderkey, l_tax FROM lineitem WHERE l_orderkey % 3 = 0),
m AS (SELECT l_orderkey, count(*) AS n, round(avg(score), 6) AS mean FROM s GROUP BY 1)
SELECT 'out/' || k AS stem, coalesce(n, 0) AS n, mean FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) LEFT JOIN m ON m.l_orderkey = k"""
)
def confidence_of_sidecars(spark, sf_dir):
    """A content list for each order; the model's document for every second, the middle one for every third: scores of both."""
    lines = table(spark, sf_dir, "lineitem").withColumns({"stem": F.concat(F.lit("out/"), F.col("l_orderkey").cast("string")), "page": F.col("l_linenumber") % 2, "idx": F.col("l_partkey")})
    items = lines.select("stem", "page", "idx", F.lit("text").alias("type"), F.array(F.lit(0), F.lit(0), F.col("l_linenumber"), F.lit(1)).alias("bbox"), F.lit(0).alias("angle"), F.lit("x").alias("content"), F.col("l_discount").alias("score"), "l_orderkey")
    blocks = lines.select("stem", "page", "idx", F.lit("text").alias("type"), F.lit("y").alias("text"), F.col("l_tax").alias("confidence"), "l_orderkey")
    lists = lines.select("l_orderkey").distinct().select(F.concat(F.lit("out/"), F.col("l_orderkey").cast("string"), F.lit("_content_list.json")).alias("path"), F.lit("[]").alias("json"))
    files = D.model_documents(items.where("l_orderkey % 2 = 0")).unionByName(D.middle_documents(blocks.where("l_orderkey % 3 = 0"))).unionByName(lists)
    return D.confidence_by_stem(files).select("stem", "n", F.round("mean", 6).alias("mean"))


@query("SELECT 'p' || o_custkey || '_model.json' AS path, '[[' || string_agg('{\"type\":\"text\",\"bbox\":[0.0,1.0,' || (o_orderkey % 7) || '.0,2.5],\"angle\":90,\"content\":\"' || o_orderkey || '\",\"score\":' || (o_orderkey % 4) || '.0}', ',' ORDER BY o_orderkey) || ']]' AS json FROM orders GROUP BY o_custkey")
def model_documents(spark, sf_dir):
    """The model's documents, floats with their point."""
    own = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("stem"), F.lit(0).alias("page"), F.col("o_orderkey").alias("idx"), F.lit("text").alias("type"),
        F.array(F.lit(0.0), F.lit(1.0), (F.col("o_orderkey") % 7).cast("double"), F.lit(2.5)).alias("bbox"), F.lit(90).alias("angle"), F.col("o_orderkey").cast("string").alias("content"), (F.col("o_orderkey") % 4).alias("score"))
    return D.model_documents(own)


@query(
    """WITH p AS (SELECT user_id AS clip, event_id AS seq, event_type, CAST(floor(value * 100) AS INTEGER) % 65536 AS v FROM events), d AS (SELECT clip, event_type IN ('error', 'signup') AS bad, CASE WHEN v >= 32768 THEN v - 65536 ELSE v END AS s FROM p)
SELECT clip, count(*) FILTER (NOT bad) AS kept, count(*) FILTER (bad) AS skipped, round(coalesce(sum(CASE WHEN NOT bad THEN s / 32768.0 END), 0), 6) AS total FROM d GROUP BY clip"""
)
def damaged_packets(spark, sf_dir):
    """Events as packets of one sample; errors are cut short, signups hold no sample at all. Damaged ones are skipped and counted."""
    v = F.lpad(F.hex((F.floor(F.col("value") * 100) % 65536).cast("long")), 4, "0")
    sample = F.concat(F.right(v, F.lit(2)), F.left(v, F.lit(2)))
    payload = F.when(F.col("event_type") == "error", F.left(sample, F.lit(3))).when(F.col("event_type") == "signup", "zzzz").otherwise(sample)
    packets = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), F.col("event_id").alias("seq"), payload.alias("payload"))
    frames, told = D.decoded_packets(packets, D.pcm16(F.col("payload")))
    sums = frames.groupBy("clip").agg(F.sum(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)).alias("total"))
    return told.join(sums, "clip", "left").select("clip", "kept", "skipped", F.round(F.coalesce("total", F.lit(0.0)), 6).alias("total"))


@query(
    f"""SELECT doc_id, md5(text) || ' x ![a](' || CASE WHEN (doc_id % 50) IN (SELECT o_orderkey % 100 FROM orders WHERE o_orderkey % 3 = 0) THEN 'file:///data/' ELSE '' END || 'p/' || (doc_id % 50) || '.png) ![b](http://h/' || (doc_id % 50) || '.png) ![c](file:///data/q.png "t") y' AS shown FROM documents"""
)
def images_that_exist(spark, sf_dir):
    """Relative images become file URIs where the file is there."""
    number = (F.col("doc_id") % 50).cast("string")
    text = F.concat(F.md5(F.col("text").cast("binary")), F.lit(" x ![a](p/"), number, F.lit(".png) ![b](http://h/"), number, F.lit('.png) ![c](q.png "t") y'))
    files = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.concat(F.lit("p/"), (F.col("o_orderkey") % 100).cast("string"), F.lit(".png")).alias("name"))
    files = files.unionByName(spark.range(1).select(F.lit("q.png").alias("name")))
    return D.present_images(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), files, "/data", id="doc_id").select("doc_id", F.col("text").alias("shown"))
