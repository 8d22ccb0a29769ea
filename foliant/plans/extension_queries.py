"""Queries of the extension surface, of long texts' edits and of walks through nested documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import edit, jsonx
from ..operators import extension as E
from .base import query, table


@query("SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events) GROUP BY user_id, event_type, g")
def runs_by_table_function(spark, sf_dir):
    """Runs of equal events of a user, by a function of a table under its SQL name."""
    E.register(spark)
    table(spark, sf_dir, "events").createOrReplaceTempView("events_for_runs")
    return spark.sql("SELECT * FROM runs_of(TABLE(events_for_runs), 'user_id', 'event_id', 'event_type')")


@query("SELECT l_returnflag, l_shipdate::DATE AS day, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_extendedprice) / 1e6, 6) AS variance FROM lineitem GROUP BY ALL")
def moments_by_partial_states(spark, sf_dir):
    """Number, mean and variance by a user's aggregate whose states are merged; two keys."""
    own = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_shipdate").cast("date").alias("day"), "l_extendedprice")
    out = E.aggregated(own, ["l_returnflag", "day"], "l_extendedprice", E.MOMENTS)
    return out.select("l_returnflag", "day", "n", F.round("mean", 4).alias("mean"), F.round(F.col("variance") / 1e6, 6).alias("variance"))


#: Ids of documents that one sort takes at most.
STRETCH = 1024


# characters beyond ASCII are one sign each, since DuckDB's levenshtein counts bytes
@query(
    """WITH t AS (SELECT doc_id, lang, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS t FROM documents), p AS (SELECT doc_id, t, lead(t) OVER (PARTITION BY lang ORDER BY doc_id) AS u FROM t)
SELECT doc_id, levenshtein(t, u) AS distance, levenshtein(t, u) AS edits, length(u) - length(t) AS longer FROM p WHERE u IS NOT NULL"""
)
def distances_of_whole_texts(spark, sf_dir):
    """Each whole document to the next of its language: the distance, and the edits of an alignment."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("t"))
    # a language's documents are sorted in stretches of ids; the last of a stretch meets the first of the next one that has any
    own = Window.partitionBy("lang", "stretch").orderBy("doc_id")
    rows = docs.withColumn("stretch", F.floor(F.col("doc_id") / STRETCH)).withColumns({"n": F.row_number().over(own), "next": F.lead(F.struct("t")).over(own)})
    firsts = rows.where("n = 1").select("lang", "stretch", F.struct("t").alias("first"))
    ends = Window.partitionBy("lang").orderBy("stretch")
    stretches = firsts.select("lang", "stretch", F.lag("stretch").over(ends).alias("before"))
    behind = firsts.alias("f").join(stretches.alias("s"), F.col("f.lang").eqNullSafe(F.col("s.lang")) & (F.col("f.stretch") == F.col("s.stretch"))).select(F.col("f.lang").alias("l"), "before", "first")
    joined = rows.join(behind, F.col("next").isNull() & F.col("lang").eqNullSafe(F.col("l")) & (F.col("stretch") == F.col("before")), "left")
    # texts differ much in length: many parts, whose number Spark does not lessen
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    pairs = joined.select("doc_id", "t", F.coalesce("next.t", "first.t").alias("u")).where("u IS NOT NULL").repartition(parts, "doc_id")
    out = pairs.select("doc_id", edit.distance_and_edits(F.col("t"), F.col("u")).alias("e"))
    return out.select("doc_id", "e.distance", (F.col("e.replaced") + F.col("e.added") + F.col("e.removed")).alias("edits"), (F.col("e.added") - F.col("e.removed")).alias("longer"))


@query("SELECT l_orderkey, l_linenumber, l_discount * 10 AS score FROM lineitem WHERE l_discount * 10 <= 1 UNION ALL SELECT l_orderkey, l_linenumber, l_tax FROM lineitem")
def scores_of_nested_documents(spark, sf_dir):
    """Scores in documents as deep as their line number, twice over, by walking variants."""
    deep = F.concat(
        F.repeat(F.lit('{"a": [1, {"score": "0.5", "b": '), F.col("l_linenumber")), F.lit('{"score": '), (F.col("l_discount") * 10).cast("string"), F.lit(', "other": 0.3, "c": [[{"confidence": '), F.col("l_tax").cast("string"), F.lit("}]]}"),
        F.repeat(F.lit("}]}"), F.col("l_linenumber")),
    )
    own = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("line"), deep.alias("json"))
    return jsonx.walked_scores(own, "line", "json").select("id.l_orderkey", "id.l_linenumber", "score")
