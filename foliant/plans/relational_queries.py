"""Relational queries in Spark's own algebra: what a user of the library has beside its operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .base import query, table


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 9) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL"""
)
def pricing_summary(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return own.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) + grouping(l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rolled_up(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), (F.grouping("l_returnflag") + F.grouping("l_linestatus")).alias("level"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cubed(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    own = line.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return own.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT e.event_id, (SELECT max(o.ts) FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'purchase' AND o.ts < e.ts) AS before FROM events e")
def as_of_purchase(spark, sf_dir):
    """The last purchase before each event, by a window over the user's events instead of a range join."""
    own = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    return own.select("event_id", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w).alias("before"))


@query("SELECT c_custkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS rank FROM customer WINDOW w AS (ORDER BY c_acctbal, c_custkey)")
def balance_ranks(spark, sf_dir):
    w = Window.orderBy("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("rank"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_nations(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id")
def events_pivoted(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count("event_id"))
    return own.na.fill(0, ["click", "view", "purchase"])
