"""The relational baseline over the star schema, and windows over the event log: an extension, for measure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.plans.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query
D = "decimal(18,4)"


def _money(sql: str) -> str:
    return f"CAST(sum(CAST({sql} AS DECIMAL(18,4))) AS DOUBLE)"


@query(f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, {_money('l_extendedprice * (1 - l_discount)')} AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(D)).cast("double").alias("revenue"), F.count("*").alias("n"))


@query(f"""SELECT r_name, n_name, {_money('l_extendedprice * (1 - l_discount)')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(D)).cast("double").alias("revenue"))


@query(f"SELECT c_mktsegment, o_orderpriority, grouping(c_mktsegment) + 2 * grouping(o_orderpriority) AS level, count(*) AS orders, {_money('o_totalprice')} AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)")
def order_cube(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    level = (F.grouping("c_mktsegment") + 2 * F.grouping("o_orderpriority")).cast("bigint")
    return j.cube("c_mktsegment", "o_orderpriority").agg(level.alias("level"), F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast(D)).cast("double").alias("total"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.rank().over(w).alias("rank")).where("rank <= 3")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def customers_without_large_orders(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").distinct().join(big, "c_custkey", "left_anti")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("SELECT user_id, event_id, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS recent, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def recent_events(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.sum(F.col("value").cast(D)).over(w.rowsBetween(-2, 0)).cast("double").alias("recent"), F.lag("event_type").over(w).alias("before"))


@query("SELECT json_extract_string(props, '$.' || k) IS NOT NULL AS present, k, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
def event_properties(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("props", F.explode(F.json_object_keys("props")).alias("k"))
    return e.groupBy(F.lit(True).alias("present"), "k").agg(F.count("*").alias("n"))
