"""Inputs of the verb queries: each a DataFrame and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Mixed texts: null, empty, a whole number, letters, a number with a point.
MIXED_SQL = "SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN 'abc' ELSE CAST(p_size AS VARCHAR) || '.5' END AS m, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS x, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS n, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


def mixed(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("string")
    return p.select(
        k.alias("k"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit("")).when(k % 5 == 2, size).when(k % 5 == 3, F.lit("abc")).otherwise(F.concat(size, F.lit(".5"))).alias("m"),
        F.when(k % 7 != 0, F.col("p_retailprice")).alias("x"),
        F.when(k % 3 != 0, F.col("p_size")).alias("n"),
        "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
    )


ORDERS_SQL = "SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)), '%Y-%m-%d') AS d2, CAST(o_orderkey % 23 AS INTEGER) AS n FROM orders"


def orders(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    return o.select(k.alias("k"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", day.cast("string").alias("d"), F.date_add(day, (k % 400).cast("int")).cast("string").alias("d2"), (k % 23).cast("int").alias("n"))


EVENTS_SQL = "SELECT event_id AS k, user_id, event_type, value, props, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS t, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS v FROM events"


def events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("k"), "user_id", "event_type", "value", "props", "ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))


GEO_SQL = "SELECT c_custkey AS k, CAST((c_custkey % 181) - 90 AS DOUBLE) AS lat, CAST((c_custkey % 361) - 180 AS DOUBLE) AS lon, CAST(((c_custkey * 7) % 181) - 90 AS DOUBLE) AS lat2, CAST(((c_custkey * 11) % 361) - 180 AS DOUBLE) AS lon2 FROM customer"


def geo(spark, sf_dir):
    k = F.col("c_custkey")
    place = lambda f, m, h, n: (((k * f) % m) - h).cast("double").alias(n)
    return table(spark, sf_dir, "customer").select(k.alias("k"), place(1, 181, 90, "lat"), place(1, 361, 180, "lon"), place(7, 181, 90, "lat2"), place(11, 361, 180, "lon2"))


PEOPLE_SQL = "SELECT c_custkey AS k, c_name, c_acctbal, c_mktsegment, c_nationkey, c_name || ' ' || c_mktsegment || '_segOne' AS w, '  ' || c_mktsegment || chr(9) || ' ' AS padded, '<b>' || c_name || '</b> & \"x\"' AS h, 'https://' || lower(c_mktsegment) || '.example.com:8080/p/' || c_custkey || '?b=2&a=' || c_custkey || '#f' AS url, CAST(c_custkey % 50 AS DOUBLE) / 10 AS r, 'café' || c_custkey AS acc FROM customer"


def people(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    seg = F.col("c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("k"), "c_name", "c_acctbal", "c_mktsegment", "c_nationkey",
        F.concat("c_name", F.lit(" "), seg, F.lit("_segOne")).alias("w"),
        F.concat(F.lit("  "), seg, F.lit("\t ")).alias("padded"),
        F.concat(F.lit("<b>"), "c_name", F.lit('</b> & "x"')).alias("h"),
        F.concat(F.lit("https://"), F.lower(seg), F.lit(".example.com:8080/p/"), k, F.lit("?b=2&a="), k, F.lit("#f")).alias("url"),
        ((F.col("c_custkey") % 50).cast("double") / 10).alias("r"),
        F.concat(F.lit("café"), k).alias("acc"),
    )


#: One row a customer, with arrays over its orders in order; few enough to be objects of one document.
CUSTOMER_ORDERS_SQL = """SELECT o_custkey AS k, list(CAST(o_orderkey % 1000 AS DOUBLE) ORDER BY o_orderdate, o_orderkey) AS xs, list(o_orderstatus ORDER BY o_orderdate, o_orderkey) AS ss,
 list(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END ORDER BY o_orderdate, o_orderkey) AS gaps,
 list(CAST(o_orderkey % 7 AS DOUBLE) ORDER BY o_orderdate, o_orderkey) AS ws, list(o_orderdate ORDER BY o_orderdate, o_orderkey) AS ds, CAST(o_custkey % 10 AS INTEGER) AS n FROM orders GROUP BY o_custkey"""


def customer_orders(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.array_sort(
            F.collect_list(
                F.struct("o_orderdate", k.alias("key"), (k % 1000).cast("double").alias("x"), F.col("o_orderstatus").alias("s"), F.when(k % 3 != 0, (k % 100).cast("double")).alias("gap"), (k % 7).cast("double").alias("w"))
            )
        ).alias("items")
    )
    return rows.select("k", F.col("items.x").alias("xs"), F.col("items.s").alias("ss"), F.col("items.gap").alias("gaps"), F.col("items.w").alias("ws"), F.col("items.o_orderdate").alias("ds"), "items", (F.col("k") % 10).cast("int").alias("n"))


SOURCES = {
    "mixed": (mixed, MIXED_SQL),
    "orders": (orders, ORDERS_SQL),
    "events": (events, EVENTS_SQL),
    "geo": (geo, GEO_SQL),
    "people": (people, PEOPLE_SQL),
    "lists": (customer_orders, CUSTOMER_ORDERS_SQL),
}
