"""Queries of the table operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import relational as R
from quillspark.queries.sources import EVENTS_SQL, ORDERS_SQL, events, orders, table

#: name to (query, SQL)
ENTRIES: dict[str, tuple] = {}


def entry(name: str, sql: str):
    def add(query):
        ENTRIES[name] = (query, sql)
        return query

    return add


EV, OR = f"({EVENTS_SQL})", f"({ORDERS_SQL})"
AT = ["ts", "k"]
L_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
r6 = lambda *names: [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


@entry("table_where", "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def t_where(spark, d):
    return R.where(table(spark, d, "orders"), "o_totalprice", ">", 300000).select("o_orderkey", "o_totalprice")


@entry(
    "table_summary",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum, count(l_quantity) AS count, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS avg, round(var_pop(l_quantity), 4) AS variance, round(var_samp(l_quantity), 4) AS varianceSample, round(stddev_pop(l_quantity), 4) AS std, round(stddev_samp(l_quantity), 4) AS stdSample, median(l_quantity) AS median FROM lineitem GROUP BY 1, 2",
)
def t_summary(spark, d):
    names = ["sum", "count", "min", "max", "avg", "variance", "varianceSample", "std", "stdSample", "median"]
    out = R.summary(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", names)
    return out.select("l_returnflag", "l_linestatus", *(F.round(n, 6 if n == "avg" else 4).alias(n) if n not in ("count", "min", "max", "median") else F.col(n) for n in names))


@entry("table_conditional", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 30) AS countIf, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_quantity > 30), 0), 2) AS sumIf, round(avg(l_extendedprice) FILTER (WHERE l_quantity > 30), 4) AS avgIf FROM lineitem GROUP BY 1")
def t_conditional(spark, d):
    out = R.conditional(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", ">", 30, "l_extendedprice")
    return out.select("l_returnflag", "countIf", F.round("sumIf", 2).alias("sumIf"), F.round("avgIf", 4).alias("avgIf"))


@entry("table_percentile", "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 4) AS percentile FROM orders GROUP BY 1")
def t_percentile(spark, d):
    return R.percentile(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", 0.9).select("o_orderstatus", F.round("percentile", 4).alias("percentile"))


@entry(
    "table_mode",
    "SELECT l_returnflag, mode FROM (SELECT l_returnflag, l_quantity AS mode, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, min((l_orderkey, l_linenumber, l_partkey, l_suppkey))) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1",
)
def t_mode(spark, d):
    return R.mode(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", L_ORDER)


@entry("table_pairs", "SELECT l_returnflag, round(covar_pop(l_quantity, l_discount), 6) AS covariance, round(corr(l_quantity, l_discount), 6) AS correlation, round(sum(l_quantity * l_discount) / sum(l_discount), 6) AS weightedAvg FROM lineitem GROUP BY 1")
def t_pairs(spark, d):
    return R.pair_statistics(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount").select("l_returnflag", *r6("covariance", "correlation", "weightedAvg"))


@entry("table_first_last", "SELECT user_id, arg_min(event_type, (ts, event_id)) AS first, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1")
def t_first_last(spark, d):
    return R.first_last(table(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@entry("table_countBy", "SELECT event_type AS key, count(*) AS count FROM events GROUP BY 1")
def t_count_by(spark, d):
    return R.count_by(table(spark, d, "events"), "event_type")


@entry("table_groupBy", "SELECT CAST(o_custkey AS VARCHAR) AS key, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1")
def t_group_by(spark, d):
    out = R.group_by(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    return out.select("key", F.size("items").cast("bigint").alias("n"), F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys"))


@entry("table_keyBy", "SELECT CAST(o_custkey AS VARCHAR) AS key, CAST(arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS BIGINT) AS o_orderkey FROM orders GROUP BY 1")
def t_key_by(spark, d):
    return R.key_by(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey"])


@entry("table_distinct", "SELECT DISTINCT o_orderpriority FROM orders")
def t_distinct(spark, d):
    return R.distinct(table(spark, d, "orders"), "o_orderpriority", ["o_orderkey"])


@entry("table_dedupe", "SELECT CAST(event_id AS BIGINT) AS event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def t_dedupe(spark, d):
    return R.dedupe(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id")


@entry("table_find", "SELECT user_id, CAST(arg_min(event_id, (ts, event_id)) AS BIGINT) AS event_id FROM events WHERE value > 50 GROUP BY 1")
def t_find(spark, d):
    return R.find(table(spark, d, "events"), ["user_id"], "value", ">", 50, ["ts", "event_id"], ["event_id"])


@entry("table_every_some", "SELECT user_id, bool_and(value > 1) AS every, bool_or(value > 90) AS some FROM events GROUP BY 1")
def t_every_some(spark, d):
    return R.every_some(table(spark, d, "events").withColumn("value", F.col("value")), ["user_id"], "value", ">", 1).drop("some").join(
        R.every_some(table(spark, d, "events"), ["user_id"], "value", ">", 90).drop("every"), "user_id"
    )


@entry("table_take", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def t_take(spark, d):
    p = table(spark, d, "part")
    return R.take(p, 20, R.sort(p, "p_retailprice", ["p_partkey"], True)).select("p_partkey", "p_retailprice")


@entry("table_drop", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey FROM part ORDER BY p_partkey OFFSET 1900")
def t_drop(spark, d):
    return R.drop(table(spark, d, "part"), 1900, ["p_partkey"]).select("p_partkey")


@entry("table_partition", "SELECT o_totalprice > 100000 AS passes, count(*) AS n FROM orders GROUP BY 1")
def t_partition(spark, d):
    return R.partition(table(spark, d, "orders"), "o_totalprice", ">", 100000).groupBy("passes").agg(F.count(F.lit(1)).alias("n"))


@entry("table_includes", "SELECT CAST(c_custkey AS BIGINT) AS c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def t_includes(spark, d):
    return R.includes(table(spark, d, "customer"), "c_custkey", R.where(table(spark, d, "orders"), "o_totalprice", ">", 200000), "o_custkey").select("c_custkey")


def _nations(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 9000"), table(spark, d, "supplier").where("s_acctbal > 5000")


_A, _B = "SELECT c_nationkey AS value FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS value FROM supplier WHERE s_acctbal > 5000"


@entry("table_union", f"{_A} UNION {_B}")
def t_union(spark, d):
    return R.union(*_nations(spark, d), "c_nationkey", "s_nationkey")


@entry("table_intersection", f"{_A} INTERSECT {_B}")
def t_intersection(spark, d):
    return R.intersection(*_nations(spark, d), "c_nationkey", "s_nationkey")


@entry("table_difference", f"{_A} EXCEPT {_B}")
def t_difference(spark, d):
    return R.difference(*_nations(spark, d), "c_nationkey", "s_nationkey")


@entry("table_symmetricDifference", f"({_A} EXCEPT {_B}) UNION ({_B} EXCEPT {_A})")
def t_symmetric(spark, d):
    return R.symmetric_difference(*_nations(spark, d), "c_nationkey", "s_nationkey")


@entry("table_rowNumber", f"SELECT k, row_number() OVER (PARTITION BY user_id ORDER BY ts, k) AS _rowNum FROM {EV}")
def t_row_number(spark, d):
    return R.row_number(events(spark, d), ["user_id"], AT).select("k", "_rowNum")


@entry("table_rank", f"SELECT k, rank() OVER (PARTITION BY event_type ORDER BY v DESC NULLS FIRST) AS _rank FROM {EV}")
def t_rank(spark, d):
    return R.rank(events(spark, d), ["event_type"], "v").select("k", "_rank")


@entry("table_lag_lead", f"SELECT k, lag(value, 2) OVER w AS before, lead(value, 1, 0.0) OVER w AS after FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ts, k)")
def t_lag_lead(spark, d):
    out = R.shifted(events(spark, d), ["user_id"], "value", AT, 2, "before")
    return R.shifted(out, ["user_id"], "value", AT, -1, "after", 0.0).select("k", "before", "after")


@entry("table_changes", f"SELECT k, round(value - lag(value) OVER w, 6) AS diff, round(CASE WHEN lag(value) OVER w <> 0 THEN (value - lag(value) OVER w) / lag(value) OVER w END, 6) AS pctChange FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ts, k)")
def t_changes(spark, d):
    return R.changes(events(spark, d), ["user_id"], "value", AT).select("k", *r6("diff", "pctChange"))


@entry("table_running", f"SELECT k, round(CASE WHEN v IS NOT NULL THEN sum(v) OVER w END, 4) AS cumsum FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ts, k ROWS UNBOUNDED PRECEDING)")
def t_running(spark, d):
    return R.running(events(spark, d), ["user_id"], "v", AT).select("k", F.round("cumsum", 4).alias("cumsum"))


@entry("table_movingAvg", f"SELECT k, round(avg(coalesce(v, 0)) OVER (PARTITION BY user_id ORDER BY ts, k ROWS 2 PRECEDING), 6) AS movingAvg FROM {EV}")
def t_moving(spark, d):
    return R.moving_avg(events(spark, d), ["user_id"], "v", AT, 3).select("k", *r6("movingAvg"))


@entry("table_fillMissing", f"SELECT k, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, k ROWS UNBOUNDED PRECEDING), -1.0) AS filled FROM {EV}")
def t_fill(spark, d):
    return R.fill_missing(events(spark, d), ["user_id"], "v", AT, -1.0, "forward").select("k", "filled")


@entry("table_zscore", f"SELECT k, round((value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type), 4) AS zscore FROM {EV}")
def t_zscore(spark, d):
    return R.zscore(events(spark, d), ["event_type"], "value").select("k", F.round("zscore", 4).alias("zscore"))


@entry("table_chunk", f"SELECT k, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts, k) - 1) / 3) AS BIGINT) AS chunk FROM {EV}")
def t_chunk(spark, d):
    return R.chunk(events(spark, d), ["user_id"], AT, 3).select("k", "chunk")


@entry("table_window", f"SELECT k, round(s, 4) AS s FROM (SELECT k, sum(value) OVER w AS s, count(*) OVER w AS c FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ts, k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE c = 3")
def t_window(spark, d):
    return R.sliding(events(spark, d), ["user_id"], "value", AT, 3).select("k", F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


@entry("table_accumulate", f"SELECT k, round(100 + sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, k ROWS UNBOUNDED PRECEDING), 2) AS accumulated FROM {OR}")
def t_accumulate(spark, d):
    return R.accumulate(orders(spark, d), ["o_custkey"], "o_totalprice", ["o_orderdate", "k"], "sum", 100).select("k", F.round("accumulated", 2).alias("accumulated"))


@entry("table_numbered", f"SELECT k, row_number() OVER (ORDER BY ts, k) AS _n FROM {EV}")
def t_numbered(spark, d):
    return R.numbered(events(spark, d), AT).select("k", "_n")


@entry("table_pivot", "SELECT o_orderstatus, max(CASE WHEN o_orderpriority = '1-URGENT' THEN k END) AS urgent, max(CASE WHEN o_orderpriority = '2-HIGH' THEN k END) AS high FROM " + OR + " GROUP BY 1")
def t_pivot(spark, d):
    return R.pivot(orders(spark, d), ["o_orderstatus"], "o_orderpriority", "k", ["k"], ["1-URGENT", "2-HIGH"]).select("o_orderstatus", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"))


@entry("table_unpivot", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, 'p_brand' AS key, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part")
def t_unpivot(spark, d):
    return R.unpivot(table(spark, d, "part"), ["p_partkey"], ["p_brand", "p_type"])


@entry("table_explode", "SELECT vec_id, round(sum(x), 4) AS s, count(*) AS n FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1")
def t_explode(spark, d):
    out = R.explode(table(spark, d, "embeddings"), "embedding")
    return out.groupBy("vec_id").agg(F.round(F.sum(F.col("embedding").cast("double")), 4).alias("s"), F.count(F.lit(1)).alias("n"))


@entry("table_zip", "SELECT n_name, r_name FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) USING (i)")
def t_zip(spark, d):
    return R.zip_rows(table(spark, d, "nation"), table(spark, d, "region"), ["n_nationkey"], ["r_regionkey"]).select("n_name", "r_name")


@entry("table_lookup", "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, coalesce(n_name, 'none') AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3")
def t_lookup(spark, d):
    return R.lookup(table(spark, d, "supplier"), table(spark, d, "nation").where("n_regionkey < 3"), {"s_nationkey": "n_nationkey"}, "n_name", "nation", ["n_nationkey"], "none").select("s_suppkey", "nation")


@entry("table_compact", "SELECT count(*) AS n FROM " + EV + " WHERE v IS NOT NULL")
def t_compact(spark, d):
    return R.compact(events(spark, d), "v").agg(F.count(F.lit(1)).alias("n"))


def queries():
    return {name: q for name, (q, _) in ENTRIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ENTRIES.items()}
