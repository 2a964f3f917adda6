"""Queries of the document and validation operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import documents as D
from quillspark.operators import validation as V
from quillspark.plans.schema import definition_problems, parse_schema
from quillspark.queries.sources import table
from quillspark.session import prepare

ENTRIES: dict[str, tuple] = {}


def entry(name: str, sql: str | None):
    def add(query):
        ENTRIES[name] = (query, sql)
        return query

    return add


def v1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return D.from_table(o, "o_orderkey")


def v2(spark, d):
    """The same with changes by the key: a status changed, a customer gone, a note added, a priority renamed."""
    k = F.col("doc_id")
    p = v1(spark, d)
    p = p.where(~((k % 7 == 0) & (F.col("path") == "o_custkey")))
    p = p.withColumn("value", F.when((k % 5 == 0) & (F.col("path") == "o_orderstatus"), F.lit("X")).otherwise(F.col("value")))
    p = p.withColumn("path", F.when((k % 11 == 0) & (F.col("path") == "o_orderpriority"), F.lit("priority")).otherwise(F.col("path")))
    notes = p.where("path = 'o_orderstatus' and doc_id % 3 = 0").select("doc_id", F.lit(9).cast("bigint").alias("ord"), F.lit("note").alias("path"), F.lit("string").alias("type"), F.lit("new").alias("value"), "mods")
    return p.unionByName(notes)


_V1 = """SELECT o_orderkey AS doc_id, 'o_custkey' AS path, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders"""
_V2 = f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 AND path = 'o_orderpriority' THEN 'priority' ELSE path END AS path, CASE WHEN doc_id % 5 = 0 AND path = 'o_orderstatus' THEN 'X' ELSE value END AS value
 FROM ({_V1}) WHERE NOT (doc_id % 7 = 0 AND path = 'o_custkey') UNION ALL SELECT o_orderkey, 'note', 'new' FROM orders WHERE o_orderkey % 3 = 0"""


@entry("doc_paths", f"SELECT doc_id, path, value FROM ({_V1})")
def doc_paths(spark, d):
    return v1(spark, d).select("doc_id", "path", "value")


@entry(
    "doc_diff",
    f"""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.path IS NULL THEN 'add' WHEN b.path IS NULL THEN 'delete' ELSE 'modify' END AS op, coalesce(a.path, b.path) AS path, a.value AS old_value, b.value AS new_value
 FROM (SELECT * FROM ({_V1}) WHERE NOT (doc_id % 11 = 0 AND path = 'o_orderpriority')) a FULL JOIN (SELECT * FROM ({_V2}) WHERE path <> 'priority') b ON a.doc_id = b.doc_id AND a.path = b.path
 WHERE a.value IS DISTINCT FROM b.value UNION ALL SELECT o_orderkey, 'move', 'o_orderpriority', o_orderpriority, o_orderpriority FROM orders WHERE o_orderkey % 11 = 0""",
)
def doc_diff(spark, d):
    return D.diff(v1(spark, d), v2(spark, d)).select("doc_id", "op", "path", "old_value", "new_value")


@entry("doc_patch", f"SELECT doc_id, path, value FROM ({_V2})")
def doc_patch(spark, d):
    a, b = v1(spark, d), v2(spark, d)
    return D.patch(a, D.diff(a, b))[0].select("doc_id", "path", "value")


@entry("doc_roundtrip", "SELECT CAST(0 AS BIGINT) AS differences")
def doc_roundtrip(spark, d):
    a, b = v1(spark, d), v2(spark, d)
    return D.diff(D.patch(a, D.diff(a, b))[0].withColumn("ord", F.lit(0).cast("bigint")), b.withColumn("ord", F.lit(0).cast("bigint"))).agg(F.count(F.lit(1)).alias("differences"))


@entry(
    "doc_overlay",
    f"""SELECT doc_id, path, value FROM (SELECT a.doc_id, a.path, coalesce(b.value, a.value) AS value FROM ({_V1}) a LEFT JOIN ({_V2}) b ON a.doc_id = b.doc_id AND a.path = b.path UNION ALL SELECT doc_id, path, value FROM ({_V2}) WHERE path IN ('note', 'priority'))
 WHERE NOT (doc_id % 13 = 0 AND path = 'o_orderstatus')""",
)
def doc_overlay(spark, d):
    stones = v1(spark, d).where("doc_id % 13 = 0 and path = 'o_orderstatus'").withColumn("type", F.lit("null")).withColumn("value", F.lit(None).cast("string"))
    chain = v1(spark, d).withColumn("version", F.lit(1)).unionByName(v2(spark, d).withColumn("version", F.lit(2))).unionByName(stones.withColumn("version", F.lit(3)))
    return D.overlay(chain).select("doc_id", "path", "value")


@entry(
    "doc_canonical",
    "SELECT o_orderkey AS doc_id, sha256('o_custkey = ##' || o_custkey || chr(10) || 'o_orderpriority = \"' || o_orderpriority || '\"' || chr(10) || 'o_orderstatus = \"' || o_orderstatus || '\"' || chr(10)) AS sha256 FROM orders",
)
def doc_canonical(spark, d):
    return D.canonical(v1(spark, d)).select("doc_id", "sha256")


@entry("doc_to_table", "SELECT o_orderkey AS doc_id, o_custkey, o_orderstatus FROM orders")
def doc_to_table(spark, d):
    return D.to_table(v1(spark, d), {"o_custkey": "bigint", "o_orderstatus": "string"})


def _refs(spark, d):
    """An order's path ``next`` refers to another path of its document, or to none."""
    p = v1(spark, d)
    ref = p.where("path = 'o_custkey'").withColumns({"path": F.lit("next"), "type": F.lit("reference"), "value": F.when(F.col("doc_id") % 4 == 0, F.lit("gone")).when(F.col("doc_id") % 4 == 1, F.lit("next")).otherwise(F.lit("o_custkey"))})
    return p.unionByName(ref)


@entry("val_V013_dangling", "SELECT o_orderkey AS doc_id, 'next' AS path, 'gone' AS target FROM orders WHERE o_orderkey % 4 = 0")
def v013(spark, d):
    return D.dangling(_refs(spark, d))


@entry("val_V012_cycles", "SELECT o_orderkey AS doc_id, 'next' AS path FROM orders WHERE o_orderkey % 4 = 1")
def v012(spark, d):
    return D.cycles(_refs(spark, d))


def _customers(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    return c.select(k, F.when(k % 10 != 0, F.col("c_name")).alias("name"), "c_acctbal", "c_mktsegment", F.when(k % 4 == 0, F.lit("x@y")).otherwise(F.concat(F.lit("a"), k.cast("string"), F.lit("@b.com"))).alias("email"), "c_nationkey")


SCHEMA = V.Schema(
    [
        V.Field("name", "string", required=True, least=5, pattern="^Customer"),
        V.Field("c_acctbal", "number", least=0, most=9000),
        V.Field("c_mktsegment", "string", enum=["BUILDING", "AUTOMOBILE", "MACHINERY"]),
        V.Field("email", "string", format="email"),
        V.Field("c_nationkey", "string"),
    ],
    invariants=["c_acctbal * 2 > c_nationkey - 100"],
    cardinalities=[(["name", "email"], 2, 2)],
)


@entry(
    "val_rules",
    """SELECT code, count(*) AS n FROM (
 SELECT 'V001' AS code FROM customer WHERE c_custkey % 10 = 0
 UNION ALL SELECT 'V003' FROM customer WHERE c_acctbal < 0 OR c_acctbal > 9000
 UNION ALL SELECT 'V004' FROM customer WHERE c_custkey % 4 = 0
 UNION ALL SELECT 'V005' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')
 UNION ALL SELECT 'V002' FROM customer
 UNION ALL SELECT 'V008' FROM customer WHERE NOT (c_acctbal * 2 > c_nationkey - 100)
 UNION ALL SELECT 'V009' FROM customer WHERE c_custkey % 10 = 0) GROUP BY 1""",
)
def val_rules(spark, d):
    return V.validate(_customers(spark, d), "c_custkey", SCHEMA).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@entry("val_V010_conditional", "SELECT c_custkey AS key, 'V010' AS code FROM customer WHERE c_custkey % 10 = 0 AND c_mktsegment = 'BUILDING'")
def v010(spark, d):
    schema = V.Schema([V.Field("name", "string", required_if=[("c_mktsegment", "=", "BUILDING")])])
    return V.validate(_customers(spark, d), "c_custkey", schema).select("key", "code")


@entry("val_V007_unique", "SELECT event_id AS key, 'V007' AS code FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r > 1")
def v007(spark, d):
    return V.unique(table(spark, d, "events"), "event_id", ["user_id", "event_type"]).select("key", "code")


@entry("val_V006_size", "SELECT vec_id AS key, 'V006' AS code FROM embeddings WHERE len(embedding) < 100")
def v006(spark, d):
    return V.array_size(table(spark, d, "embeddings"), "vec_id", "embedding", 100, None).select("key", "code")


@entry("val_V013_table", "SELECT s_suppkey AS key FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)")
def v013_table(spark, d):
    return V.references(table(spark, d, "supplier"), "s_suppkey", "s_nationkey", table(spark, d, "nation").where("n_regionkey < 2"), "n_nationkey").select("key")


@entry("val_V007_items", "SELECT k AS key, 'orders[' || (p - 1) || ']' AS path FROM (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderdate, o_orderkey) AS again FROM orders) WHERE again > 1")
def val_items(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("orders"))
    return V.array_unique(rows, "k", "orders", ["o_orderstatus", "o_orderpriority"]).select("key", "path")


@entry("val_V007_field", "SELECT s_suppkey AS key, 'V007' AS code FROM (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) WHERE r > 1")
def val_unique_field(spark, d):
    rules = parse_schema("{supplier}\ns_suppkey = !##\ns_nationkey = ## :unique\n").rules("supplier")
    return V.validate(table(spark, d, "supplier"), "s_suppkey", rules).select("key", "code")


@entry("val_V011_unknown", "SELECT p_partkey AS key, 'p_brand' AS path, 'V011' AS code, p_brand AS actual FROM part UNION ALL SELECT p_partkey, 'extra', 'V011', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 25")
def val_unknown(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") > 25, F.col("p_size")).alias("extra"))
    return V.unknown_values(p, "p_partkey", V.Schema([V.Field("p_name")])).select("key", "path", "code", "actual")


@entry("val_V011_paths", "SELECT p_partkey AS key, 'p_size' AS path FROM part")
def val_unknown_paths(spark, d):
    paths = D.from_table(table(spark, d, "part").select("p_partkey", "p_name", "p_size", F.array("p_brand").alias("tags")), "p_partkey")
    return V.unknown_paths(paths, V.Schema([V.Field("p_name")]), ["tags"]).select("key", "path")


@entry("val_W001_deprecated", "SELECT o_orderkey AS key, 'W001' AS code, o_orderstatus AS actual FROM orders WHERE o_orderkey % 3 <> 0")
def val_deprecated(spark, d):
    o = table(spark, d, "orders").withColumn("s", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")))
    return V.validate(o, "o_orderkey", parse_schema("{o}\ns = -\n").rules("o")).select("key", "code", "actual")


_BAD = """{@base}
a = !## :(1..9)
b = !
{@other}
a = !## :(1..8)
{@wide}
= @base :override
a = !## :(0..9)
b =
{@both}
= @base & @other
{rows[] : x.y.z, ref}
ref = @base
"""


@entry("val_V017_definition", "SELECT * FROM (VALUES ('@wide.a', 'bounds become wider'), ('@wide.b', 'a required field becomes optional'), ('@both.a', 'it differs between the types joined, base and other'), ('rows[].x.y.z', 'a column has one level'), ('rows[].ref', 'a column is of a simple type')) AS t(path, message)")
def val_definition(spark, d):
    """Of a schema's text, so no table is read."""
    return prepare(spark).createDataFrame(definition_problems(parse_schema(_BAD)), "path string, message string")


def queries():
    return {name: q for name, (q, _) in ENTRIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ENTRIES.items() if sql}
