"""A sample of registered queries beside their SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracle_check

DATA = "/root/testdata/sf0.001"
NAMES = [n for i, n in enumerate(sorted(q for q in entry.oracle_sql() if not q[:3].strip("op").isdigit())) if i % 9 == 0 or n.startswith(("op_", "val_", "io_", "stream_"))]


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in oracle_check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_query_of_the_core_has_sql():
    core = {n for n in entry.queries() if not n[2:3].isdigit() and n != "pipeline"}
    assert core <= set(entry.oracle_sql()) and len(core) > 350


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    cursor = db.execute(entry.oracle_sql()[name])
    assert oracle_check.rows_of(df.columns, df.collect()) == oracle_check.rows_of([c[0] for c in cursor.description], cursor.fetchall())


def test_format_currency_equals_sql_on_odd_amounts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    amounts = [-0.0, 0.0, -0.001, -0.005, 0.005, 0.125, 0.375, 9.995, 0.9999999999, 467216695912281.2, -1e15 - 0.125, 2.0**53, 1e18, -(2.0**63), 1e21, 5e-324, None, float("nan"), float("inf"), float("-inf")]
    rows = [(k, "x", 1, amount, "S") for k, amount in enumerate(amounts)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    mine = dict(map(tuple, entry.queries()["verb_formatCurrency"](spark, str(tmp_path)).collect()))
    theirs = dict(con.execute(entry.oracle_sql()["verb_formatCurrency"]).fetchall())
    assert theirs[0] == "-0.00" and mine == theirs
