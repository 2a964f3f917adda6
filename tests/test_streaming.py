"""Streams against the same rows in one batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.plans import parse_transform, run
from quillspark.plans.compiler import PlanError
from quillspark.streaming import transforms as S

DATA = "/root/testdata/sf0.001"


@pytest.fixture()
def files(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def collected(spark, df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    q.processAllAvailable()
    q.stop()
    return sorted(tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect())


def test_plan_and_totals(spark, files, tmp_path):
    schema = spark.read.parquet(files).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(files)
    plan = parse_transform("{$}\nv = \"1\"\n{out}\n_if = \"@value > 50\"\nkind = %upper @event_type\n")
    still = spark.read.parquet(files)
    assert collected(spark, S.segments(plan, stream, "event_id")["out"], "append", "mapped", tmp_path) == sorted(tuple(r) for r in run(plan, still, "event_id").segments["out"].collect())
    got = collected(spark, S.totals(stream, ["event_type"], "event_id"), "complete", "summed", tmp_path)
    assert got == sorted(tuple(r) for r in S.totals(still, ["event_type"], "event_id").collect())
    with pytest.raises(PlanError):
        S.segments(parse_transform("{o}\nx = %accumulate n ##1\n"), stream, "event_id")


def test_windows_close_behind_the_watermark(spark, files, tmp_path):
    schema = spark.read.parquet(files).schema
    stream = spark.readStream.schema(schema).parquet(files)
    got = collected(spark, S.windowed_totals(stream, "ts", "1 day", "1 hour", ["event_type"], "event_id"), "append", "windows", tmp_path)
    still = S.windowed_totals(spark.read.parquet(files), "ts", "1 day", "1 hour", ["event_type"], "event_id").collect()
    last = max(r["end"] for r in still)
    assert got and set(got) <= {tuple(r) for r in still} and all(r[1] <= last for r in got)


def test_states(spark, tmp_path):
    kept = {}
    schema = "doc_id int, version int, ord long, path string, type string, value string, mods string"
    batch = S.latest_states(lambda: kept.get("t"), lambda df: kept.update(t=spark.createDataFrame(df.collect(), df.schema)))
    batch(spark.createDataFrame([(1, 1, 0, "a", "string", "x", ""), (1, 1, 1, "b", "string", "y", "")], schema), 0)
    second = spark.createDataFrame([(1, 2, 0, "a", "null", None, ""), (1, 2, 1, "c", "string", "z", "")], schema)
    for _ in range(2):
        batch(second, 1)
        assert {(r.path, r.value) for r in kept["t"].collect()} == {("b", "y"), ("c", "z")}
    assert kept["t"].where(F.col("doc_id") != 1).count() == 0
