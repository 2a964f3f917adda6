"""Plans and accumulators over Structured Streaming.

A plan without accumulators is stateless and runs on a streaming DataFrame as it is.
Accumulators that go on over records are aggregations with state in Spark's store;
with an event time they are kept by window and dropped behind the watermark.  Chains
of document versions collapse batch by batch into a table of current states.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.kernel import N, of
from quillspark.operators.documents import overlay
from quillspark.plans.compiler import PlanError, run
from quillspark.plans.ir import Call, Transform


def segments(plan: Transform, stream: DataFrame, key: str) -> dict[str, DataFrame]:
    """The plan's segments over a stream of documents."""
    if any(isinstance(m.value, Call) and m.value.verb in ("accumulate", "set", "sequence") for s in plan.segments for m in s.mappings):
        raise PlanError("a plan with accumulators keeps state: use totals() or windowed_totals() for what goes on over records")
    return run(plan, stream, key).segments


def _totals(df: DataFrame, path: str) -> list:
    x = N(of(df, path))
    return [F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.count(F.lit(1)).alias("count"), F.min(x).alias("min"), F.max(x).alias("max")]


def totals(stream: DataFrame, by: Sequence[str], path: str) -> DataFrame:
    """Running sum, count, least and greatest by key; state grows with the keys (output mode update or complete)."""
    return stream.groupBy(*by).agg(*_totals(stream, path))


def windowed_totals(stream: DataFrame, time: str, size: str, late: str, by: Sequence[str], path: str, slide: str | None = None) -> DataFrame:
    """The same by windows of event time; rows later than ``late`` behind the newest are left out, and closed windows leave the state."""
    known = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return known.groupBy(window, *by).agg(*_totals(known, path)).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "sum", "count", "min", "max")


def latest_states(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: overlays each batch of versions (as :func:`overlay` takes them) on the states so far.

    ``read`` gives the states' path table (None at first) and ``write`` replaces it;
    both must name a store in which a replaced table can still be read meanwhile.  Run
    again after a failure, a batch gives the same states.
    """

    def batch(versions: DataFrame, _: int) -> None:
        old = read()
        chain = versions.withColumn("version", F.col("version").cast("long"))
        if old is not None:
            chain = chain.unionByName(old.withColumn("version", F.lit(-1).cast("long")))
        write(overlay(chain))

    return batch
