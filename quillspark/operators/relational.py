"""Collection operators over tables, whose rows are the items.

Order is never taken from where rows happen to lie: operators that depend on it
name its columns.  Aggregations are left to partial and final steps, windows are
partitioned, and what must number a whole table does so in two passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.arrays import order_key, value_key
from quillspark.functions.kernel import N, S, Value, Z, lit, of, predicate, truth
from quillspark.session import checkpointed

Names = Sequence[str]


def _test(df: DataFrame, path: str, op: str, than) -> Column:
    return predicate(of(df, path), op, than if isinstance(than, Value) else lit(than))


def where(df: DataFrame, path: str, op: str | None = None, than=None) -> DataFrame:
    """Rows whose field passes; without an operator, rows whose field is truthy."""
    return df.where(truth(of(df, path)) if op is None else _test(df, path, op, than))


def key_text(df: DataFrame, path: str) -> Column:
    """The text by which groups are told apart: 1 and "1" are one key, null is empty."""
    v = of(df, path)
    if v.is_array or v.is_object:
        raise TypeError(f"'{path}' is no key: objects and arrays all read alike as text")
    return S(v)


# Aggregates -------------------------------------------------------------------


def aggregates(df: DataFrame, path: str) -> dict[str, Column]:
    """The aggregating verbs of a field, by name, as columns for ``agg``."""
    v = of(df, path)
    x = N(v)
    pop, n = F.stddev_pop(x), F.count(x)
    return {
        "sum": F.coalesce(F.sum(x), F.lit(0.0)),
        "count": F.count(v.col),
        "min": F.min(x),
        "max": F.max(x),
        "avg": F.avg(x),
        "variance": F.var_pop(x),
        "varianceSample": F.when(n > 1, F.var_samp(x)),
        "std": pop,
        "stdSample": F.when(n > 1, F.stddev_samp(x)),
    }


def beside(df: DataFrame, more: DataFrame, by: Names, how: str = "inner") -> DataFrame:
    """The rows with the columns that ``more`` has for their group; null is a group, too."""
    if not by:
        return df.crossJoin(F.broadcast(more))  # one row
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    other = more.withColumnsRenamed(names)
    same = None
    for c, n in names.items():
        test = F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{n}"))
        same = test if same is None else same & test
    return df.alias("_l").join(other.alias("_r"), same, how).drop(*names.values())


def summary(df: DataFrame, by: Names, path: str, names: Names) -> DataFrame:
    """Named aggregates of a field, by group (over the whole table without ``by``); ``median`` is one of them."""
    known = aggregates(df, path)
    out = df.groupBy(*by).agg(*(known[n].alias(n) for n in names if n != "median"), *([] if set(names) - {"median"} else [F.count(F.lit(1)).alias("_n")]))
    if "median" in names:
        out = beside(out, percentile(df, by, path, 0.5).withColumnRenamed("percentile", "median"), by, "left")
    return out.select(*by, *names)


def conditional(df: DataFrame, by: Names, path: str, op: str, than, of_path: str | None = None) -> DataFrame:
    """``countIf``, ``sumIf`` and ``avgIf`` by group."""
    test, x = _test(df, path, op, than), Z(of(df, of_path or path))
    return df.groupBy(*by).agg(F.count_if(test).alias("countIf"), F.coalesce(F.sum(F.when(test, x)), F.lit(0.0)).alias("sumIf"), F.avg(F.when(test, x)).alias("avgIf"))


def percentile(df: DataFrame, by: Names, path: str, share: float) -> DataFrame:
    """The value at a share (0 to 1) of the sorted field, between neighbours in proportion.

    Rows are placed by ranges (:func:`placed`), so that no group's values meet in one task;
    what is aggregated then are the two neighbours.
    """
    rows = df.select(*by, N(of(df, path)).alias("_x"))
    at = placed(rows.where("_x is not null"), by, [F.col("_x")], F.row_number())
    sizes = rows.groupBy(*by).agg(F.count("_x").alias("_size"))
    point = F.lit(float(share)) * (F.col("_size") - 1)
    near = beside(at, sizes, by).withColumns({"_lo": F.floor(point) + 1, "_hi": F.ceil(point) + 1}).where("_place = _lo or _place = _hi")
    found = near.groupBy(*by).agg(F.max(F.when(F.col("_place") == F.col("_lo"), F.col("_x"))).alias("_a"), F.max(F.when(F.col("_place") == F.col("_hi"), F.col("_x"))).alias("_b"), F.max(point - F.floor(point)).alias("_part"))
    out = beside(sizes, found, by, "left") if by else sizes.crossJoin(found)
    return out.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_part")).alias("percentile"))


def mode(df: DataFrame, by: Names, path: str, order: Names) -> DataFrame:
    """The most frequent value by group, of several the one that comes first."""
    counts = df.groupBy(*by, N(of(df, path)).alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    return counts.where("_x is not null").groupBy(*by).agg(F.min_by("_x", F.struct((-F.col("_n")).alias("n"), "_first")).alias("mode"))


def pair_statistics(df: DataFrame, by: Names, x: str, y: str) -> DataFrame:
    """Covariance (population), correlation and weighted mean of x by y, over complete pairs."""
    a, b = N(of(df, x)), N(of(df, y))
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    flat = (F.stddev_pop(a) == 0) | (F.stddev_pop(b) == 0)
    return df.groupBy(*by).agg(F.covar_pop(a, b).alias("covariance"), F.when(~flat, F.corr(a, b)).alias("correlation"), F.try_divide(F.sum(a * b), F.sum(b)).alias("weightedAvg"))


def first_last(df: DataFrame, by: Names, path: str, order: Names) -> DataFrame:
    """The field of each group's first and last row."""
    at = F.struct(*order)
    return df.groupBy(*by).agg(F.min_by(path, at).alias("first"), F.max_by(path, at).alias("last"))


def count_by(df: DataFrame, path: str) -> DataFrame:
    return df.groupBy(key_text(df, path).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def group_by(df: DataFrame, path: str, order: Names, columns: Names) -> DataFrame:
    """Keys with their rows in order; ``first`` orders groups as they first come.

    A group's rows become one value: for keys whose groups are small.  Aggregates
    of groups of any size are :func:`summary`'s.
    """
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("x")))), lambda e: e["x"])
    return df.groupBy(key_text(df, path).alias("key")).agg(items.alias("items"), F.min(F.struct(*order)).alias("first"))


def key_by(df: DataFrame, path: str, order: Names, columns: Names) -> DataFrame:
    """Each key's last row."""
    out = df.groupBy(key_text(df, path).alias("key")).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("x"))
    return out.where(~F.lower("key").isin("__proto__", "constructor", "prototype")).select("key", "x.*")


# Choosing rows ----------------------------------------------------------------


def distinct(df: DataFrame, path: str, order: Names) -> DataFrame:
    """Each key text once, with the first row's value."""
    return df.groupBy(key_text(df, path).alias("_key")).agg(F.min_by(path, F.struct(*order)).alias(path.replace(".", "_"))).drop("_key")


def dedupe(df: DataFrame, path: str, order: Names) -> DataFrame:
    """The first row of each key; rows without a key all stay.

    The first place of each key is aggregated and joined back, so that a frequent
    key's rows are never gathered; ``order`` must tell rows apart.
    """
    v = of(df, path)
    keyed = df.withColumn("_key", S(v)).withColumn("_at", F.struct(*order))
    firsts = keyed.where(v.col.isNotNull()).groupBy("_key").agg(F.min("_at").alias("_at"))
    kept = keyed.where(v.col.isNotNull()).join(firsts, ["_key", "_at"], "left_semi")
    return kept.unionByName(keyed.where(v.col.isNull())).select(*df.columns)


def find(df: DataFrame, by: Names, path: str, op: str, than, order: Names, columns: Names) -> DataFrame:
    """Each group's first row that passes."""
    out = where(df, path, op, than).groupBy(*by).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_x"))
    return out.select(*by, "_x.*")


def every_some(df: DataFrame, by: Names, path: str, op: str, than) -> DataFrame:
    test = _test(df, path, op, than)
    return df.groupBy(*by).agg(F.bool_and(test).alias("every"), F.bool_or(test).alias("some"))


def sort(df: DataFrame, path: str, order: Names, descending: bool = False) -> list[Column]:
    """Columns to order by as ``sort`` does: nulls last going up, first going down, then the given order."""
    v = of(df, path)
    key = v.col if v.is_number or v.is_temporal or v.is_bool else order_key(v)
    return [key.desc_nulls_first() if descending else key.asc_nulls_last(), *map(F.col, order)]


def take(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """The first rows in an order (columns or sort columns)."""
    return df.orderBy(*order).limit(n)


def drop(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    return df.orderBy(*order).offset(n)


def partition(df: DataFrame, path: str, op: str, than, name: str = "passes") -> DataFrame:
    return df.withColumn(name, _test(df, path, op, than))


def compact(df: DataFrame, path: str) -> DataFrame:
    v = of(df, path)
    return df.where(v.col.isNotNull() & (v.col != "") if v.is_string else v.col.isNotNull())


def includes(df: DataFrame, path: str, other: DataFrame, other_path: str) -> DataFrame:
    """Rows whose value is among the other table's, by key text."""
    keys = other.select(key_text(other, other_path).alias("_key")).distinct()
    return df.withColumn("_key", key_text(df, path)).join(keys, "_key", "left_semi").select(*df.columns)


# Sets: by value ---------------------------------------------------------------


def _keys(df: DataFrame, path: str) -> DataFrame:
    return df.select(value_key(of(df, path)).alias("_key"), F.col(path).alias("value"))


def _one_each(keys: DataFrame) -> DataFrame:
    return keys.groupBy("_key").agg(F.min("value").alias("value")).select("value")


def union(a: DataFrame, b: DataFrame, path: str, other: str) -> DataFrame:
    return _one_each(_keys(a, path).unionByName(_keys(b, other)))


def intersection(a: DataFrame, b: DataFrame, path: str, other: str) -> DataFrame:
    return _one_each(_keys(a, path).join(_keys(b, other).select("_key").distinct(), "_key", "left_semi"))


def difference(a: DataFrame, b: DataFrame, path: str, other: str) -> DataFrame:
    return _one_each(_keys(a, path).join(_keys(b, other).select("_key").distinct(), "_key", "left_anti"))


def symmetric_difference(a: DataFrame, b: DataFrame, path: str, other: str) -> DataFrame:
    return difference(a, b, path, other).unionByName(difference(b, a, other, path))


# Along an order ----------------------------------------------------------------


def along(by: Names, order: Names):
    return Window.partitionBy(*by).orderBy(*order)


def row_number(df: DataFrame, by: Names, order: Names, name: str = "_rowNum") -> DataFrame:
    return df.withColumn(name, F.row_number().over(along(by, order)).cast("bigint"))


def placed(df: DataFrame, by: Names, order: Sequence[Column], place: Column, name: str = "_place") -> DataFrame:
    """``place`` (a row number or a rank) within each group's order, without bringing a group into one task.

    Rows are dealt by ranges of group and order, equal ones together, and placed within
    their range; a row for each range and group says how many of the group come before.
    The ranges are written down first, so that counts and rows speak of the same ones.
    """
    dealt = checkpointed(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    local = dealt.withColumn("_i", place.over(Window.partitionBy("_range", *by).orderBy(*order)))
    sizes = dealt.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return beside(local, offsets, ["_range", *by]).withColumn(name, (F.col("_before") + F.col("_i")).cast("bigint")).drop("_range", "_i", "_before")


def rank(df: DataFrame, by: Names, path: str, descending: bool = True, name: str = "_rank") -> DataFrame:
    """Competition ranks (1, 1, 3); nulls first going down, last going up."""
    v = of(df, path)
    key = v.col if v.is_number or v.is_temporal else order_key(v)
    return placed(df, by, [key.desc_nulls_first() if descending else key.asc_nulls_last()], F.rank(), name)


def shifted(df: DataFrame, by: Names, path: str, order: Names, n: int, name: str, fill=None) -> DataFrame:
    """The field of the row ``n`` before (after, if negative); ``fill`` beyond the ends."""
    w = along(by, order)
    out = F.lag(path, n, fill).over(w) if n >= 0 else F.lead(path, -n, fill).over(w)
    return df.withColumn(name, out)


def changes(df: DataFrame, by: Names, path: str, order: Names, n: int = 1) -> DataFrame:
    """``diff`` and ``pctChange`` against the row ``n`` before."""
    x, before = N(of(df, path)), F.lag(N(of(df, path)), n).over(along(by, order))
    return df.withColumns({"diff": x - before, "pctChange": F.try_divide(x - before, before)})


def running(df: DataFrame, by: Names, path: str, order: Names) -> DataFrame:
    """``cumsum`` and ``cumprod``; a field that is no number stays null and is passed over."""
    x = N(of(df, path))
    w = along(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"cumsum": F.when(x.isNotNull(), F.sum(x).over(w)), "cumprod": F.when(x.isNotNull(), F.product(x).over(w))})


def moving_avg(df: DataFrame, by: Names, path: str, order: Names, n: int, name: str = "movingAvg") -> DataFrame:
    return df.withColumn(name, F.avg(Z(of(df, path))).over(along(by, order).rowsBetween(1 - n, 0)))


def fill_missing(df: DataFrame, by: Names, path: str, order: Names, fill=None, strategy: str = "value", name: str = "filled") -> DataFrame:
    w, x = along(by, order), F.col(path)
    if strategy == "forward":
        out = F.coalesce(F.last(x, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(fill))
    elif strategy == "backward":
        out = F.coalesce(F.first(x, True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.lit(fill))
    elif strategy == "mean":
        means = df.groupBy(*by).agg(F.avg(N(of(df, path))).alias("_mean"))
        return beside(df, means, by).withColumn(name, F.coalesce(F.col(path).cast("double"), F.col("_mean"), F.lit(0.0))).drop("_mean")
    else:
        out = F.coalesce(x, F.lit(fill))
    return df.withColumn(name, out)


def zscore(df: DataFrame, by: Names, path: str, name: str = "zscore") -> DataFrame:
    """Distance from the group's mean in its standard deviations: one row a group is joined back."""
    x = N(of(df, path))
    if not by:
        stats = df.agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
        joined = df.crossJoin(F.broadcast(stats))  # one row
    else:
        joined = df.join(df.groupBy(*by).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s")), list(by))
    return joined.withColumn(name, F.try_divide(N(of(df, path)) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def chunk(df: DataFrame, by: Names, order: Names, size: int, name: str = "chunk") -> DataFrame:
    return df.withColumn(name, F.floor((F.row_number().over(along(by, order)) - 1) / size).cast("bigint"))


def sliding(df: DataFrame, by: Names, path: str, order: Names, n: int, name: str = "window") -> DataFrame:
    """Rows that begin a full window of ``n``, with the window's values."""
    w = along(by, order).rowsBetween(0, n - 1)
    return df.withColumn(name, F.collect_list(path).over(w)).where(F.size(name) == n)


def accumulate(df: DataFrame, by: Names, path: str, order: Names, op: str = "sum", start=None, name: str = "accumulated") -> DataFrame:
    """The accumulator's value after each row."""
    x = N(of(df, path))
    w = along(by, order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.lit(None if start is None else float(start)).cast("double") if op in ("sum", "count", "min", "max") else F.lit(start)
    out = {
        "sum": lambda: F.coalesce(F.sum(x).over(w), F.lit(0.0)) + F.coalesce(first, F.lit(0.0)),
        "count": lambda: F.count(F.lit(1)).over(w).cast("double") + F.coalesce(first, F.lit(0.0)),
        "min": lambda: F.least(F.min(x).over(w), first),
        "max": lambda: F.greatest(F.max(x).over(w), first),
        "first": lambda: F.first(path).over(w) if start is None else first,
        "last": lambda: F.col(path),
        "concat": lambda: F.concat(S(lit(start)), F.array_join(F.collect_list(S(of(df, path))).over(w), "")),
    }[op if op in ("sum", "count", "min", "max", "first", "last", "concat") else "sum"]()
    return df.withColumn(name, out)


def numbered(df: DataFrame, order: Names, name: str = "_n", start: int = 1) -> DataFrame:
    """A number for every row of a table in an order, without bringing the table into one task.

    Rows are dealt by ranges of the order and numbered within their range; a table of
    one row a range, whose count is the session's partitions, holds where each begins.
    Ranges come from a sample, which differs from run to run: they are written down
    before they are counted, so that counts and rows speak of the same ranges.
    """
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    local = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return local.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_i") + (start - 1)).drop("_range", "_i", "_before")


# Shapes -----------------------------------------------------------------------


def pivot(df: DataFrame, by: Names, key: str, value: str, order: Names, keys: Names) -> DataFrame:
    """A column for each of the named keys; the last row of a key wins."""
    return df.groupBy(*by).pivot(key, list(keys)).agg(F.max_by(value, F.struct(*order)))


def unpivot(df: DataFrame, by: Names, columns: Names, key: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(list(by), list(columns), key, value)


def explode(df: DataFrame, path: str) -> DataFrame:
    """A row for each element of an array column; a row without elements stays, with null."""
    return df.withColumn(path, F.explode_outer(path))


def zip_rows(a: DataFrame, b: DataFrame, order_a: Names, order_b: Names) -> DataFrame:
    """Rows of two tables side by side, by place; the longer one's rest is left out. Columns of b get ``_2`` where names clash."""
    clash = {c.lower() for c in a.columns}
    right = numbered(b, order_b, "_place")
    right = right.select(*(F.col(c).alias(f"{c}_2" if c.lower() in clash else c) for c in right.columns))
    return numbered(a, order_a, "_place").join(right, "_place").drop("_place")


def lookup(df: DataFrame, table: DataFrame, on: dict[str, str], wanted: str, name: str, order: Names, default=None) -> DataFrame:
    """A left join that takes the first matching row of ``table``; keys are compared as texts.

    ``on`` maps columns of ``df`` to columns of ``table``. Without a match the result is ``default``; a null that is found stays null.
    Spark broadcasts the table where its size allows.
    """
    keys = [S(of(table, c)).alias(f"_k{i}") for i, c in enumerate(on.values())]
    first = table.select(*keys, F.struct(*order).alias("_o"), F.col(wanted).alias("_w")).groupBy(*(f"_k{i}" for i in range(len(on)))).agg(F.min_by(F.struct("_w"), "_o").alias("_hit"))
    keyed = df.withColumns({f"_k{i}": S(of(df, c)) for i, c in enumerate(on)})
    out = keyed.join(first, [f"_k{i}" for i in range(len(on))], "left")
    value = F.when(F.col("_hit").isNotNull(), F.col("_hit._w")).otherwise(F.lit(default))
    return out.withColumn(name, value).select(*df.columns, name)


