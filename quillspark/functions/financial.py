"""Verbs of money over time, and statistics over arrays.

Sums are folds in array order; Newton's method is a fold over a fixed number of
steps, so that no value leaves the engine.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import DOUBLE, N, Value, array, constant, double, let
from quillspark.functions.registry import null, verb

ZERO = lambda: F.lit(0.0)


def numbers(v: Value):
    """The items that are numbers, as doubles."""
    if not v.is_array:
        return F.array().cast("array<double>")
    return F.filter(F.transform(v.col, lambda x: N(Value(x, v.item))), lambda x: x.isNotNull())


def total(xs):
    return F.aggregate(xs, ZERO(), lambda a, x: a + x)


def mean(xs):
    return F.try_divide(total(xs), F.size(xs).cast("double"))


def _closed(name: str, build, least: int = 3):
    @verb(name, least=least)
    def make(*args):
        return double(build(*(N(a) for a in args[:least])))


_closed("compound", lambda p, r, n: p * F.pow(1 + r, n))
_closed("discount", lambda fv, r, n: F.try_divide(fv, F.pow(1 + r, n)))
_closed("pmt", lambda p, r, n: F.when(n > 0, F.when(r == 0, F.try_divide(p, n)).otherwise(F.try_divide(p * r * F.pow(1 + r, n), F.pow(1 + r, n) - 1))))
_closed("fv", lambda p, r, n: F.when(r == 0, p * n).otherwise(F.try_divide(p * (F.pow(1 + r, n) - 1), r)))
_closed("pv", lambda p, r, n: F.when(r == 0, p * n).otherwise(F.try_divide(p * (1 - F.pow(1 + r, -n)), r)))
_closed("depreciation", lambda cost, salvage, life: F.when((life > 0) & (salvage <= cost), F.try_divide(cost - salvage, life)))
_closed("interpolate", lambda x, x1, y1, x2, y2: F.when(x.isNotNull() & y2.isNotNull() & (x1 == x2), y1).otherwise(y1 + F.try_divide((x - x1) * (y2 - y1), x2 - x1)), least=5)


@verb("nper", least=3)
def nper(r, pmt, pv):
    x, p, v = N(r), N(pmt), N(pv)
    ratio = F.try_divide(p, p + x * v)
    return double(F.when(x == 0, F.try_divide(-v, p)).when(ratio > 0, F.try_divide(F.ln(ratio), F.ln(1 + x))))


@verb("npv", least=2)
def npv(r, flows):
    xs, rate = numbers(flows), N(r)
    start = F.struct(F.lit(0).alias("t"), ZERO().alias("v"))
    fold = F.aggregate(xs, start, lambda a, x: F.struct((a["t"] + 1).alias("t"), (a["v"] + F.try_divide(x, F.pow(1 + rate, a["t"]))).alias("v")), lambda a: a["v"])
    return double(F.when(F.size(xs) > 0, fold))


def _newton(steps: int, guess, value_and_slope, done):
    """The last rate of Newton's method; ``done`` says, of the new and old rates and the value, whether a step is the last.

    State: rate, and whether it goes on (0), came to an end (1) or failed (2).
    """
    start = F.struct(guess.cast("double").alias("r"), F.lit(0).alias("s"))

    def step(a, _):
        value, slope = value_and_slope(a["r"])
        nxt = a["r"] - F.try_divide(value, slope)
        state = done(nxt, a["r"], value, slope)
        moved = F.struct(F.when(state == 3, a["r"]).otherwise(nxt).alias("r"), F.when(state == 3, F.lit(1)).otherwise(F.coalesce(state, F.lit(2))).alias("s"))
        return F.when(a["s"] != 0, a).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


@verb("irr")
def irr(flows, guess=None):
    xs = numbers(flows)
    g = F.coalesce(N(guess), F.lit(0.1)) if guess is not None else F.lit(0.1)

    def at(rate):
        start = F.struct(F.lit(0).alias("t"), ZERO().alias("v"), ZERO().alias("d"))
        add = lambda a, x: F.struct(
            (a["t"] + 1).alias("t"), (a["v"] + F.try_divide(x, F.pow(1 + rate, a["t"]))).alias("v"), (a["d"] - F.when(a["t"] > 0, F.try_divide(a["t"] * x, F.pow(1 + rate, a["t"] + 1))).otherwise(0.0)).alias("d")
        )
        sums = F.aggregate(xs, start, add)
        return sums["v"], sums["d"]

    def done(nxt, old, value, slope):
        return F.when(F.abs(slope) < 1e-15, 2).when(F.abs(nxt - old) < 1e-10, 1).when(F.abs(nxt) > 1e6, 2).when(nxt.isNotNull(), 0)

    out = _newton(200, g, at, done)
    return double(F.when((F.size(xs) >= 2) & (out["s"] == 1), out["r"]))


@verb("rate", least=3)
def rate(n, pmt, pv, fv=None):
    k, p, v, f = N(n), N(pmt), N(pv), F.coalesce(N(fv), ZERO()) if fv is not None else ZERO()

    def at(r):
        grown, before = F.pow(1 + r, k), F.pow(1 + r, k - 1)
        value = v * grown + p * F.try_divide(grown - 1, r) + f
        slope = v * k * before + p * F.try_divide(k * before * r - (grown - 1), r * r)
        return value, slope

    def done(nxt, old, value, slope):
        return F.when(F.abs(slope) < 1e-15, 2).when(F.abs(nxt - old) < 1e-10, 1).when(nxt.isNotNull(), 0)

    out = _newton(100, F.lit(0.1), at, done)
    return double(F.when(k.isNotNull() & p.isNotNull() & v.isNotNull() & (out["s"] != 2), out["r"]))


def _days(v: Value):
    """Each item as a day number."""
    if not v.is_array:
        return F.array().cast("array<double>")
    if isinstance(v.item, T.DateType):
        return F.transform(v.col, lambda x: F.unix_date(x).cast("double"))
    if isinstance(v.item, (T.TimestampType, T.TimestampNTZType)):
        return F.transform(v.col, lambda x: F.unix_micros(x.cast("timestamp")).cast("double") / 86400e6)
    return F.transform(v.col, lambda x: N(Value(x, v.item)))


def _dated(amounts, dates):
    xs, ds = numbers(amounts), _days(dates)
    good = (F.size(xs) == F.size(ds)) & (F.size(xs) > 0) & F.forall(ds, lambda d: d.isNotNull())
    return F.zip_with(xs, ds, lambda x, d: F.struct(x.alias("x"), ((d - ds[0]) / 365.0).alias("t"))), good


@verb("xnpv", least=3)
def xnpv(r, amounts, dates):
    flows, good = _dated(amounts, dates)
    q = N(r)
    return double(F.when(good, F.aggregate(flows, ZERO(), lambda a, f: a + F.try_divide(f["x"], F.pow(1 + q, f["t"])))))


@verb("xirr", least=2)
def xirr(amounts, dates, guess=None):
    flows, good = _dated(amounts, dates)
    g = F.coalesce(N(guess), F.lit(0.1)) if guess is not None else F.lit(0.1)

    def at(r):
        start = F.struct(ZERO().alias("v"), ZERO().alias("d"))
        sums = F.aggregate(flows, start, lambda a, f: F.struct((a["v"] + F.try_divide(f["x"], F.pow(1 + r, f["t"]))).alias("v"), (a["d"] - F.try_divide(f["t"] * f["x"], F.pow(1 + r, f["t"] + 1))).alias("d")))
        return sums["v"], sums["d"]

    def done(nxt, old, value, slope):
        return F.when(F.abs(value) < 1e-7, 3).when(F.abs(slope) < 1e-12, 2).when(nxt <= -1, 2).when(nxt.isNotNull() & ~F.isnan(nxt) & (F.abs(nxt) < float("inf")), 0)

    out = _newton(100, g, at, done)
    return double(F.when(good & (F.size(flows) >= 2) & (out["s"] == 1), out["r"]))


# Statistics -------------------------------------------------------------------


def squares(xs):
    """Sum of squared distances from the mean."""
    m = mean(xs)
    return F.aggregate(xs, ZERO(), lambda a, x: a + (x - m) * (x - m))


def _stat(name: str, build, least: int = 1):
    @verb(name, least=least)
    def make(v, *rest):
        xs = numbers(v)
        return double(F.when(F.size(xs) > 0, build(xs, *rest)))


_n = lambda xs: F.size(xs).cast("double")
_stat("variance", lambda xs: squares(xs) / _n(xs))
_stat("std", lambda xs: F.sqrt(squares(xs) / _n(xs)))
_stat("varianceSample", lambda xs: F.when(F.size(xs) > 1, F.try_divide(squares(xs), _n(xs) - 1)))
_stat("stdSample", lambda xs: F.when(F.size(xs) > 1, F.sqrt(F.try_divide(squares(xs), _n(xs) - 1))))


def _interpolated(xs, share):
    """The value at a share of the sorted items, between neighbours in proportion."""
    s = F.array_sort(xs)
    at = share * (F.size(xs) - 1)
    lo = F.floor(at).cast("int")
    a, b = F.get(s, lo), F.get(s, F.least(lo + 1, F.size(xs) - 1))
    return a + (at - lo) * (b - a)


def _median(xs):
    s, n = F.array_sort(xs), F.size(xs)
    upper = F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n % 2 == 1, upper).otherwise((F.get(s, F.floor(n / 2).cast("int") - 1) + upper) / 2)


_stat("median", _median)
_stat("percentile", lambda xs, p, *_: F.when(N(p).between(0, 100), _interpolated(xs, N(p) / 100)), least=2)
_stat("quantile", lambda xs, q, *_: F.when(N(q).between(0, 1), _interpolated(xs, N(q) * 100 / 100)), least=2)


def _mode(xs):
    """The most frequent item, of several the one that comes first: by the lengths of runs of the sorted items."""

    def longest(sorted_):
        begins = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda j: (j == 0) | (F.get(sorted_, j)["x"] != F.get(sorted_, j - 1)["x"]))
        runs = let(begins, lambda at: F.transform(at, lambda j, k: F.struct((F.coalesce(F.get(at, k + 1), F.size(sorted_)) - j).alias("n"), (-F.get(sorted_, j)["i"]).alias("i"), F.get(sorted_, j)["x"].alias("x"))))
        return F.array_max(runs)["x"]

    return F.when(F.size(xs) > 0, let(F.array_sort(F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), longest))


_stat("mode", _mode)


def _paired(x, y):
    a, b = numbers(x), numbers(y)
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, 1, n), F.slice(b, 1, n), n


def _cross(a, b):
    ma, mb = mean(a), mean(b)
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - ma) * (q - mb)), ZERO(), lambda s, x: s + x)


@verb("covariance", least=2)
def covariance(x, y):
    a, b, n = _paired(x, y)
    return double(F.when(n > 0, F.try_divide(_cross(a, b), n.cast("double"))))


@verb("correlation", least=2)
def correlation(x, y):
    a, b, n = _paired(x, y)
    return double(F.when(n > 0, F.try_divide(_cross(a, b), F.sqrt(squares(a) * squares(b)))))


@verb("zscore", least=2)
def zscore(v, arr):
    xs = numbers(arr)
    return double(F.when(F.size(xs) > 0, F.try_divide(N(v) - mean(xs), F.sqrt(squares(xs) / _n(xs)))))


@verb("weightedAvg", least=2)
def weighted_avg(v, w):
    a, b, n = _paired(v, w)
    return double(F.when(n > 0, F.try_divide(total(F.zip_with(a, b, lambda p, q: p * q)), total(b))))


@verb("movingAvg", least=2)
def moving_avg(arr, n):
    if not arr.is_array:
        return null()
    size = int(float(constant(n, 0)))
    if size < 1:
        return null(T.ArrayType(DOUBLE))
    xs = F.transform(arr.col, lambda x: F.coalesce(N(Value(x, arr.item)), ZERO()))
    return array(let(xs, lambda items: F.transform(items, lambda _, i: mean(F.slice(items, F.greatest(i - size + 2, F.lit(1)), F.least(i + 1, F.lit(size)))))), DOUBLE)
