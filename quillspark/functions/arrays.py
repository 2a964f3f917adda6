"""Collection verbs over array columns.

The same operators over tables, whose rows are the items, are in
:mod:`quillspark.operators.relational`; there nothing is gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import BOOL, DOUBLE, LONG, N, S, STRING, Value, array, boolean, constant, equal, field, integer, let, lit, ordinal, predicate, shown, text, truth, unify, whole
from quillspark.functions.numeric import _LOW, mulberry_column, text_seed
from quillspark.functions.registry import call, null, verb


def item(v: Value, x) -> Value:
    return Value(x, v.item)


def empty(kind: T.DataType):
    return F.array().cast(T.ArrayType(kind))


def member(x: Value, path) -> Value:
    """A dotted field of an item; without a path the item itself."""
    p = str(constant(path, "")) if path is not None else ""
    return field(x, p) if p else x


def known(v: Value):
    """The array, empty where there is none."""
    return F.coalesce(v.col, empty(v.item)) if v.is_array else empty(STRING)


def _test(v, path, op, than):
    o = str(constant(op, ""))
    return lambda x: predicate(member(item(v, x), path), o, than)


@verb("filter")
def filter_(v, path=None, op=None, than=None):
    if path is None:
        keep = lambda x: truth(item(v, x))
    elif op is None or than is None:
        keep = lambda x: truth(member(item(v, x), path))
    else:
        keep = _test(v, path, op, than)
    return array(F.filter(known(v), keep), v.item)


@verb("flatten")
def flatten(v):
    if isinstance(v.item, T.ArrayType):
        return array(F.flatten(F.filter(known(v), lambda x: x.isNotNull())), v.item.elementType)
    return array(known(v), v.item)


def _first_by(xs, key, kind):
    """The first item of each key, in order: places sorted by key, so that no item is compared with all others."""

    def firsts(sorted_):
        begins = F.filter(sorted_, lambda p, j: (j == 0) | ~p["k"].eqNullSafe(F.get(sorted_, j - 1)["k"]))
        return F.array_sort(F.transform(begins, lambda p: p["i"]))

    return let(xs, lambda items: F.transform(let(F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))), firsts), lambda i: F.get(items, i)))


@verb("distinct", "unique", least=0)
def distinct(v=None):
    if v is None:
        return array(empty(STRING), STRING)
    if v.is_array and isinstance(v.item, (T.StructType, T.MapType)):
        return array(F.slice(known(v), 1, 1), v.item)  # all objects read alike as text
    return array(_first_by(known(v), lambda x: S(item(v, x)), v.item), v.item)


def _keyed(xs, key):
    """Items with sort keys: nulls told apart, numbers before other texts, ties by place."""
    return F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))


def order_key(v: Value):
    """A key that sorts as the verbs do: null last, then numbers, then texts."""
    n = ordinal(v)
    return F.struct(v.col.isNull().alias("z"), n.isNull().alias("t"), n.alias("n"), F.when(n.isNull(), S(v)).alias("s"))


def _bare(col):
    return F.transform(col, lambda e: e["x"])


def sorted_array(xs, key, descending: bool = False):
    """Stable; nulls last going up and first going down."""
    if not descending:
        return _bare(F.transform(F.array_sort(F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))), lambda e: F.struct(F.get(xs, e["i"]).alias("x"))))
    # Going down, items that are equal keep their places: sort by the key, then by the place backwards, and turn all around.
    up = F.array_sort(F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), (-i).alias("i"))))
    return F.transform(F.reverse(up), lambda e: F.get(xs, -e["i"]))


@verb("sort")
def sort(v):
    return array(sorted_array(known(v), lambda x: order_key(item(v, x))), v.item)


@verb("sortDesc")
def sort_desc(v):
    return array(sorted_array(known(v), lambda x: order_key(item(v, x)), True), v.item)


@verb("sortBy", least=2)
def sort_by(v, path):
    return array(sorted_array(known(v), lambda x: order_key(member(item(v, x), path))), v.item)


@verb("map", "pluck")
def map_(v, path=None):
    kind = member(Value(F.lit(None), v.item), path).type
    return array(F.transform(known(v), lambda x: member(item(v, x), path).col), kind)


@verb("indexOf", least=2)
def index_of(v, x):
    return integer(F.coalesce(F.array_position(F.transform(known(v), lambda y: equal(item(v, y), x)), F.lit(True)), F.lit(0)) - 1)


@verb("at", least=2)
def at(v, i):
    n = whole(i)
    return Value(F.try_element_at(v.col, F.when(n >= 0, n + 1).otherwise(n)), v.item) if v.is_array else null()


@verb("slice", least=2)
def slice_(v, start, end=None):
    xs = known(v)
    size = F.size(xs)
    place = lambda n: F.when(n < 0, F.greatest(size + n, F.lit(0))).otherwise(F.least(n, size))
    a = place(whole(start))
    b = place(whole(end)) if end is not None and not end.is_null else size
    return array(F.slice(xs, a + 1, F.greatest(b - a, F.lit(0))), v.item)


@verb("reverse")
def reverse(v):
    return array(F.reverse(known(v)), v.item)


@verb("every", least=4)
def every(v, path, op, than):
    return boolean(F.when(v.col.isNotNull(), F.forall(v.col, _test(v, path, op, than)))) if v.is_array else null(BOOL)


@verb("some", least=4)
def some(v, path, op, than):
    return boolean(F.when(v.col.isNotNull(), F.exists(v.col, _test(v, path, op, than)))) if v.is_array else null(BOOL)


@verb("find", least=4)
def find(v, path, op, than):
    return Value(F.get(F.filter(known(v), _test(v, path, op, than)), F.lit(0)), v.item)


@verb("findIndex", least=4)
def find_index(v, path, op, than):
    return integer(F.array_position(F.transform(known(v), _test(v, path, op, than)), F.lit(True)) - 1)


@verb("includes", least=2)
def includes(v, x):
    return boolean(F.exists(known(v), lambda y: equal(item(v, y), x)))


def _same(a: Value, b: Value) -> tuple[Value, Value]:
    """Two arrays of one type of item: the common one, else text."""
    if not b.is_array:
        return a, array(empty(a.item), a.item)
    if not a.is_array:
        return array(empty(b.item), b.item), b
    if a.item == b.item:
        return a, b
    both = [Value(F.lit(None).cast(k), k) for k in (a.item, b.item)]
    if all(x.is_number for x in both):
        return tuple(array(v.col.cast("array<double>"), DOUBLE) for v in (a, b))
    return tuple(array(F.transform(v.col, lambda x, v=v: shown(item(v, x))), STRING) for v in (a, b))


@verb("concatArrays", least=2)
def concat_arrays(a, b):
    if not a.is_array and not b.is_array:
        return null()
    x, y = _same(a, b)
    return array(F.concat(known(x), known(y)), x.item)


@verb("zip", least=2)
def zip_(a, b):
    x, y = _same(a, b)
    n = F.least(F.size(known(x)), F.size(known(y)))
    return array(F.transform(F.slice(known(x), 1, n), lambda p, i: F.array(p, F.get(known(y), i))), T.ArrayType(x.item))


def _group_keys(v, path):
    return F.transform(known(v), lambda x: S(member(item(v, x), path)))


@verb("groupBy", least=2)
def group_by(v, path):
    keys = _group_keys(v, path)
    kind = T.StructType([T.StructField("key", STRING), T.StructField("items", T.ArrayType(v.item))])
    groups = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.filter(known(v), lambda _, i: F.get(keys, i) == k).alias("items")))
    return array(groups, kind)


@verb("partition", least=4)
def partition(v, path, op, than):
    test = _test(v, path, op, than)
    return array(F.array(F.filter(known(v), test), F.filter(known(v), lambda x: ~test(x))), T.ArrayType(v.item))


@verb("take", "limit", least=2)
def take(v, n):
    k = F.floor(N(n)).cast("int")
    return array(F.when(k >= 0, F.slice(known(v), F.lit(1), k)), v.item)


@verb("drop", least=2)
def drop(v, n):
    k = F.floor(N(n)).cast("int")
    return array(F.when(k >= 0, F.slice(known(v), k + 1, F.greatest(F.size(known(v)) - k, F.lit(0)))), v.item)


@verb("chunk", least=2)
def chunk(v, size):
    k, xs = whole(size), known(v)
    starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.greatest(k, F.lit(1)))).otherwise(empty(T.IntegerType()))
    return array(F.when(k > 0, F.transform(starts, lambda i: F.slice(xs, i, k))), T.ArrayType(v.item))


MOST_IN_RANGE = 10_000


@verb("range")
def range_(a, b=None, step=None):
    lo, hi = (F.lit(0.0), N(a)) if b is None else (N(a), N(b))
    s = N(step) if step is not None else F.lit(1.0)
    n = F.least(F.greatest(F.ceil(F.try_divide(hi - lo, s)), F.lit(0)), F.lit(MOST_IN_RANGE)).cast("int")
    made = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: lo + i * s)).otherwise(empty(DOUBLE))
    return array(F.when(lo.isNotNull() & hi.isNotNull() & (s != 0), made), DOUBLE)


@verb("compact")
def compact(v):
    keep = (lambda x: x.isNotNull() & (x != "")) if isinstance(v.item, T.StringType) else (lambda x: x.isNotNull())
    return array(F.filter(known(v), keep), v.item)


def _with(v: Value, name: str, number):
    """Each item with a number before its own fields; a field of that name of its own wins."""
    if isinstance(v.item, T.StructType):
        own = v.item.fieldNames()
        kind = T.StructType(([] if name in own else [T.StructField(name, LONG)]) + list(v.item.fields))
        made = F.transform(known(v), lambda x, i: F.struct(*([] if name in own else [number(i).cast("bigint").alias(name)]), *(x.getField(n).alias(n) for n in own)))
    else:
        kind = T.StructType([T.StructField(name, LONG), T.StructField("value", v.item)])
        made = F.transform(known(v), lambda x, i: F.struct(number(i).cast("bigint").alias(name), x.alias("value")))
    return array(made, kind)


@verb("rowNumber")
def row_number(v):
    return _with(v, "_rowNum", lambda i: i + 1)


@verb("sample", least=2)
def sample(v, n, seed=None):
    xs = known(v)
    k = F.greatest(F.least(whole(n), F.size(xs)), F.lit(0))
    if seed is None or not seed.is_string:
        return array(F.slice(F.shuffle(xs), F.lit(1), k), v.item)
    start = text_seed(S(seed), 0, True)
    # Swaps from the last place down, over places; then the items at the places.
    places = F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1)).otherwise(empty(T.IntegerType()))
    last = F.size(xs) - 1

    def swap(acc, step):
        i = last - step + 1
        j = F.floor(mulberry_column((start + (step - 1).cast("bigint") * F.lit(0x6D2B79F5)).bitwiseAND(F.lit(_LOW))) * (i + 1)).cast("int")
        a, b = F.get(acc, i), F.get(acc, j)
        return F.transform(acc, lambda x, p: F.when(p == i, b).when(p == j, a).otherwise(x))

    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(empty(T.IntegerType()))
    mixed = F.aggregate(steps, places, swap)
    return array(F.transform(F.slice(mixed, F.lit(1), k), lambda p: F.get(xs, p)), v.item)


@verb("dedupe", least=2)
def dedupe(v, path):
    xs = known(v)
    keys = F.transform(xs, lambda x: shown(member(item(v, x), path)) if isinstance(v.item, T.StructType) else S(item(v, x)))
    return array(F.filter(xs, lambda x, i: F.get(keys, i).isNull() | (F.array_position(keys, F.get(keys, i)) == i + 1)), v.item)


def doubles(v: Value):
    """Items as doubles, null where they are no numbers."""
    return F.transform(known(v), lambda x: N(item(v, x)))


def _running(name: str, start: float, step):
    @verb(name)
    def build(v):
        xs = doubles(v)
        acc = F.struct(F.lit(start).alias("s"), empty(DOUBLE).alias("out"))
        fold = F.aggregate(xs, acc, lambda a, x: F.struct(F.when(x.isNull(), a["s"]).otherwise(step(a["s"], x)).alias("s"), F.array_append(a["out"], F.when(x.isNotNull(), step(a["s"], x))).alias("out")), lambda a: a["out"])
        return array(fold, DOUBLE)


_running("cumsum", 0.0, lambda s, x: s + x)
_running("cumprod", 1.0, lambda s, x: s * x)


def _lagged(v, k, build):
    n = max(1, int(float(constant(k, 1)))) if k is not None else 1
    xs = doubles(v)
    return array(F.transform(xs, lambda x, i: F.when(i >= n, build(x, F.get(xs, i - n)))), DOUBLE)


@verb("diff")
def diff(v, k=None):
    return _lagged(v, k, lambda x, p: x - p)


@verb("pctChange")
def pct_change(v, k=None):
    return _lagged(v, k, lambda x, p: F.try_divide(x - p, p))


def _moved(v, n: int, fill):
    other = fill if fill is not None and not fill.is_null else None
    cols, kind = unify(Value(F.lit(None).cast(v.item), v.item), *([other] if other else []))
    xs = known(v)
    gap = cols[1] if other else F.lit(None).cast(kind)
    return array(F.transform(xs, lambda _, i: F.when((i - n >= 0) & (i - n < F.size(xs)), F.get(xs, i - n).cast(kind)).otherwise(gap)), kind)


@verb("shift")
def shift(v, n=None, fill=None):
    return _moved(v, int(float(constant(n, 1))) if n is not None else 1, fill)


@verb("lag")
def lag(v, n=None, fill=None):
    return _moved(v, max(1, int(float(constant(n, 1)))) if n is not None else 1, fill)


@verb("lead")
def lead(v, n=None, fill=None):
    return _moved(v, -max(1, int(float(constant(n, 1)))) if n is not None else -1, fill)


@verb("rank")
def rank(v, path=None, direction=None):
    up = direction is not None and str(constant(direction, "")).lower() == "asc"
    keys = F.transform(known(v), lambda x: order_key(member(item(v, x), path) if isinstance(v.item, T.StructType) else item(v, x)))
    before = (lambda a, b: a < b) if up else (lambda a, b: a > b)
    ranked = _with(v, "_rank", lambda i: F.size(F.filter(keys, lambda k: before(k, F.get(keys, i)))) + 1)
    return Value(F.when(F.size(known(v)) > 0, ranked.col), ranked.type)


@verb("fillMissing")
def fill_missing(v, fill=None, strategy=None):
    how = str(constant(strategy, "value")).lower() if strategy is not None else "value"
    xs = known(v)
    if how == "mean":
        ds = F.filter(doubles(v), lambda x: x.isNotNull())
        m = F.coalesce(F.try_divide(F.aggregate(ds, F.lit(0.0), lambda a, x: a + x), F.size(ds).cast("double")), F.lit(0.0))
        return array(F.transform(xs, lambda x: F.coalesce(x.cast("double"), m)), DOUBLE)
    f = fill if fill is not None else lit(None)
    cols, kind = unify(Value(F.lit(None).cast(v.item), v.item), *([] if f.is_null else [f]))
    gap = F.lit(None).cast(kind) if f.is_null else cols[1]
    typed = F.transform(xs, lambda x: x.cast(kind))
    if how in ("forward", "backward"):
        ys = F.reverse(typed) if how == "backward" else typed
        acc = F.struct(gap.alias("last"), empty(kind).alias("out"))
        out = F.aggregate(ys, acc, lambda a, x: F.struct(F.coalesce(x, a["last"]).alias("last"), F.array_append(a["out"], F.coalesce(x, a["last"])).alias("out")), lambda a: a["out"])
        return array(F.reverse(out) if how == "backward" else out, kind)
    return array(F.transform(typed, lambda x: F.coalesce(x, gap)), kind)


@verb("joinArray")
def join_array(v, separator=None):
    return text(F.array_join(F.transform(known(v), lambda x: S(item(v, x))), str(constant(separator, ",")) if separator is not None else ","))


@verb("reduce", least=2)
def reduce(v, name, start=None):
    """A fold with any verb; its accumulator has the type of what the verb gives."""
    first = start if start is not None else lit(None)
    fn = str(constant(name, ""))
    kind = call(fn, Value(first.col, first.type), Value(F.lit(None).cast(v.item), v.item)).type
    return Value(F.aggregate(known(v), first.col.cast(kind), lambda a, x: call(fn, Value(a, kind), item(v, x)).col.cast(kind)), kind)


@verb("pivot", least=3)
def pivot(v, key, value):
    kind = member(Value(F.lit(None), v.item), value).type
    pairs = F.transform(known(v), lambda x: F.struct(shown(member(item(v, x), key)).alias("key"), member(item(v, x), value).col.alias("value")))
    return Value(F.map_from_entries(F.filter(pairs, lambda e: e["key"].isNotNull())), T.MapType(STRING, kind))


@verb("unpivot", least=3)
def unpivot(v, key, value):
    from quillspark.functions.objects import as_map

    m = as_map(v)
    k, x = str(constant(key, "key")), str(constant(value, "value"))
    kind = T.StructType([T.StructField(k, STRING), T.StructField(x, m.type.valueType)])
    return array(F.transform(F.map_entries(m.col), lambda e: F.struct(e["key"].alias(k), e["value"].alias(x))), kind)


def value_key(v: Value):
    """The key by which sets tell items apart: numbers by value, others by kind and text."""
    if v.is_number:
        return F.coalesce(F.concat(F.lit("n:"), v.col.cast("double").cast("string")), F.lit("null"))
    if v.is_bool:
        return F.coalesce(F.concat(F.lit("b:"), v.col.cast("string")), F.lit("null"))
    return F.coalesce(F.concat(F.lit("s:"), shown(v)), F.lit("null"))


def _set(name: str, pick):
    @verb(name, least=2)
    def build(a, b):
        x, y = _same(a, b)
        return array(pick(x, y), x.item)


def _kept(v: Value, other: Value, inside: bool):
    keys, others = (F.transform(known(z), lambda e, z=z: value_key(item(z, e))) for z in (v, other))
    def keep(_, i):
        k = F.get(keys, i)
        found = F.array_contains(others, k)
        return (found if inside else ~found) & (F.array_position(keys, k) == i + 1)

    return F.filter(known(v), keep)


_set("intersection", lambda a, b: _kept(a, b, True))
_set("difference", lambda a, b: _kept(a, b, False))
_set("symmetricDifference", lambda a, b: F.concat(_kept(a, b, False), _kept(b, a, False)))
_set("union", lambda a, b: _first_by(F.concat(known(a), known(b)), lambda x: value_key(item(a, x)), a.item))


@verb("countBy")
def count_by(v, path=None):
    if not v.is_array:
        return null(T.MapType(STRING, LONG))
    keys = F.filter(_group_keys(v, path), lambda k: ~F.lower(k).isin("__proto__", "constructor", "prototype"))
    return Value(F.when(v.col.isNotNull(), F.map_from_entries(F.transform(F.array_sort(F.array_distinct(keys)), lambda k: F.struct(k.alias("key"), F.size(F.filter(keys, lambda x: x == k)).cast("bigint").alias("value"))))), T.MapType(STRING, LONG))


@verb("keyBy", least=2)
def key_by(v, path):
    if not v.is_array:
        return null()
    pairs = F.transform(v.col, lambda x: F.struct(S(member(item(v, x), path)).alias("key"), x.alias("value")))
    return Value(F.map_from_entries(F.filter(pairs, lambda e: ~F.lower(e["key"]).isin("__proto__", "constructor", "prototype"))), T.MapType(STRING, v.item))


@verb("explode", least=2)
def explode(v, path):
    """A row for each element of a field; an item whose field is missing or empty stays, with the field null."""
    p = str(constant(path, ""))
    inner = field(Value(F.lit(None), v.item), p)
    if not isinstance(v.item, T.StructType) or not inner.is_array:
        return array(known(v), v.item)
    kind = T.StructType([T.StructField(f.name, inner.item if f.name == p else f.dataType) for f in v.item.fields])

    def rows(x):
        xs = field(item(v, x), p).col
        full = F.when(xs.isNull() | (F.size(xs) == 0), F.array(F.lit(None).cast(inner.item))).otherwise(xs)
        return F.transform(full, lambda e: F.struct(*((e if n == p else x.getField(n)).alias(n) for n in v.item.fieldNames())))

    return array(F.flatten(F.transform(known(v), rows)), kind)


@verb("window", least=2)
def window(v, n):
    k, xs = whole(n), known(v)
    starts = F.when(F.size(xs) >= k, F.sequence(F.lit(1), F.size(xs) - k + 1)).otherwise(empty(T.IntegerType()))
    return array(F.when(k > 0, F.transform(starts, lambda i: F.slice(xs, i, k))), T.ArrayType(v.item))


