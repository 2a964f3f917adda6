"""Verbs over objects: structs, whose keys are known when the plan is built, and maps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import STRING, S, Value, array, boolean, constant, field, unify
from quillspark.functions.registry import null, verb

#: Keys that are never taken.
UNSAFE = ("__proto__", "constructor", "prototype")


def names(v: Value) -> list[str]:
    return [n for n in v.type.fieldNames() if n not in UNSAFE] if isinstance(v.type, T.StructType) else []


def struct(pairs: list[tuple[str, Value]], present=None) -> Value:
    """A struct of named values; null where ``present`` is false."""
    kind = T.StructType([T.StructField(n, x.type) for n, x in pairs])
    if not pairs:
        return Value(F.lit(None).cast(T.StructType([])), kind)
    made = F.struct(*(x.col.alias(n) for n, x in pairs))
    return Value(made, kind, parts=tuple(pairs)) if present is None else Value(F.when(present, made), kind)


def pairs_of(v: Value) -> list[tuple[str, Value]]:
    return [(n, field(v, n)) for n in names(v)]


def _safe(v: Value):
    return F.map_filter(v.col, lambda k, _: ~k.isin(*UNSAFE))


def as_map(v: Value) -> Value:
    """An object as a map of one type of value."""
    if isinstance(v.type, T.MapType):
        return Value(_safe(v), v.type)
    pairs = pairs_of(v)
    cols, kind = unify(*(x for _, x in pairs))
    made = F.create_map(*(c for (n, _), x in zip(pairs, cols) for c in (F.lit(n), x)))
    return Value(F.when(v.col.isNotNull(), made), T.MapType(STRING, kind))


@verb("keys")
def keys(v):
    if not v.is_object:
        return null(T.ArrayType(STRING))
    return array(F.map_keys(as_map(v).col), STRING)


@verb("values")
def values(v):
    if not v.is_object:
        return null(T.ArrayType(STRING))
    m = as_map(v)
    return array(F.map_values(m.col), m.type.valueType)


@verb("entries")
def entries(v):
    if not v.is_object:
        return null(T.ArrayType(T.ArrayType(STRING)))
    m = as_map(v)
    kind = m.type.valueType
    return array(F.transform(F.map_entries(m.col), lambda e: F.array(e["key"], S(Value(e["value"], kind)))), T.ArrayType(STRING))


def _at(v: Value, path: str) -> Value:
    for part in path.split("."):
        v = Value(F.get(v.col, F.lit(int(part))), v.item) if v.is_array and part.isdigit() else field(v, part)
    return v


@verb("has", least=2)
def has(v, path):
    return boolean(_at(v, str(constant(path, ""))).col.isNotNull())


@verb("get", least=2)
def get(v, path, default=None):
    found = _at(v, str(constant(path, "")))
    if default is None or default.is_null:
        return found
    cols, kind = unify(found, default)
    return Value(F.coalesce(*cols), kind)


@verb("merge")
def merge(*args):
    objects = [a for a in args if a.is_object]
    if not objects:
        return null()
    if all(isinstance(a.type, T.StructType) for a in objects):
        found: dict[str, Value] = {}
        for a in objects:
            for n, x in pairs_of(a):
                # A whole object that is null adds nothing; one that is there overrides, with nulls too.
                old = found.get(n)
                if old is None:
                    found[n] = x
                else:
                    cols, kind = unify(old, x)
                    found[n] = Value(F.when(a.col.isNotNull(), cols[1]).otherwise(cols[0]), kind)
        return struct(list(found.items()))
    maps = [as_map(a) for a in objects]
    kind = maps[0].type if len({m.type.simpleString() for m in maps}) == 1 else T.MapType(STRING, STRING)
    shown = [m.col if m.type == kind else F.transform_values(m.col, lambda _, x, t=m.type.valueType: S(Value(x, t))) for m in maps]
    empty = F.create_map().cast(kind)
    return Value(F.map_concat(*(F.coalesce(m, empty) for m in shown)), kind)


@verb("pick")
def pick(v, *keys_):
    wanted = [str(constant(k, "")) for k in keys_]
    if isinstance(v.type, T.MapType):
        return Value(F.map_filter(v.col, lambda k, _: k.isin(*wanted) if wanted else F.lit(False)), v.type)
    return struct([(n, field(v, n)) for n in wanted if n in names(v)], v.col.isNotNull()) if v.is_object else null()


@verb("omit")
def omit(v, *keys_):
    dropped = {str(constant(k, "")) for k in keys_}
    if isinstance(v.type, T.MapType):
        return Value(F.map_filter(_safe(v), lambda k, _: ~k.isin(*dropped) if dropped else F.lit(True)), v.type)
    return struct([(n, x) for n, x in pairs_of(v) if n not in dropped], v.col.isNotNull()) if v.is_object else null()


@verb("fromEntries")
def from_entries(v):
    from quillspark.functions.coercion import to_object

    return to_object(v) if v.is_array else null()


@verb("invert")
def invert(v):
    if not v.is_object:
        return null()
    m = as_map(v)
    kind = m.type.valueType
    return Value(F.map_from_entries(F.transform(F.map_entries(m.col), lambda e: F.struct(S(Value(e["value"], kind)).alias("key"), e["key"].alias("value")))), T.MapType(STRING, STRING))


@verb("defaults", least=2)
def defaults(v, more):
    if isinstance(v.type, T.StructType) and isinstance(more.type, T.StructType):
        return struct([*pairs_of(v), *((n, x) for n, x in pairs_of(more) if n not in names(v))], v.col.isNotNull())
    return merge(more, v)


@verb("renameKeys", least=2)
def rename_keys(v, mapping):
    new = {n: x for n, x in pairs_of(mapping)}
    if isinstance(v.type, T.StructType):
        to = lambda n: str(new[n].const) if n in new and new[n].is_const else n
        return struct([(to(n), x) for n, x in pairs_of(v)], v.col.isNotNull())
    if isinstance(v.type, T.MapType):
        m = as_map(mapping).col
        return Value(F.transform_keys(_safe(v), lambda k, _: F.coalesce(F.try_element_at(m, k), k)), v.type)
    return null()


@verb("compactObject")
def compact_object(v):
    """Drops nulls, empty texts, empty arrays and empty objects; a struct becomes a map, as its keys vary by row."""
    if not v.is_object:
        return null()
    m = as_map(v)
    kind = m.type.valueType
    if isinstance(kind, (T.ArrayType, T.MapType)):
        good = lambda _, x: x.isNotNull() & (F.size(x) > 0)
    elif isinstance(kind, T.StringType):
        good = lambda _, x: x.isNotNull() & (x != "")
    else:
        good = lambda _, x: x.isNotNull()
    return Value(F.map_filter(m.col, good), m.type)
