"""Core and logic verbs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import LONG, Value, boolean, compare, equal, lit, S, text, truth, unify
from quillspark.functions.registry import verb


@verb("concat", least=0)
def concat(*args):
    return text(F.concat(F.lit(""), *(S(a) for a in args)))


def _first(values, skip):
    cols, kind = unify(*values)
    out = F.lit(None).cast(kind)
    for v, c in reversed(list(zip(values, cols))):
        out = F.when(skip(v), out).otherwise(c)
    return Value(out, kind)


@verb("coalesce", least=0)
def coalesce(*args):
    cols, kind = unify(*args)
    return Value(F.coalesce(*cols) if cols else F.lit(None).cast(kind), kind)


def coalesce_filled(*args):
    """Direct calls of ``coalesce`` skip empty text as well."""
    return _first(args, lambda v: v.col.isNull() | (v.col == "") if v.is_string else v.col.isNull())


@verb("ifNull", least=2)
def if_null(v, default):
    return coalesce(v, default)


@verb("ifEmpty", least=2)
def if_empty(v, default):
    cols, kind = unify(v, default)
    empty = v.col.isNull() | (v.col == "") if v.is_string else v.col.isNull()
    return Value(F.when(empty, cols[1]).otherwise(cols[0]), kind)


@verb("ifElse", least=3)
def if_else(c, a, b):
    cols, kind = unify(a, b)
    return Value(F.when(truth(c), cols[0]).otherwise(cols[1]), kind)


@verb("and", least=2)
def and_(a, b):
    return boolean(truth(a) & truth(b))


@verb("or", least=2)
def or_(a, b):
    return boolean(truth(a) | truth(b))


@verb("not")
def not_(a):
    return boolean(~truth(a))


@verb("xor", least=2)
def xor(a, b):
    return boolean(truth(a) != truth(b))


@verb("eq", least=2)
def eq(a, b):
    return boolean(equal(a, b))


@verb("ne", least=2)
def ne(a, b):
    return boolean(~equal(a, b))


def _order(name: str, op: str):
    @verb(name, least=2)
    def build(a, b):
        return boolean(compare(a, op, b))


for _name, _op in (("lt", "<"), ("lte", "<="), ("gt", ">"), ("gte", ">=")):
    _order(_name, _op)


@verb("between", least=3)
def between(v, lo, hi):
    return boolean(compare(v, ">=", lo) & compare(v, "<=", hi))


@verb("isNull")
def is_null(v):
    return boolean(v.col.isNull())


def _is(name: str, test):
    @verb(name)
    def build(v):
        return boolean(v.col.isNotNull() if test(v) and not v.is_null else F.lit(False))


_is("isString", lambda v: v.is_string)
_is("isNumber", lambda v: v.is_number)
_is("isBoolean", lambda v: v.is_bool)
_is("isDate", lambda v: v.is_temporal)


@verb("isArray")
def is_array(v):
    if v.is_string:
        return boolean(F.coalesce(F.trim(v.col).startswith("[") & F.trim(v.col).endswith("]"), F.lit(False)))
    return boolean(v.col.isNotNull() if v.is_array else F.lit(False))


@verb("isObject")
def is_object(v):
    if v.is_string:
        return boolean(F.coalesce(F.trim(v.col).startswith("{") & F.trim(v.col).endswith("}"), F.lit(False)))
    return boolean(v.col.isNotNull() if v.is_object else F.lit(False))


def type_name(v: Value) -> str:
    if v.is_null:
        return "null"
    for test, name in ((v.is_string, "string"), (v.is_bool, "boolean"), (v.is_array, "array"), (v.is_object, "object")):
        if test:
            return name
    if isinstance(v.type, T.DateType):
        return "date"
    if v.is_temporal:
        return "timestamp"
    if isinstance(v.type, T.IntegralType) or isinstance(v.type, T.DecimalType) and not v.type.scale:
        return "integer"
    return "number" if v.is_number else "binary" if isinstance(v.type, T.BinaryType) else "string"


@verb("typeOf")
def type_of(v):
    return text(F.when(v.col.isNull(), F.lit("null")).otherwise(F.lit(type_name(v))))


@verb("cond", least=2)
def cond(*args):
    pairs, default = list(zip(args[::2], args[1::2])), args[-1] if len(args) % 2 else lit(None)
    cols, kind = unify(*(v for _, v in pairs), default)
    out = cols[-1]
    for (test, _), c in reversed(list(zip(pairs, cols))):
        out = F.when(truth(test), c).otherwise(out)
    return Value(out, kind)


@verb("assert")
def assert_(v, *_):
    return Value(F.when(truth(v), v.col), v.type)


@verb("switch", least=2)
def switch(v, *args):
    pairs, default = list(zip(args[::2], args[1::2])), args[-1] if len(args) % 2 else lit(None)
    cols, kind = unify(*(r for _, r in pairs), default)
    out = cols[-1]
    for (k, _), c in reversed(list(zip(pairs, cols))):
        out = F.when(S(v) == S(k), c).otherwise(out)
    return Value(out, kind)


@verb("isFinite")
def is_finite(v):
    if isinstance(v.type, T.IntegralType):
        return boolean(v.col.isNotNull())
    if v.is_number:
        x = v.col.cast("double")
        return boolean(F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return boolean(F.lit(False))


@verb("isNaN")
def is_nan(v):
    if v.is_string:
        return boolean(F.coalesce(F.lower(v.col) == "nan", F.lit(False)))
    return boolean(F.coalesce(F.isnan(v.col.cast("double")), F.lit(False)) if v.is_number else F.lit(False))


# Lookups over a literal table ------------------------------------------------


class Table:
    """A small constant table: column names and rows of Python values."""

    def __init__(self, name: str, columns: list[str], rows: list[list]):
        self.name, self.columns, self.rows = name, columns, rows


def find(table: Table, wanted: str, keys: list[Value], reverse_of: str | None = None) -> Value:
    """The first row whose key columns equal the keys as texts: its value of ``wanted``; also whether there was one, as ``found``."""
    at = table.columns.index(wanted)
    names = [reverse_of] if reverse_of else [c for c in table.columns if c != wanted][: len(keys)]
    places = [table.columns.index(c) for c in names]
    entries: dict[str, object] = {}
    for row in table.rows:
        entries.setdefault("\x1f".join("" if row[p] is None else _py_text(row[p]) for p in places), row[at])
    values = [lit(x) for x in entries.values()]
    cols, kind = unify(*values) if values else ([], LONG)
    if not entries:
        return Value(F.lit(None).cast("string"), T.StringType())
    pairs = [c for k, v in zip(entries, cols) for c in (F.lit(k), v)]
    key = F.concat_ws("\x1f", *(S(k) for k in keys))
    return Value(F.try_element_at(F.create_map(*pairs), key), kind)


def _py_text(x) -> str:
    return "true" if x is True else "false" if x is False else str(int(x)) if isinstance(x, float) and x == int(x) and abs(x) < 1e15 else str(x)


def table_lookup(table: Table, path: str, keys: list[Value]) -> Value:
    """``lookup``: the column after the dot of the first row that matches; of two keys whose first names a column, that column is searched for the second."""
    wanted = path.rpartition(".")[2]
    if wanted not in table.columns:
        return Value(F.lit(None).cast("string"), T.StringType())
    if len(keys) == 2 and keys[0].is_const and keys[0].const in table.columns and keys[0].const != wanted:
        return find(table, wanted, keys[1:], str(keys[0].const))
    return find(table, wanted, keys)


#: Tables that ``lookup`` finds by name when it is called outside a plan.
TABLES: dict[str, Table] = {}


def _table(path: Value) -> tuple[Table | None, str]:
    p = str(path.const if path.is_const else "")
    return TABLES.get(p.rpartition(".")[0]), p


@verb("lookup", least=2)
def lookup(path, *keys):
    table, p = _table(path)
    return table_lookup(table, p, list(keys)) if table else lit(None)


@verb("lookupDefault", least=3)
def lookup_default(path, *args):
    *keys, default = args
    table, p = _table(path)
    if table is None:
        return default
    found = table_lookup(table, p, keys)
    cols, kind = unify(found, default)
    return Value(F.coalesce(*cols), kind)
