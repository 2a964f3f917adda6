"""Typed columns and the coercions that all verbs rest on.

A :class:`Value` is a column with its static type and, for literals, its Python
value, so that each verb picks its expression when the plan is built and no type
is tested row by row.  Everything here gives null-free results where the verbs
need them (truth, comparison, rendering), and all of it is built-in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NOT_CONSTANT = object()
STRING, DOUBLE, LONG, BOOL = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()

#: Text that reads as a number, with digits that may be grouped by single underscores.
_DIGITS = r"\d+(?:_\d+)*"
NUMBER = rf"^\s*[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))\s*$"


@dataclass(frozen=True)
class Value:
    col: Column
    type: T.DataType
    const: object = _NOT_CONSTANT
    #: Names and values of an object that was made from them, so that its constants stay known.
    parts: tuple = ()

    @property
    def is_const(self) -> bool:
        return self.const is not _NOT_CONSTANT

    @property
    def is_null(self) -> bool:
        return self.const is None or isinstance(self.type, T.NullType)

    @property
    def is_string(self) -> bool:
        return isinstance(self.type, (T.StringType, T.NullType))

    @property
    def is_number(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def is_bool(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def is_temporal(self) -> bool:
        return isinstance(self.type, (T.DateType, T.TimestampType, T.TimestampNTZType))

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def is_object(self) -> bool:
        return isinstance(self.type, (T.StructType, T.MapType))

    @property
    def item(self) -> T.DataType:
        return self.type.elementType if self.is_array else STRING


def lit(x) -> Value:
    """A literal of Python: null, boolean, integer, float, decimal, string, date, timestamp or list."""
    if x is None:
        return Value(F.lit(None).cast("string"), STRING, None)
    if isinstance(x, bool):
        return Value(F.lit(x), BOOL, x)
    if isinstance(x, int):
        kind = LONG if -(1 << 63) <= x < 1 << 63 else T.DecimalType(38, 0)
        return Value(F.lit(x if kind is LONG else Decimal(x)).cast(kind), kind, x)
    if isinstance(x, float):
        return Value(F.lit(x), DOUBLE, x)
    if isinstance(x, Decimal):
        kind = T.DecimalType(38, max(0, -x.as_tuple().exponent))
        return Value(F.lit(x).cast(kind), kind, x)
    if isinstance(x, str):
        return Value(F.lit(x), STRING, x)
    if isinstance(x, datetime):
        return Value(F.lit(x), T.TimestampType(), x)
    if isinstance(x, date):
        return Value(F.lit(x), T.DateType(), x)
    if isinstance(x, (list, tuple)):
        items = [lit(i) for i in x]
        cols, kind = unify(*items)
        return Value(F.array(*(c.cast(kind) for c in cols)) if items else F.array().cast(T.ArrayType(kind)), T.ArrayType(kind))
    raise TypeError(f"no literal of {type(x).__name__}")


def of(df: DataFrame, path: str) -> Value:
    """A column or dotted field of a DataFrame."""
    first, *rest = path.split(".")
    value = Value(df[first], df.schema[first].dataType)
    for name in rest:
        value = field(value, name)
    return value


def field(value: Value, path: str) -> Value:
    """A dotted field of an object; what isn't there is null."""
    for name in [p for p in path.split(".") if p]:
        if name in dict(value.parts):
            value = dict(value.parts)[name]
        elif isinstance(value.type, T.StructType) and name in value.type.fieldNames():
            value = Value(value.col.getField(name), value.type[name].dataType)
        elif isinstance(value.type, T.MapType):
            value = Value(F.try_element_at(value.col, F.lit(name)), value.type.valueType)
        else:
            return Value(F.lit(None).cast("string"), STRING, None)
    return value


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often a lambda within reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Rendering -----------------------------------------------------------------


def _double_text(x: Column) -> Column:
    """A double as text: whole numbers without a point, others in the shortest form, with an exponent from 1e16 and below 1e-4 only."""
    shown = x.cast("string")
    size = F.abs(x)
    plain = F.regexp_replace(shown.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", "")
    mantissa = F.regexp_replace(F.substring_index(shown, "E", 1), r"\.0$", "")
    power = F.substring_index(shown, "E", -1).try_cast("int")
    exponent = F.concat(mantissa, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.abs(power) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(power).cast("string"))
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(size == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size < 1e15) & (x == F.floor(x).cast("double")), x.try_cast("bigint").cast("string"))
        .when(~shown.contains("E"), shown)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(exponent)
    )


def shown(v: Value) -> Column:
    """Text of a value, null where it is null."""
    if v.is_const and isinstance(v.const, (str, bool, int, float)):
        if isinstance(v.const, bool):
            return F.lit("true" if v.const else "false")
        if isinstance(v.const, float):
            c = v.const
            return F.lit(str(int(c)) if c == c and abs(c) < 1e15 and c == int(c) else str(c))
        return F.lit(str(v.const))
    if isinstance(v.type, (T.DoubleType, T.FloatType)):
        return F.when(v.col.isNotNull(), _double_text(v.col.cast("double")))
    if isinstance(v.type, T.DecimalType):
        whole = v.col.cast("string")
        return F.when(whole.contains("."), F.regexp_replace(whole, r"\.?0+$", "")).otherwise(whole)
    if v.is_array:
        return F.when(v.col.isNotNull(), F.concat(F.lit("["), F.size(v.col).cast("string"), F.lit(" items]")))
    if v.is_object:
        return F.when(v.col.isNotNull(), F.lit("[object]"))
    if isinstance(v.type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if v.is_string:
        return v.col
    return v.col.cast("string")


def S(v: Value) -> Column:
    """Text of a value; null is empty."""
    return shown(v) if v.is_const and v.const is not None else F.coalesce(shown(v), F.lit(""))


# Numbers -------------------------------------------------------------------


def _parsed(text: Column) -> Column:
    """The number that a text reads as, else null (empty text too)."""
    return F.when(text.rlike(NUMBER), F.regexp_replace(text, r"[\s_]", "").try_cast("double"))


def N(v: Value) -> Column:
    """A value as a double, or null; an empty text is 0, true is 1."""
    if v.is_const and not isinstance(v.const, (str, type(None))):
        return F.lit(float(v.const)) if isinstance(v.const, (int, float, bool)) else v.col.cast("double")
    if v.is_number or v.is_bool:
        return v.col.cast("double")
    if v.is_string:
        return F.when(v.col == "", F.lit(0.0)).otherwise(_parsed(v.col))
    return F.lit(None).cast("double")


def Z(v: Value) -> Column:
    """A value as a double; null and what is no number are 0."""
    return N(v) if v.is_const and isinstance(v.const, (int, float)) else F.coalesce(N(v), F.lit(0.0))


def ordinal(v: Value) -> Column:
    """What a value is ordered by among numbers, else null; an empty text and booleans are no numbers."""
    if v.is_number:
        return v.col.cast("double")
    if v.is_string and not v.is_null:
        return _parsed(v.col)
    return F.lit(None).cast("double")


def whole(v: Value) -> Column:
    """A number cut toward zero, as an int."""
    if v.is_const and isinstance(v.const, (int, float)):
        return F.lit(int(v.const))
    n = N(v)
    return F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("int")


def rounded_result(x: Column) -> Column:
    """Null for what isn't finite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(x: Column, text_free: bool = True) -> Value:
    return Value(x, DOUBLE)


# Truth and comparison: never null ------------------------------------------


def truth(v: Value) -> Column:
    if v.is_null:
        return F.lit(False)
    if v.is_bool:
        return F.coalesce(v.col, F.lit(False))
    if v.is_number:
        return F.coalesce(v.col != 0, F.lit(False))
    if v.is_string:
        return F.coalesce(v.col != "", F.lit(False))
    return v.col.isNotNull()


def equal(a: Value, b: Value) -> Column:
    """Equality across types: numbers with numeric text, else the texts; null equals null and empty text."""
    if a.is_number and b.is_number or a.is_bool and b.is_bool:
        if b.is_const and b.const is not None:
            return (a.col == b.col) & a.col.isNotNull()
        return a.col.eqNullSafe(b.col)
    if a.is_string and b.is_string:
        if b.is_const and b.const not in (None, ""):
            return (a.col == b.col) & a.col.isNotNull()
        return S(a) == S(b)
    if a.is_number and b.is_string or a.is_string and b.is_number:
        x, y = ordinal(a), ordinal(b)
        return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(S(a) == S(b))
    return S(a) == S(b)


def compare(a: Value, op: str, b: Value) -> Column:
    """Order across types: as numbers where both are, else as texts, null as empty text."""
    test = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if a.is_number and b.is_number and b.is_const and b.const is not None and op[0] == ">":
        # Null is empty text, which is never greater: the plain test, which a scan can take over, says the same.
        return test(a.col, b.col) & a.col.isNotNull()
    x, y = ordinal(a), ordinal(b)
    return F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(test(S(a), S(b)))


def predicate(v: Value, op: str, than: Value) -> Column:
    """The ten operators of conditions; an unknown one is false."""
    if op in ("=", "=="):
        return equal(v, than)
    if op in ("!=", "<>"):
        return ~equal(v, than)
    if op in ("<", "<=", ">", ">="):
        return compare(v, op, than)
    if op == "contains":
        return S(v).contains(S(than))
    if op == "startsWith":
        return S(v).startswith(S(than))
    if op == "endsWith":
        return S(v).endswith(S(than))
    return F.lit(False)


# Results -------------------------------------------------------------------


def text(col: Column) -> Value:
    return Value(col, STRING)


def boolean(col: Column) -> Value:
    return Value(col, BOOL)


def integer(col: Column) -> Value:
    return Value(col.cast("bigint"), LONG)


def double(col: Column) -> Value:
    return Value(rounded_result(col.cast("double")), DOUBLE)


def array(col: Column, item: T.DataType) -> Value:
    return Value(col, T.ArrayType(item))


def constant(v: Value, default=None):
    """The Python value of an argument that must be constant."""
    if not v.is_const:
        raise ValueError("this argument must be a constant")
    return default if v.const is None else v.const


def unify(*values: Value) -> tuple[list[Column], T.DataType]:
    """Columns of one type: the common one, else text."""
    kinds = {v.type.simpleString() for v in values if not v.is_null}
    if len(kinds) <= 1:
        kind = next((v.type for v in values if not v.is_null), STRING)
    elif all(v.is_number or v.is_null for v in values):
        kind = DOUBLE
    else:
        return [shown(v) if not v.is_null else F.lit(None).cast("string") for v in values], STRING
    return [v.col.cast(kind) if v.type != kind else v.col for v in values], kind
