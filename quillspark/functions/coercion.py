"""Coercion verbs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import S, Value, Z, array, boolean, double, integer, shown, text, truth
from quillspark.functions.registry import null, verb


@verb("coerceString")
def coerce_string(v):
    return text(shown(v))


@verb("coerceNumber")
def coerce_number(v):
    return double(Z(v))


@verb("coerceInteger")
def coerce_integer(v):
    return integer(F.floor(Z(v)))


@verb("coerceBoolean")
def coerce_boolean(v):
    if v.is_string:
        return boolean(F.coalesce(F.lower(v.col).isin("true", "yes", "y", "1"), F.lit(False)))
    return boolean(truth(v))


#: A date at the start of a text, by its digits alone.
ISO_DATE = r"^\d{4}-\d{2}-\d{2}"


def _epoch_date(n):
    seconds = F.when(F.abs(n) < 1e11, n).otherwise(n / 1000)
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


@verb("coerceDate")
def coerce_date(v):
    """ISO text, eight digits, month/day/year (day first where the first is beyond 12), or an epoch in seconds or milliseconds."""
    if v.is_temporal:
        return text(F.date_format(v.col, "yyyy-MM-dd"))
    if v.is_number:
        return text(_epoch_date(v.col.cast("double")))
    s = F.trim(S(v))
    part = lambda i: F.regexp_extract(s, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i).try_cast("int")
    first, second, year = part(1), part(2), part(3)
    month, day = F.when(first > 12, second).otherwise(first), F.when(first > 12, first).otherwise(second)
    joined = F.format_string("%04d-%02d-%02d", year, month, day)
    eight = F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))
    good = lambda d: F.when(d.try_cast("date").isNotNull(), d)
    return text(
        F.when(s.rlike(ISO_DATE), F.left(s, F.lit(10)))
        .when(s.rlike(r"^\d{8}$"), good(eight))
        .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), good(joined))
        .when(s.rlike(r"^-?\d+(\.\d+)?$"), _epoch_date(s.try_cast("double")))
    )


@verb("coerceTimestamp")
def coerce_timestamp(v):
    if isinstance(v.type, T.DateType):
        return text(F.concat(F.date_format(v.col, "yyyy-MM-dd"), F.lit("T00:00:00")))
    if v.is_temporal:
        return text(shown(v))
    s = S(v)
    return text(F.when(s.rlike(ISO_DATE), F.when(s.contains("T"), s).otherwise(F.concat(F.left(s, F.lit(10)), F.lit("T00:00:00")))))


@verb("tryCoerce")
def try_coerce(v):
    """Text as the narrowest type it reads as; as a column has one type, the result is a VARIANT for text and unchanged otherwise."""
    if not v.is_string:
        return v
    s = F.trim(v.col)
    low = F.lower(s)
    as_json = F.when(low.isin("true", "false"), low).when(s.rlike(r"^[+-]?\d+$"), F.regexp_replace(s, r"^\+", "")).when(s.rlike(r"^[+-]?\d*\.?\d+(?:[eE][+-]?\d+)?$"), s.try_cast("double").cast("string"))
    quoted = F.to_json(F.array(v.col))
    return Value(F.coalesce(F.try_parse_json(as_json), F.try_parse_json(F.substr(quoted, F.lit(2), F.length(quoted) - 2))), T.VariantType())


@verb("toArray", least=0)
def to_array(v=None):
    if v is None or v.is_null:
        return array(F.array().cast("array<string>"), T.StringType())
    if v.is_array:
        return v
    kind = v.type
    return array(F.when(v.col.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(v.col)), kind)


@verb("toObject")
def to_object(v):
    """An array of pairs as a map; the last of a key wins."""
    if not v.is_array:
        return v if v.is_object else null()
    item = v.item
    if isinstance(item, T.ArrayType):
        kind = item.elementType
        return Value(F.map_from_entries(F.transform(v.col, lambda p: F.struct(S(Value(p[0], kind)).alias("key"), p[1].alias("value")))), T.MapType(T.StringType(), kind))
    if isinstance(item, T.StructType) and {"key", "value"} <= set(item.fieldNames()):
        kind = item["value"].dataType
        return Value(F.map_from_entries(F.transform(v.col, lambda p: F.struct(S(Value(p["key"], item["key"].dataType)).alias("key"), p["value"].alias("value")))), T.MapType(T.StringType(), kind))
    return null()
