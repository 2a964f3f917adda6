"""Schemas as rule plans: a table in, violation rows out.

Rules on fields become one array of violations a row, computed in the scan and
exploded, without a shuffle; only uniqueness and references between tables group or
join.  A violation has ``key``, ``path``, ``code``, ``expected`` and ``actual``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field as dataclass_field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import N, S, Value, lit, of, predicate
from quillspark.operators.formats import passes

EPSILON = 1e-9
LONGEST, DEEPEST, MOST_QUANTIFIERS = 1024, 10, 20


@dataclass(frozen=True)
class Field:
    """What a schema asks of one field.

    ``type`` is string, boolean, number, integer, date, timestamp, currency or
    decimal (with ``places``), or empty for any.  ``least`` and ``most`` bound numbers,
    the length of texts, or dates.  ``required_if`` and ``required_unless`` are
    conditions (field, operator, value) that decide whether it is required.
    """

    path: str
    type: str = ""
    required: bool = False
    least: object = None
    most: object = None
    pattern: str | None = None
    format: str | None = None
    enum: Sequence[str] | None = None
    places: int | None = None
    required_if: Sequence[tuple[str, str, object]] = ()
    required_unless: Sequence[tuple[str, str, object]] = ()
    deprecated: bool = False
    computed: bool = False
    unique: bool = False
    override: bool = False


@dataclass(frozen=True)
class Schema:
    """Fields, invariants (expressions) and cardinalities ``(fields, least, most)``."""

    fields: Sequence[Field]
    invariants: Sequence[str] = ()
    cardinalities: Sequence[tuple[Sequence[str], int, int | None]] = dataclass_field(default_factory=tuple)


def safe_pattern(pattern: str) -> bool:
    """Whether a pattern is short and flat enough to run: others are passed over, as are texts that are no pattern."""
    if len(pattern) > LONGEST:
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    bare = re.sub(r"\\.|\[[^\]]*\]", "x", pattern)
    depth = most = 0
    for c in bare:
        depth += (c == "(") - (c == ")")
        most = max(most, depth)
    quantifiers = len(re.findall(r"[*+?]|\{\d", bare))
    return most <= DEEPEST and quantifiers <= MOST_QUANTIFIERS and not re.search(r"\([^()]*[*+][^()]*\)[*+{]", bare)


def _violation(path: str, code: str, expected, actual: Column) -> Column:
    return F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"), F.lit(None if expected is None else str(expected)).cast("string").alias("expected"), actual.cast("string").alias("actual"))


def _type_good(v: Value, kind: str) -> Column:
    """Whether a value is of a type: by the column's own type, or by the text of a text column."""
    if kind in ("", "string"):
        return F.lit(v.is_string or v.is_temporal or not kind)
    if v.is_string:
        patterns = {"boolean": "^(?:true|false)$", "integer": r"^[+-]?\d+$", "date": r"^\d{4}-\d{2}-\d{2}$"}
        if kind in patterns:
            return v.col.rlike(patterns[kind])
        return v.col.try_cast("timestamp").isNotNull() if kind == "timestamp" else N(v).isNotNull() & (v.col != "")
    good = {"boolean": v.is_bool, "integer": isinstance(v.type, T.IntegralType) or isinstance(v.type, T.DecimalType) and not v.type.scale, "date": isinstance(v.type, T.DateType), "timestamp": v.is_temporal}
    return F.lit(good.get(kind, v.is_number))


def _bounds(v: Value, f: Field) -> Column:
    if v.is_number:
        x, lo, hi = N(v), f.least, f.most
    elif v.is_temporal or isinstance(f.least, str) or isinstance(f.most, str):
        x = v.col.try_cast("timestamp") if v.is_string else v.col.cast("timestamp")
        lo, hi = (None if b is None else F.lit(str(b)).try_cast("timestamp") for b in (f.least, f.most))
    else:
        x, lo, hi = F.length(S(v)), f.least, f.most
    out = F.lit(True)
    if lo is not None:
        out = out & (x >= lo)
    if hi is not None:
        out = out & (x <= hi)
    return F.coalesce(out, F.lit(True))


def field_violations(df: DataFrame, f: Field) -> list[tuple[Column, Column]]:
    """Tests that are true for a violation, each with the violation."""
    v = of(df, f.path)
    shown, null = S(v), v.col.isNull()
    needed = F.lit(f.required)
    code = "V001"
    if f.required_if or f.required_unless:
        code, needed = "V010", F.lit(True)
        for path, op, than in f.required_if:
            needed = needed & predicate(of(df, path), op, lit(than))
        for path, op, than in f.required_unless:
            needed = needed & ~predicate(of(df, path), op, lit(than))
    out = [(needed & null & F.lit(not f.computed), _violation(f.path, code, "non-null value", F.lit("null")))]
    good = ~null & _type_good(v, f.type)
    out.append((~null & ~_type_good(v, f.type), _violation(f.path, "V002", f.type, shown)))
    if f.places is not None:
        raw = v.col.cast("string") if v.is_number else shown
        places = F.lit(v.type.scale) if isinstance(v.type, T.DecimalType) else F.when(raw.contains("."), F.length(F.substring_index(raw, ".", -1))).otherwise(F.lit(0))
        out.append((good & (places != f.places), _violation(f.path, "V003", f.places, places)))
    if f.least is not None or f.most is not None:
        out.append((good & ~_bounds(v, f), _violation(f.path, "V003", f"min={f.least}, max={f.most}", shown)))
    if f.pattern is not None and safe_pattern(f.pattern):
        out.append((good & ~shown.rlike(f.pattern.replace("(?P<", "(?<")), _violation(f.path, "V004", f.pattern, shown)))
    if f.format is not None:
        out.append((good & ~passes(shown, f.format), _violation(f.path, "V004", f.format, shown)))
    if f.enum is not None:
        out.append((good & ~shown.isin(*f.enum), _violation(f.path, "V005", ",".join(f.enum), shown)))
    if f.deprecated:
        out.append((~null, _violation(f.path, "W001", None, shown)))
    return out


# Invariants -------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(\d+(?:\.\d+)?)|\"([^\"]*)\"|'([^']*)'|([A-Za-z_][\w.]*)|(\|\||&&|==|!=|>=|<=|[=<>+\-*/%!()]))")


class Invariant:
    """An invariant as columns: whether it applies, whether an operand is null, and whether it holds.

    Precedence from loose to tight: ``||``, ``&&``, equality, order, sum, product, ``!``.
    """

    LEVELS = (("||",), ("&&",), ("==", "!=", "="), (">", "<", ">=", "<="), ("+", "-"), ("*", "/", "%"))

    def __init__(self, text: str, resolve: Callable[[str], Value | None]):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if m is None:
                raise ValueError(f"no invariant: {text}")
            self.tokens.append(next((k, g) for k, g in enumerate(m.groups()) if g is not None))
            at = m.end()
        self.at, self.resolve, self.absent, self.null = 0, resolve, False, F.lit(False)
        self.holds = self._truth(self._level(0))
        if self.at < len(self.tokens):
            raise ValueError(f"no invariant: {text}")

    def _take(self, among: Sequence[str]) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == 4 and self.tokens[self.at][1] in among:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _level(self, n: int) -> Value:
        if n == len(self.LEVELS):
            return self._unary()
        left = self._level(n + 1)
        while op := self._take(self.LEVELS[n]):
            left = self._apply(op, left, self._level(n + 1))
        return left

    def _unary(self) -> Value:
        if self._take("!"):
            return Value(~self._truth(self._unary()), T.BooleanType())
        if self._take("("):
            inner = self._level(0)
            if not self._take(")"):
                raise ValueError("a bracket is open")
            return inner
        if self.at >= len(self.tokens):
            raise ValueError("an operand is missing")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == 0:
            return lit(float(word))
        if kind in (1, 2):
            return lit(word)
        if kind == 3:
            if word in ("true", "false"):
                return lit(word == "true")
            v = self.resolve(word)
            if v is None:
                self.absent = True
                return lit(None)
            self.null = self.null | v.col.isNull()
            return v
        raise ValueError(f"'{word}' stands where an operand should")

    def _truth(self, v: Value) -> Column:
        from quillspark.functions.kernel import truth

        return truth(v)

    def _apply(self, op: str, a: Value, b: Value) -> Value:
        if op in ("||", "&&"):
            x, y = self._truth(a), self._truth(b)
            return Value(x | y if op == "||" else x & y, T.BooleanType())
        x, y = N(a), N(b)
        if op in ("+", "-", "*", "/", "%"):
            out = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y), "%": F.try_mod(x, y)}[op]
            return Value(out, T.DoubleType())
        both = x.isNotNull() & y.isNotNull() if a.is_number or b.is_number else F.lit(False)
        if op in ("==", "=", "!="):
            same = F.when(both, F.abs(x - y) <= EPSILON).otherwise(S(a) == S(b))
            return Value(~same if op == "!=" else same, T.BooleanType())
        test = {">": lambda p, q: p > q, "<": lambda p, q: p < q, ">=": lambda p, q: p >= q - EPSILON, "<=": lambda p, q: p <= q + EPSILON}[op]
        plain = {">": lambda p, q: p > q, "<": lambda p, q: p < q, ">=": lambda p, q: p >= q, "<=": lambda p, q: p <= q}[op]
        return Value(F.coalesce(F.when(both, test(x, y)).otherwise(plain(S(a), S(b))), F.lit(False)), T.BooleanType())


def _has(df: DataFrame, path: str) -> bool:
    first = path.split(".")[0]
    return first in df.columns


def validate(df: DataFrame, key: str, schema: Schema) -> DataFrame:
    """Violation rows (V001-V005, V007 of unique fields, V008-V010, W001)."""
    tests: list[tuple[Column, Column]] = []
    for f in schema.fields:
        tests += field_violations(df, f)
    for text in schema.invariants:
        try:
            rule = Invariant(text, lambda name: of(df, name) if _has(df, name) else None)
        except ValueError:
            tests.append((F.lit(True), _violation("", "V008", f"{text} to be valid", F.lit("parse error"))))
            continue
        if not rule.absent:
            tests.append((rule.null | ~rule.holds, _violation("", "V008", f"{text} to be true", F.when(rule.null, F.lit("null operand")).otherwise(F.lit("false")))))
    for names, least, most in schema.cardinalities:
        present = sum((of(df, n).col.isNotNull().cast("int") for n in names), F.lit(0))
        bad = (present < least) | (present > most if most is not None else F.lit(False))
        tests.append((bad, _violation(",".join(names), "V009", f"{least}..{'' if most is None else most}", present)))
    found = F.array_compact(F.array(*(F.when(bad, what) for bad, what in tests)))
    out = df.select(F.col(key).alias("key"), F.explode(found).alias("v")).select("key", "v.*")
    for f in schema.fields:
        if f.unique and _has(df, f.path):
            out = out.unionByName(unique(df, key, [f.path]))
    return out


def unique(df: DataFrame, key: str, paths: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """V007: rows whose values of the paths were there before, in the order of the key, within a group.

    The first of each value is aggregated, and the others are told by a join, so
    that a frequent value's rows need not meet in one task.
    """
    named = [S(of(df, p)).alias(f"_p{i}") for i, p in enumerate([*within, *paths])]
    known = df.where(" and ".join(f"`{p}` is not null" for p in paths)).select(F.col(key).alias("key"), *named)
    names = [f"_p{i}" for i in range(len(named))]
    firsts = known.groupBy(*names).agg(F.min("key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    again = known.join(firsts, names).where("key != _first")
    return again.select("key", F.lit(",".join(paths)).alias("path"), F.lit("V007").alias("code"), F.lit("unique values").alias("expected"), F.concat_ws("|", *names[len(within) :]).alias("actual"))


def array_unique(df: DataFrame, key: str, path: str, fields: Sequence[str] = ()) -> DataFrame:
    """V007: items that an array holds before, by some of their fields or as a whole; items without such a value are passed over.

    Items are rows here, so that a long array is no long comparison.
    """
    items = df.select(F.col(key).alias("key"), F.posexplode(of(df, path).col).alias("at", "item"))
    named = [F.to_json(F.struct(F.col("item"))) if not isinstance(items.schema["item"].dataType, T.StringType) else F.col("item")] if not fields else [F.col(f"item.`{n}`").cast("string") for n in fields]
    items = items.select("key", "at", *(c.alias(f"_p{i}") for i, c in enumerate(named)), F.col("item").isNotNull().alias("there")).where("there").dropna(subset=[f"_p{i}" for i in range(len(named))])
    names = [f"_p{i}" for i in range(len(named))]
    firsts = items.groupBy("key", *names).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    again = items.join(firsts, ["key", *names]).where("at != _first")
    return again.select("key", F.concat(F.lit(f"{path}["), F.col("at").cast("string"), F.lit("]")).alias("path"), F.lit("V007").alias("code"), F.lit(f"unique {', '.join(fields) or 'items'}").alias("expected"), F.concat_ws("|", *names).alias("actual"))


def array_size(df: DataFrame, key: str, path: str, least: int | None, most: int | None) -> DataFrame:
    """V006: rows whose array has too few or too many items."""
    n = F.size(F.col(path))
    bad = F.coalesce((n < (least or 0)) | (n > most if most is not None else F.lit(False)), F.lit(False)) & F.col(path).isNotNull()
    return df.where(bad).select(F.col(key).alias("key"), F.lit(path).alias("path"), F.lit("V006").alias("code"), F.lit(f"{least}..{most}").alias("expected"), n.cast("string").alias("actual"))


def references(df: DataFrame, key: str, path: str, other: DataFrame, other_key: str) -> DataFrame:
    """V013: rows whose value isn't a key of the other table."""
    keys = other.select(S(of(other, other_key)).alias("_k")).distinct()
    lost = df.where(F.col(path).isNotNull()).withColumn("_k", S(of(df, path))).join(keys, "_k", "left_anti")
    return lost.select(F.col(key).alias("key"), F.lit(path).alias("path"), F.lit("V013").alias("code"), F.lit("a known key").alias("expected"), F.col("_k").alias("actual"))


def unknown_fields(df: DataFrame, schema: Schema) -> list[str]:
    """Columns that the schema doesn't name; of a typed table they are known without reading it."""
    named = {f.path.split(".")[0] for f in schema.fields}
    return [c for c in df.columns if c not in named]


def unknown_values(df: DataFrame, key: str, schema: Schema) -> DataFrame:
    """V011: rows with a value in a column, other than the key, that the schema doesn't name."""
    found = [F.when(F.col(f"`{c}`").isNotNull(), _violation(c, "V011", "a known field", of(df, c).col)) for c in unknown_fields(df, schema) if c != key]
    rows = F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<path: string, code: string, expected: string, actual: string>>")
    return df.select(F.col(key).alias("key"), F.explode(rows).alias("v")).select("key", "v.*")


def unknown_paths(paths: DataFrame, schema: Schema, arrays: Sequence[str] = ()) -> DataFrame:
    """V011: paths of a path table that the schema doesn't name; an item's place counts as ``[]``, and ``arrays`` are open below.

    The schema's names are constants of the plan, so nothing is joined.
    """
    bare = F.regexp_replace("path", r"\[\d+\]", "[]")
    known = bare.isin(*(f.path for f in schema.fields)) if schema.fields else F.lit(False)
    for name in arrays:
        known = known | (bare == name) | bare.startswith(f"{name}[]")
    return paths.where(~known).select(F.col("doc_id").alias("key"), "path", F.lit("V011").alias("code"), F.lit("a known field").alias("expected"), F.col("value").cast("string").alias("actual"))
