"""Plans as DataFrames: every row of the source is a document.

Each segment becomes one DataFrame with the documents' key.  Loops explode arrays
(nested ones one after the other, with the places of all levels), branches and
filters are predicates, lookups are maps of constants, and accumulators are running
aggregates within a document, in the order of the loop.  Nothing is evaluated row by
row in Python, and Spark optimises the whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field as dataclass_field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.functions.kernel import N, S, Value, constant, field, lit, predicate, shown, text, truth, unify
from quillspark.functions.logic import table_lookup
from quillspark.functions.objects import struct
from quillspark.functions.registry import UnknownVerb, call, null
from quillspark.plans.ir import Call, Condition, Copy, Expression, Literal, Mapping, Object, Segment, Template, Transform
from quillspark.session import checkpointed

DEEPEST, MOST_LOOPS = 32, 10
#: The greatest whole number that an accumulator may reach.
MOST = 9007199254740991
#: Codes of errors that no policy lets pass.
GUARDS = ("T016", "T017", "T018")
RECORD = "_record_type"
TYPES = ("string", "integer", "number", "currency", "percent", "boolean", "date", "time", "timestamp", "duration", "reference", "binary")
#: Under strict types these verbs take numbers only.
NUMERIC = frozenset("abs round floor ceil trunc sign negate sqrt exp add subtract multiply divide mod pow log clamp".split())


class PlanError(ValueError):
    """The plan can't be compiled; the message begins with a code."""


@dataclass
class Result:
    """Segments by name; errors and warnings: ``key, segment, path, code, message``; accumulators at the end of a stream."""

    segments: dict[str, DataFrame]
    errors: DataFrame | None
    arrays: set[str] = dataclass_field(default_factory=set)
    warnings: DataFrame | None = None
    state: DataFrame | None = None

    def documents(self, source: DataFrame, key: str) -> DataFrame:
        """One row a document: a struct for each segment, an array of structs for each that loops.

        A document's rows of a loop become one value; keep to :attr:`segments` where they are many.
        """
        out = source.select(key)
        for name, df in self.segments.items():
            cols = [c for c in df.columns if c != key and not c.startswith("_at")]
            made = F.struct(*(F.col(f"`{c}`").alias(c) for c in cols))
            if name in self.arrays:
                at = [c for c in df.columns if c.startswith("_at")]
                rows = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*at).alias("at"), made.alias("x")))), lambda e: e["x"]).alias(name or "root"))
            else:
                rows = df.select(key, made.alias(name or "root"))
            out = out.join(rows, key, "left")
        return out


class _Scope:
    """What paths mean at a place of the plan."""

    def __init__(self, df: DataFrame, plan: Transform):
        self.plan = plan
        self.source = {f.name: Value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
        self.item: Value | None = None
        self.names: dict[str, Value] = {}
        self.outputs: dict[str, Value] = {}
        self.state: dict[str, Value] = {}

    def resolve(self, path: str) -> Value:
        p = path.lstrip("@")
        if p in ("", "_item"):
            return self.item or null()
        if p.startswith("."):
            return _walk(self.item, p[1:]) if self.item is not None else null()
        if p.startswith("$const"):
            return lit(self.plan.constants.get(p.split(".", 1)[1]))
        if p.startswith("$accumulator"):
            return self.state.get(p.split(".", 1)[1]) or null()
        first, rest = re.match(r"([^.\[]+)(.*)$", p).groups()
        for among in (self.names, self.source, self.outputs):
            if first in among:
                return _walk(among[first], rest)
        return null()


def _walk(v: Value, path: str) -> Value:
    for name, place in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path):
        if place:
            v = Value(F.get(v.col, F.lit(int(place))), v.item) if v.is_array else null()
        elif v.is_array and name.isdigit():
            v = Value(F.get(v.col, F.lit(int(name))), v.item)
        else:
            v = field(v, name)
    return v


@dataclass(frozen=True)
class Stream:
    """Records in an order, whose accumulators go on from record to record.

    With ``by``, each group of records is a stream by itself and is taken by one task;
    without, the one stream is dealt by ranges of the order.
    """

    order: tuple[str, ...]
    by: tuple[str, ...] = ()


def _policy(plan: Transform, name: str, default: str) -> str:
    found = plan.meta.get(f"target.{name}", plan.meta.get(name, default))
    if found not in ("fail", "warn", "skip", "default", ""):
        raise PlanError(f"CONFIG_ERROR: {name} is fail, warn or skip, not {found}")
    return found


def _problem(bad: Column, path: str, code: str, message: str | Column) -> Column:
    return F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(code).alias("code"), (message if isinstance(message, Column) else F.lit(message)).alias("message")))


class _Compiler:
    def __init__(self, plan: Transform, df: DataFrame, key: str, stream: Stream | None = None):
        self.plan, self.df, self.key, self.stream = plan, df, key, stream
        self.errors: list[DataFrame] = []
        self.warnings: list[DataFrame] = []
        self.on_error, self.on_missing, self.on_validation = _policy(plan, "onError", ""), _policy(plan, "onMissing", ""), _policy(plan, "onValidation", "fail")

    def value(self, e: Expression, scope: _Scope, depth: int = 0) -> Value:
        if depth > DEEPEST:
            raise PlanError(f"T018: expressions deeper than {DEEPEST}")
        if isinstance(e, Literal):
            return lit(e.value)
        if isinstance(e, Copy):
            return scope.resolve(e.path)
        if isinstance(e, Object):
            return struct([(n, self.value(x, scope, depth + 1)) for n, x in e.fields])
        if isinstance(e, Template):
            return text(F.concat(F.lit(""), *(F.lit(p) if isinstance(p, str) else S(self.value(p, scope, depth + 1)) for p in e.parts)))
        if e.verb in ("lookup", "lookupDefault") and e.args:
            path = e.args[0].path if isinstance(e.args[0], Copy) else str(e.args[0].value)
            keys = [self.value(a, scope, depth + 1) for a in e.args[1:]]
            default = keys.pop() if e.verb == "lookupDefault" and keys else None
            table = self.plan.tables.get(path.rpartition(".")[0])
            found = table_lookup(table, path, keys) if table else null()
            if default is None:
                return found
            cols, kind = unify(found, default)
            return Value(F.coalesce(*cols), kind)
        args = [self.value(a, scope, depth + 1) for a in e.args]
        if self.plan.strict and e.verb in NUMERIC:
            for v in args:
                if not v.is_number and not v.is_null:
                    raise PlanError(f"T002: '{e.verb}' takes numbers, not {v.type.simpleString()}")
        return call(e.verb, *args)

    def test(self, c: Condition, scope: _Scope) -> Column:
        v = self.value(c.left, scope)
        return truth(v) if c.op is None else predicate(v, c.op, lit(c.right))

    # Directives ----------------------------------------------------------------

    def directed(self, m: Mapping, v: Value) -> Value:
        d = m.directives
        kind = d.get("type") or next((k for k in TYPES if k in d), "")
        if kind and kind not in TYPES:
            raise PlanError(f"CONFIG_ERROR: no type {kind}")
        if "pos" in d:
            v = text(F.substr(shown(v), F.lit(int(d["pos"]) + 1), F.lit(int(d["len"])) if "len" in d else F.length(shown(v))))
        if "field" in d:
            v = text(F.get(F.split(shown(v), ","), F.lit(int(d["field"]))))
        if kind in ("string", "time", "duration", "reference"):
            v = text(shown(v))
        elif kind == "binary":
            v = Value(F.coalesce(F.try_to_binary(shown(v), F.lit("base64")), shown(v).cast("binary")), T.BinaryType())
        elif kind == "integer":
            v = Value(F.floor(N(v)).try_cast("bigint"), T.LongType())
        elif kind in ("number", "percent"):
            v = Value(N(v), T.DoubleType())
        elif kind == "currency":
            places = int(d.get("decimals") or 2)
            v = Value((v.col if v.is_number else N(v)).try_cast(f"decimal(38,{places})"), T.DecimalType(38, places))
        elif kind == "boolean":
            v = call("coerceBoolean", v)
        elif kind == "date":
            v = call("coerceDate", v)
        elif kind == "timestamp":
            v = call("coerceTimestamp", v)
        if "decimals" in d and kind in ("number", "percent"):
            v = call("round", v, int(d["decimals"]))
        if "default" in d:
            cols, t = unify(v, lit(_typed(d["default"], v)))
            v = Value(F.coalesce(*cols), t)
        for name in ("trim", "upper", "lower"):
            if name in d:
                v = call(name, v)
        if "maxLen" in d:
            v = text(F.left(shown(v), F.lit(int(d["maxLen"]))))
        if "raw" in d:
            v = Value(F.coalesce(F.try_parse_json(shown(v)), shown(v).cast("variant")), T.VariantType())
        if "array" in d:
            v = Value(F.array(v.col), T.ArrayType(v.type))
        if m.confidential and self.plan.confidential == "redact":
            v = Value(F.lit(None).cast(v.type), v.type)
        elif m.confidential and self.plan.confidential == "mask":
            v = text(F.repeat(F.lit("*"), F.length(v.col))) if v.is_string else Value(F.lit(None).cast(v.type), v.type)
        return v

    def checked(self, m: Mapping, v: Value, absent: bool) -> tuple[Value, list[Column], list[Column]]:
        """A mapping's value after its checks; errors and warnings as structs that are null where all is well.

        ``onValidation`` says what becomes of a value that fails a check: an error and no
        value (fail), a warning (warn), or no value (skip).  ``onMissing`` does so for a
        source path that isn't there at all; a required value is an error in any case.
        """
        d, errors, warnings = m.directives, [], []
        found: list[tuple[Column, str]] = []
        if "validate" in d:
            found.append((v.col.isNotNull() & ~S(v).rlike(d["validate"]), "the value does not match"))
        if "enum" in d:
            found.append((v.col.isNotNull() & ~S(v).isin(*(x.strip() for x in d["enum"].split(","))), "the value is not among those allowed"))
        if "range" in d:
            lo, hi = d["range"].split("..")
            bad = N(v).isNull()
            if lo:
                bad = bad | (N(v) < float(lo))
            if hi:
                bad = bad | (N(v) > float(hi))
            found.append((v.col.isNotNull() & bad, "the value is out of range"))
        missing = v.col.isNull()
        if found:
            any_bad = F.lit(False)
            for bad, message in found:
                if self.on_validation != "skip":
                    (warnings if self.on_validation == "warn" else errors).append(_problem(bad, m.target, "T013", message))
                any_bad = any_bad | bad
            if self.on_validation != "warn":
                v = Value(F.when(~any_bad, v.col), v.type)
        path = m.value.path.lstrip("@.") if isinstance(m.value, Copy) else m.target
        if "required" in d:
            errors.append(_problem(missing, m.target, *(("T005", f"there is no {path}") if absent else ("SOURCE_MISSING", "a required value is null or missing"))))
        elif absent and self.on_missing in ("fail", "warn"):
            (errors if self.on_missing == "fail" else warnings).append(_problem(missing, m.target, "T005", f"there is no {path}"))
        return v, errors, warnings

    # Segments ------------------------------------------------------------------

    def operation(self, e: Call, scope: _Scope) -> str:
        return "last" if e.verb == "set" else str(constant(self.value(e.args[1], scope), "sum")) if len(e.args) > 2 else "sum"

    def streamed(self, df: DataFrame, root: _Scope, applying: list[tuple[Segment, Column]]) -> tuple[DataFrame, DataFrame | None]:
        """The records with a column for each accumulator that mappings outside of loops feed: its value after the record.

        All that feed one accumulator must do so by the same operation.  Without groups the
        stream is dealt by ranges, each of which goes on from the totals of those before it.
        """
        fed: dict[str, tuple[str, list[Value]]] = {}
        for seg, applies in applying:
            if seg.loops:
                continue
            scope = _Scope(df, self.plan)
            scope.state, scope.source = dict(root.state), dict(root.source)
            for m in seg.mappings:
                if not _stateful(m.value):
                    scope.outputs[m.target] = self.value(m.value, scope)
                    continue
                name = m.value.args[0].value if isinstance(m.value.args[0], Literal) else m.value.args[0].path
                op, x = self.operation(m.value, scope), self.value(m.value.args[-1], scope)
                here = F.coalesce(applies & (F.col(RECORD) == seg.record if seg.record is not None else F.lit(True)), F.lit(False))
                if m.when is not None:
                    here = here & self.test(m.when, scope)
                if m.unless is not None:
                    here = here & ~self.test(m.unless, scope)
                if fed.setdefault(name, (op, []))[0] != op:
                    raise PlanError(f"CONFIG_ERROR: '{name}' is fed by {op} and by {fed[name][0]}")
                kind = x.type if op in ("first", "last") else T.StringType() if op == "concat" else T.DoubleType()
                fed[name][1].append(Value(F.when(here, F.lit(1.0) if op == "count" else x.col if op in ("first", "last") else S(x) if op == "concat" else N(x)), kind))
        if not fed:
            return df, None
        order, by = self.stream.order, list(self.stream.by)
        df = df.withColumns({f"_fed_{n}_{i}": x.col for n, (_, xs) in fed.items() for i, x in enumerate(xs)})
        if not by:
            df = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
        part = by or ["_range"]
        running = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        folds: dict[str, tuple] = {}
        for n, (op, xs) in fed.items():
            own = [F.col(f"`_fed_{n}_{i}`") for i in range(len(xs))]
            if op == "concat":
                if not by:
                    raise PlanError("CONFIG_ERROR: a stream without groups can't be joined into one text")
                one = F.concat_ws("", *own)
                folds[n] = (one, lambda c, w: F.array_join(F.collect_list(c).over(w) if w is not None else F.collect_list(c), ""), lambda a, b: F.concat(F.coalesce(a, F.lit("")), b))
            elif op in ("min", "max"):
                pick, fold = (F.least, F.min) if op == "min" else (F.greatest, F.max)
                folds[n] = (pick(*own) if len(own) > 1 else own[0], lambda c, w, fold=fold: fold(c).over(w) if w is not None else fold(c), lambda a, b, pick=pick: pick(a, b))
            elif op in ("first", "last"):
                one, place = F.coalesce(*(own if op == "first" else own[::-1])), F.struct(*order)
                fold = F.min_by if op == "first" else F.max_by
                at = F.when(one.isNotNull(), place)
                folds[n] = (one, lambda c, w, fold=fold, at=at: fold(c, at).over(w) if w is not None else fold(c, at), (lambda a, b: F.coalesce(a, b)) if op == "first" else (lambda a, b: F.coalesce(b, a)))
            else:
                one = own[0] if len(own) == 1 else sum((F.coalesce(c, F.lit(0.0)) for c in own[1:]), F.coalesce(own[0], F.lit(0.0)))
                folds[n] = (one, lambda c, w: F.coalesce(F.sum(c).over(w) if w is not None else F.sum(c), F.lit(0.0)), lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))
        starts = {n: (lambda v, op=op: N(v) if op not in ("first", "last", "concat") else v.col if op != "concat" else S(v))(root.state.get(n) or lit(None)) for n, (op, _) in fed.items()}
        totals = df.groupBy(*part).agg(*(f(c, None).alias(f"_all_{n}") for n, (c, f, _) in folds.items()))
        df = df.withColumns({f"_run_{n}": f(c, running) for n, (c, f, _) in folds.items()})
        if not by:
            # A row a range: what the ranges before it come to.
            before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
            sums = {}
            for n, (op, _) in fed.items():
                c = F.col(f"_all_{n}")
                sums[f"_past_{n}"] = {"min": F.min(c), "max": F.max(c), "first": F.first(c, True), "last": F.last(c, True)}.get(op, F.sum(c)).over(before)
            past = totals.withColumns(sums).select("_range", *sums)
            df = df.join(F.broadcast(past), "_range")
            whole = {n: {"min": F.min, "max": F.max}.get(op) for n, (op, _) in fed.items()}
            ends = [(F.min_by(f"_all_{n}", F.when(F.col(f"_all_{n}").isNotNull(), F.col("_range"))) if op == "first" else F.max_by(f"_all_{n}", F.when(F.col(f"_all_{n}").isNotNull(), F.col("_range"))) if op == "last" else (whole[n] or F.sum)(f"_all_{n}")).alias(f"_all_{n}") for n, (op, _) in fed.items()]
            totals = totals.agg(*ends)
        state = totals.select(*by, *(folds[n][2](starts[n], F.col(f"_all_{n}")).alias(n) for n in fed))
        for n, (op, xs) in fed.items():
            combine = folds[n][2]
            after = F.col(f"`_run_{n}`") if by else combine(F.col(f"`_past_{n}`"), F.col(f"`_run_{n}`"))
            df = df.withColumn(f"_state_{n}", combine(starts[n], after))
            root.state[n] = Value(F.col(f"`_state_{n}`"), xs[0].type)
        return df, state

    def accumulated(self, e: Call, scope: _Scope, at: list[str]) -> tuple[str, Value, Value]:
        """An accumulator's name, its value after each row, and its value in the end."""
        name = e.args[0].value if isinstance(e.args[0], Literal) else e.args[0].path
        start = scope.state.get(name) or lit(None)
        op = self.operation(e, scope)
        x = self.value(e.args[-1], scope)
        if not at and self.stream is not None:
            return name, start, start  # after the record, see streamed()
        if not at:
            after = x if op == "last" else call("accumulate", start, op, x)
            return name, after, after
        w = Window.partitionBy(self.key).orderBy(*at)
        running, all_ = w.rowsBetween(Window.unboundedPreceding, 0), None
        n, s = N(x), N(start)

        def over(last: bool):
            frame = running if not last else all_
            fold = lambda c: c.over(frame) if frame is not None else c
            order = F.struct(*at)
            if op == "count":
                return fold(F.count(F.lit(1))).cast("double") + F.coalesce(_const(s, last), F.lit(0.0))
            if op in ("min", "max"):
                return (F.least if op == "min" else F.greatest)(fold(getattr(F, op)(n)), _const(s, last))
            if op == "first":
                return F.coalesce(_const(start.col, last), fold(F.min_by(x.col, order)))
            if op == "last":
                return fold(F.max_by(x.col, order))
            if op == "concat":
                items = fold(F.collect_list(F.struct(order.alias("o"), S(x).alias("x"))))
                return F.concat(F.coalesce(_const(S(start), last), F.lit("")), F.array_join(F.transform(F.array_sort(items), lambda i: i["x"]), ""))
            return F.coalesce(fold(F.sum(n)), F.lit(0.0)) + F.coalesce(_const(s, last), F.lit(0.0))

        kind = x.type if op in ("first", "last") else T.StringType() if op == "concat" else T.DoubleType()
        return name, Value(over(False), kind), Value(over(True), kind)

    def run(self) -> Result:
        df, key, plan = self.df, self.key, self.plan
        root = _Scope(df, plan)
        root.state = {n: lit(a.start) for n, a in plan.accumulators.items()}
        out: dict[str, DataFrame] = {}
        arrays: set[str] = set()
        state = None
        if self.stream is not None:
            if len({seg.number for seg in plan.segments}) > 1:
                raise PlanError("CONFIG_ERROR: records in a stream are read in one pass")
            df, state = self.streamed(df, root, list(self.applying(root)))
        last_pass: object = object()
        for seg, applies in self.applying(root):
            if seg.number != last_pass and self.stream is None:
                last_pass = seg.number
                for n, a in plan.accumulators.items():
                    if not a.persist:
                        root.state[n] = lit(a.start)
            name, made, finals, names, is_array = self.segment(seg, root, df, applies)
            if not name.startswith("_"):
                out[name] = out[name].unionByName(made, allowMissingColumns=True) if name in out else made
                if is_array:
                    arrays.add(name)
            if finals is not None:
                # An accumulator's last value becomes a column of its document.
                df = df.join(finals, key, "left")
                for n, a in zip([c for c in finals.columns if c != key], names):
                    kind = finals.schema[n].dataType
                    old = root.state[a] if a in root.state else null()
                    cols, t = unify(Value(F.col(n), kind), old)
                    root.state[a] = Value(F.coalesce(*cols), t)
        return Result(out, _together(self.errors), arrays, _together(self.warnings), state)

    def applying(self, root: _Scope):
        """Segments in order, and where each applies."""
        taken: Column | None = None
        for seg in self.plan.ordered():
            applies = F.lit(True)
            if seg.branch:
                if seg.branch == "if":
                    taken = F.lit(False)
                elif taken is None:
                    raise PlanError(f"T012: '{seg.name}' goes on a chain that nothing begins")
                own = self.test(seg.condition, root) if seg.condition is not None else F.lit(True)
                applies, taken = own & ~taken, taken | own
            else:
                taken = None
                if seg.condition is not None:
                    applies = self.test(seg.condition, root)
            yield seg, applies

    def segment(self, seg: Segment, root: _Scope, df: DataFrame, applies: Column):
        key = self.key
        scope = _Scope(df, self.plan)
        scope.state, scope.source = dict(root.state), dict(root.source)
        rows = df.where(applies)
        if seg.record is not None:
            if RECORD not in df.columns:
                raise PlanError(f"CONFIG_ERROR: '{seg.name}' is for records of a type; run it by run_records()")
            rows = rows.where(F.col(RECORD) == seg.record)
        at: list[str] = []
        if len(seg.loops) > MOST_LOOPS:
            raise PlanError(f"T009: more than {MOST_LOOPS} loops in one another")
        for i, loop in enumerate(seg.loops):
            v = scope.resolve(loop.path)
            if v.is_null:
                v = Value(F.array().cast("array<string>"), T.ArrayType(T.StringType()))
            elif not v.is_array:
                if i:
                    raise PlanError(f"T009: '{loop.path}' is no array")
                v = Value(F.when(v.col.isNull(), F.array().cast(T.ArrayType(v.type))).otherwise(F.array(v.col)), T.ArrayType(v.type))
            place, item = f"_at{i}", f"_item{i}"
            rows = rows.select("*", F.size(v.col).alias(f"_size{i}"), F.posexplode(v.col).alias(place, item))
            at.append(place)
            scope.item = Value(F.col(item), v.item)
            if loop.alias:
                scope.names[loop.alias] = scope.item
            scope.names["_index"], scope.names["_length"] = Value(F.col(place).cast("bigint"), T.LongType()), Value(F.col(f"_size{i}").cast("bigint"), T.LongType())
            if seg.counter:
                scope.names[seg.counter] = scope.names["_index"]
        if seg.literal is not None:
            said = rows.select(key, *at, F.posexplode(F.split(S(self.value(seg.literal, scope)), "\n")).alias(f"_at{len(at)}", "line"))
            return seg.name, said, None, [], True
        targets: dict[str, Value] = {}
        notes_of: dict[str, dict] = {}
        finals: list[tuple[str, Value]] = []
        problems: list[Column] = []
        warnings: list[Column] = []
        for m in seg.mappings:
            absent, over = False, None
            try:
                if _stateful(m.value):
                    name, v, final = self.accumulated(m.value, scope, at)
                    if at or self.stream is None:
                        finals.append((name, final))
                    if at:
                        rows, v = rows.withColumn(f"_run{len(finals)}", v.col), Value(F.col(f"_run{len(finals)}"), v.type)
                    scope.state[name] = v
                    if isinstance(v.type, T.DoubleType):
                        over = F.coalesce((F.abs(v.col) > MOST) | F.isnan(v.col), F.lit(False))
                        v = Value(F.when(~over, v.col), v.type)
                else:
                    v = self.value(m.value, scope)
                    absent = isinstance(m.value, Copy) and v.is_null and not m.value.path.startswith(("$", "@$"))
                v = self.directed(m, v)
            except (PlanError, UnknownVerb) as e:
                code = found_[0] if (found_ := re.search(r"T\d{3}", str(e))) else ""
                if not self.on_error or code in GUARDS:
                    raise
                if self.on_error != "skip":
                    (warnings if self.on_error == "warn" else problems).append(_problem(F.lit(True), m.target, code, str(e)))
                continue
            if over is not None and self.on_error != "skip":
                (warnings if self.on_error == "warn" else problems).append(_problem(over, m.target, "T008", "the accumulator overflows"))
            # Conditions of mappings in loops are about the document, not the item.
            for c, keep in ((m.when, True), (m.unless, False)):
                if c is not None:
                    test = self.test(c, root if at else scope)
                    v = Value(F.when(test if keep else ~test, v.col), v.type)
            v, errors, notes = self.checked(m, v, absent)
            problems += errors
            warnings += notes
            scope.outputs[m.target] = v
            if not m.target.startswith("_"):
                targets[m.target] = v
                if "currencyCode" in m.directives:
                    notes_of[m.target] = {"currency_code": m.directives["currencyCode"].upper()}
        values = [scope.outputs["_"]] if not targets and "_" in scope.outputs and not finals else None
        cols = [v.col.alias(n, metadata=notes_of[n]) if n in notes_of else v.col.alias(n) for n, v in targets.items()] if values is None else [values[0].col.alias("value")]
        place = [F.lit(seg.index or 0).alias("_at0")] if seg.array and not at else []
        made = rows.select(key, *at, *place, *cols)
        for said, kept in ((problems, self.errors), (warnings, self.warnings)):
            if said:
                found = rows.select(F.col(key).alias("key"), F.explode(F.array_compact(F.array(*said))).alias("p"))
                kept.append(found.select("key", F.lit(seg.name).alias("segment"), "p.*"))
        last = None
        if finals:
            if at:
                last = rows.groupBy(key).agg(*(v.col.alias(f"_acc_{n}_{seg.name}{i}") for i, (n, v) in enumerate(finals)))
            else:
                last = rows.select(key, *(v.col.alias(f"_acc_{n}_{seg.name}{i}") for i, (n, v) in enumerate(finals)))
        return seg.name, made, last, [n for n, _ in finals], bool(at) or seg.array


def _stateful(e: Expression) -> bool:
    return isinstance(e, Call) and e.verb in ("accumulate", "set") and len(e.args) > 1


def _together(found: list[DataFrame]) -> DataFrame | None:
    out = None
    for df in found:
        out = df if out is None else out.unionByName(df)
    return out


def run_records(plan: Transform, df: DataFrame, key: str, line: str, stream: Stream | None = None) -> Result:
    """Runs a plan over raw records, a line each, each segment over the records of its type.

    With a ``stream``, accumulators go on from record to record in its order, whatever
    segment feeds or reads them.

    The plan's ``source.discriminator`` tells the type: ``:pos 0 :len 2``, ``:field 0``,
    or a path into JSON.  Segments see the record as ``_raw`` and ``_line``, and what
    stands between its commas as ``0``, ``1`` and so on.  Records of no segment's type
    are errors.
    """
    from quillspark.sources.readers import discriminator

    how = plan.meta.get("source.discriminator", "")
    number = lambda name: int(m[1]) if (m := re.search(rf":{name}\s+#*(\d+)", how)) else None
    if number("field") is not None:
        kind = discriminator(line, "field", index=number("field"))
    elif number("pos") is not None:
        kind = discriminator(line, "position", number("pos"), number("len") or 1)
    else:
        kind = discriminator(line, "path", path=how.strip("@\" "))
    used = [int(n) for n in re.findall(r"Copy\(path='@?(\d+)'\)", repr(plan.segments))]
    cells = {str(i): F.get(F.split(line, ","), F.lit(i)) for i in range(max(used, default=-1) + 1)}
    records = df.withColumns({RECORD: kind, "_raw": F.col(line), "_line": F.col(line), **cells})
    out = run(plan, records, key, stream)
    known = [s.record for s in plan.segments if s.record is not None]
    lost = records.where(~F.col(RECORD).isin(*known) if known else F.lit(True)).select(F.col(key).alias("key"), F.lit("").alias("segment"), F.lit("").alias("path"), F.lit("UNKNOWN_RECORD_TYPE").alias("code"), F.concat(F.lit("no segment is for records of type "), RECORD).alias("message"))
    out.errors = lost if out.errors is None else out.errors.unionByName(lost)
    return out


def _const(col: Column, last: bool) -> Column:
    """A document's own value beside aggregates: the same on all its rows."""
    return F.first(col) if last else col


def _typed(word: str, v: Value) -> object:
    if v.is_number:
        try:
            return float(word)
        except ValueError:
            return word
    return word


def run(plan: Transform, df: DataFrame, key: str, stream: Stream | None = None) -> Result:
    """Runs a plan over documents, the rows of ``df``, told apart by ``key``.

    Accumulators begin anew with each document, unless the documents are a ``stream``.
    """
    return _Compiler(plan, df, key, stream).run()


