"""Aggregating verbs over array columns, or over their arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.arrays import _test, item, known, member
from quillspark.functions.financial import mean, numbers, total
from quillspark.functions.kernel import LONG, N, Value, Z, array, constant, double, integer, unify
from quillspark.functions.registry import null, verb


def _items(args) -> Value:
    """The one array, or the arguments as an array."""
    if len(args) == 1 and args[0].is_array:
        return args[0]
    cols, kind = unify(*args)
    return array(F.array(*cols), kind)


@verb("sum", least=0)
def sum_(*args):
    return double(total(numbers(_items(args))))


@verb("count", least=0)
def count(*args):
    if len(args) == 1 and args[0].is_array:
        return integer(F.size(F.filter(known(args[0]), lambda x: x.isNotNull())))
    return integer(F.lit(len(args)))


@verb("min")
def min_(*args):
    return double(F.array_min(numbers(_items(args))))


@verb("max")
def max_(*args):
    return double(F.array_max(numbers(_items(args))))


@verb("avg")
def avg(*args):
    return double(mean(numbers(_items(args))))


@verb("first")
def first(*args):
    v = _items(args)
    return Value(F.get(v.col, F.lit(0)), v.item)


@verb("last")
def last(*args):
    v = _items(args)
    return Value(F.try_element_at(v.col, F.lit(-1)), v.item)


@verb("countIf", least=4)
def count_if(v, path, op, than):
    return integer(F.size(F.filter(known(v), _test(v, path, op, than)))) if v.is_array else null(LONG)


def _chosen(v, path, op, than, of):
    xs = F.filter(known(v), _test(v, path, op, than))
    return F.transform(xs, lambda x: Z(member(item(v, x), of if of is not None else path)))


@verb("sumIf", least=4)
def sum_if(v, path, op, than, of=None):
    return double(total(_chosen(v, path, op, than, of)))


@verb("avgIf", least=4)
def avg_if(v, path, op, than, of=None):
    return double(mean(_chosen(v, path, op, than, of)))


#: The accumulator's operations as folds: start and step over doubles.
FOLDS = {
    "sum": lambda a, x: F.coalesce(a, F.lit(0.0)) + Z(x),
    "count": lambda a, x: F.coalesce(a, F.lit(0.0)) + 1,
    "min": lambda a, x: F.least(a, N(x)),
    "max": lambda a, x: F.greatest(a, N(x)),
}


@verb("accumulate", least=2)
def accumulate(state, *args):
    """One step: the state after a value is added by an operation (``sum`` unless it is named). Plans run it along rows."""
    op = str(constant(args[0], "sum")) if len(args) > 1 else "sum"
    x = args[-1]
    if op == "first":
        cols, kind = unify(state, x)
        return Value(F.coalesce(*cols), kind)
    if op == "last":
        return x
    if op == "concat":
        from quillspark.functions.kernel import S, text

        return text(F.concat(S(state), S(x)))
    return double(FOLDS.get(op, FOLDS["sum"])(N(state) if not state.is_null else F.lit(None).cast("double"), x))


@verb("set", least=2)
def set_(state, x):
    return x
