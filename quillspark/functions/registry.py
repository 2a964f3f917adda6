"""Verbs by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import Value, lit

#: Name to (least number of arguments, builder).
VERBS: dict[str, tuple[int, Callable[..., Value]]] = {}


class UnknownVerb(KeyError):
    """T001: no verb of this name."""


def verb(*names: str, least: int = 1):
    """Registers a builder, which gets :class:`Value` arguments; with fewer than ``least`` the verb is null."""

    def add(build: Callable[..., Value]) -> Callable[..., Value]:
        for name in names:
            VERBS[name] = (least, build)
        return build

    return add


def call(name: str, *args) -> Value:
    """The verb's value; Python arguments become literals."""
    if name.startswith("&"):  # a custom verb that nobody registered gives back its first argument
        found = VERBS.get(name)
        if found is None:
            return as_value(args[0]) if args else null()
    elif name not in VERBS:
        raise UnknownVerb(f"T001: unknown verb '{name}'")
    least, build = VERBS[name]
    if len(args) < least:
        return null()
    return build(*map(as_value, args))


def as_value(x) -> Value:
    return x if isinstance(x, Value) else lit(x)


def null(kind: T.DataType | None = None) -> Value:
    kind = kind or T.StringType()
    return Value(F.lit(None).cast(kind), kind, None)


def register_verb(name: str, build: Callable[..., Value], least: int = 0) -> None:
    """Adds a custom verb: a function from values to a value."""
    VERBS[name] = (least, build)
