"""The plan of a transform: segments of mappings over expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from quillspark.functions.logic import Table


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Copy:
    """A path: ``name.x`` from the source, ``.x`` from the item, ``alias.x``, ``$const.x``, ``$accumulator.x``, ``_index``, ``_length``, ``_item``."""

    path: str


@dataclass(frozen=True)
class Call:
    verb: str
    args: Sequence["Expression"] = ()


@dataclass(frozen=True)
class Object:
    fields: Sequence[tuple[str, "Expression"]]


@dataclass(frozen=True)
class Template:
    """Text with expressions in it."""

    parts: Sequence["str | Expression"]


Expression = Literal | Copy | Call | Object | Template


@dataclass(frozen=True)
class Condition:
    """A verb's truth, a path's truth, or ``path operator literal``."""

    left: Expression
    op: str | None = None
    right: object = None


@dataclass(frozen=True)
class Loop:
    path: str
    alias: str | None = None


@dataclass(frozen=True)
class Mapping:
    """A target, where its value comes from, and directives (``type``, ``default``, ``upper``, ``required``, ...)."""

    target: str
    value: Expression
    when: Condition | None = None
    unless: Condition | None = None
    directives: dict[str, str] = field(default_factory=dict)
    confidential: bool = False


@dataclass(frozen=True)
class Segment:
    """``branch`` is "", "if", "elif" or "else"; a name from ``_`` on is computed and not returned.

    Segments of one name with an ``index`` are items of one array.  ``record`` is the
    type of the records that a segment is for, where records are routed; ``literal``
    is a block of text whose lines are the segment's rows.
    """

    name: str
    mappings: Sequence[Mapping] = ()
    loops: Sequence[Loop] = ()
    condition: Condition | None = None
    branch: str = ""
    counter: str | None = None
    number: int | None = None
    array: bool = False
    index: int | None = None
    record: str | None = None
    literal: Template | Literal | None = None


@dataclass(frozen=True)
class Accumulator:
    start: object = None
    persist: bool = False


@dataclass
class Transform:
    segments: list[Segment] = field(default_factory=list)
    constants: dict[str, object] = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)
    accumulators: dict[str, Accumulator] = field(default_factory=dict)
    meta: dict[str, str] = field(default_factory=dict)
    confidential: str = ""  # "", "redact" or "mask"
    strict: bool = False
    imports: list[str] = field(default_factory=list)

    def with_imports(self, read: Callable[[str], str | None], parse: Callable[[str], "Transform"]) -> "Transform":
        """The plan with what its imports name, each once: tables, constants, accumulators and named segments.

        What the plan has itself wins; an import for which ``read`` gives None is passed over.
        """
        out = Transform(list(self.segments), dict(self.constants), dict(self.tables), dict(self.accumulators), dict(self.meta), self.confidential, self.strict)
        names = {s.name for s in out.segments}
        for path in dict.fromkeys(self.imports):
            if (found := read(path)) is None:
                continue
            other = parse(found)
            out.tables = other.tables | out.tables
            out.constants = other.constants | out.constants
            out.accumulators = other.accumulators | out.accumulators
            more = [s for s in other.segments if s.name and s.name not in names]
            out.segments += more
            names |= {s.name for s in more}
        return out

    def ordered(self) -> list[Segment]:
        """Segments by pass: numbered passes going up, then those without one."""
        return sorted(self.segments, key=lambda s: (s.number in (None, 0), s.number or 0))
