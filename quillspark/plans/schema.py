"""The text form of schemas: read into rules, written back, and turned into Spark types."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from quillspark.operators.validation import Field, Schema

_KEYWORDS = ("timestamp", "date", "time", "duration", "string", "boolean", "number", "integer")
_PREFIXES = (("##", "integer"), ("#$", "currency"), ("#%", "percent"), ("#", "number"), ("?", "boolean"), ("@", "reference"), ("^", "binary"), ("~", "null"))


class SchemaError(ValueError):
    """V017: the definition contradicts itself."""


@dataclass
class Array:
    """An array of a schema: bounds of its length, whether items are unique, and fields of an item."""

    least: int | None = None
    most: int | None = None
    unique: bool = False
    fields: dict[str, Field] = field(default_factory=dict)
    columns: list[str] = field(default_factory=list)


@dataclass
class Document:
    """A schema's text: fields by path, named types, arrays, rules by section, imports."""

    meta: dict[str, str] = field(default_factory=dict)
    types: dict[str, dict[str, Field]] = field(default_factory=dict)
    fields: dict[str, Field] = field(default_factory=dict)
    arrays: dict[str, Array] = field(default_factory=dict)
    invariants: list[tuple[str, str]] = field(default_factory=list)
    cardinalities: list[tuple[str, tuple[str, ...], int, int | None]] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)

    def rules(self, section: str = "") -> Schema:
        """The rules of a section, for a table whose columns are its fields; without one, of all fields by path."""
        cut = f"{section}." if section else ""
        fields = [_moved(f, p[len(cut) :]) for p, f in self.expanded().items() if p.startswith(cut)]
        invariants = [e for s, e in self.invariants if s == section or not section]
        cards = [(names if section else tuple(f"{s}.{n}" if s else n for n in names), lo, hi) for s, names, lo, hi in self.cardinalities if s == section or not section]
        return Schema(fields, invariants, cards)

    def expanded(self) -> dict[str, Field]:
        """Fields with references to named types replaced by the types' fields; a type within itself stays a reference."""
        out: dict[str, Field] = {}

        def put(path: str, f: Field, above: tuple[str, ...]) -> None:
            names = f.type[1:].split("&") if f.type.startswith("@") and f.type != "@" else []
            names = [n.strip().lstrip("@") for n in names]
            if names and all(n in self.types and n not in above for n in names):
                for n in names:
                    for p, inner in self.types[n].items():
                        put(f"{path}.{p}" if path else p, inner, (*above, n))
            else:
                out[path] = _moved(f, path) if not names else Field(path, "", f.required)

        for path, f in self.fields.items():
            put(path, f, ())
        return out

    def struct(self, section: str = "") -> T.StructType:
        """The Spark type of a section's rows."""
        root: dict = {}
        for f in self.rules(section).fields:
            at, *rest = f.path.split(".")
            node = root
            for part in rest:
                node = node.setdefault(at, {})
                at = part
            node[at] = f
        return _struct(root)


def _moved(f: Field, path: str) -> Field:
    return Field(**{**f.__dict__, "path": path})


def _spark_type(f: Field) -> T.DataType:
    if f.type == "currency":
        return T.DecimalType(38, f.places if f.places is not None else 2)
    if f.type == "number" and f.places is not None:
        return T.DecimalType(38, f.places)
    return {"integer": T.LongType(), "number": T.DoubleType(), "percent": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "union": T.VariantType()}.get(f.type, T.StringType())


def _struct(node: dict) -> T.StructType:
    return T.StructType([T.StructField(n, _struct(x) if isinstance(x, dict) else _spark_type(x), not (isinstance(x, Field) and x.required)) for n, x in node.items()])


def _number(text: str) -> object:
    t = text.strip()
    if not t:
        return None
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return t


def read_field(path: str, text: str) -> Field:
    """A field's definition: modifiers, type, constraints and conditions."""
    t = text.strip()
    mods = re.match(r"[!*~-]*(?=[\s#?@^(\"a-zA-Z:|]|$)", t)[0]
    t = t[len(mods) :].strip()
    out: dict[str, object] = {"required": "!" in mods, "deprecated": "-" in mods}
    kinds: list[str] = []
    while True:
        if t.startswith("("):
            end = t.index(")")
            out["enum"] = tuple(v.strip().strip("\"'") for v in t[1:end].split(","))
            kind, t = "string", t[end + 1 :].strip()
        else:
            prefix = next(((p, k) for p, k in _PREFIXES if t.startswith(p)), None)
            if prefix:
                kind, t = prefix[1], t[len(prefix[0]) :]
                if m := re.match(r"\.(\d)", t) if kind in ("currency", "number") else None:
                    out["places"] = int(m[1])
                    t = t[m.end() :]
                elif kind == "currency":
                    out["places"] = 2
                if kind in ("reference", "binary"):
                    m = re.match(r"[^\s:,)|&]*(?:\s*&\s*@[^\s:,)|&]+)*", t)
                    kind, t = f"@{m[0]}" if kind == "reference" else kind, t[m.end() :]
            else:
                word = next((k for k in _KEYWORDS if re.match(rf"{k}(?=[\s:,)|]|$)", t)), None)
                kind, t = word or "string", t[len(word or "") :]
            t = t.strip()
        kinds.append(kind)
        if not t.startswith("|"):
            break
        t = t[1:].strip()
    out["type"] = kinds[0] if len(kinds) == 1 else "union"
    conditions: dict[str, list] = {"if": [], "unless": []}
    while t.startswith(":"):
        if m := re.match(r":\(([^)]*)\)", t):
            lo, dots, hi = m[1].partition("..")
            out["least"], out["most"] = _number(lo), _number(hi if dots else lo)
        elif m := re.match(r":/((?:[^/\\]|\\.)*)/", t) or re.match(r":pattern[ =]+\"([^\"]*)\"", t):
            out["pattern"] = m[1]
        elif m := re.match(r":format[ =]+([^\s:]+)", t):
            out["format"] = m[1]
        elif m := re.match(r":(if|unless)\s+(\w[\w.]*)\s*(>=|<=|!=|>|<|=)\s*(\S+)", t):
            value = m[4].strip("\"'")
            conditions[m[1]].append((m[2], m[3], {"true": True, "false": False}.get(value, _number(value))))
        elif m := re.match(r":(computed|immutable|unique|override)\b", t):
            out.update({m[1]: True} if m[1] != "immutable" else {})
        else:
            break
        t = t[m.end() :].strip()
    if out.get("least") is not None and out.get("most") is not None and isinstance(out["least"], (int, float)) and isinstance(out["most"], (int, float)) and out["least"] > out["most"]:
        raise SchemaError(f"V017: bounds of '{path}' are the wrong way round")
    return Field(path=path, required_if=tuple(conditions["if"]), required_unless=tuple(conditions["unless"]), **out)


def parse_schema(text: str) -> Document:
    """Reads a schema's text."""
    doc, prefix, absolute, mode, name = Document(), "", "", "object", ""
    for number, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r'^((?:[^";]|"(?:[^"\\]|\\.)*")*);.*$', r"\1", raw).strip()
        if not line:
            continue
        if line.startswith("@import "):
            name_, _, alias = line[8:].partition(" as ")
            doc.imports.append(name_.strip().strip('"'))
            if alias.strip():
                doc.aliases[doc.imports[-1]] = alias.strip()
        elif line.startswith("{"):
            head, _, after = line[1:].partition("}")
            head = head.strip()
            if head == "$":
                mode = "meta"
            elif head.startswith("@"):
                mode, name, prefix = "type", head[1:], ""
                doc.types.setdefault(name, {})
            else:
                mode = "object"
                if head.startswith("."):
                    prefix = f"{absolute}{head}" if absolute else head[1:]
                else:
                    prefix = absolute = head
                if m := re.match(r"(.*?)\[\](?:\s*:\s*(.+))?$", prefix):
                    mode, prefix = "array", m[1]
                    array = doc.arrays.setdefault(prefix, Array())
                    array.columns = [c.strip() for c in (m[2] or "").split(",") if c.strip()]
                    for c in (m[2] or "").split(","):
                        if c.strip():
                            array.fields[c.strip()] = Field(c.strip())
                    _array_rules(array, after)
        elif line.startswith(":"):
            if mode == "array" and re.match(r":\(|:unique\b", line):
                _array_rules(doc.arrays[prefix], line)
            else:
                _object_rule(doc, "" if mode == "meta" else prefix, line)
        elif "=" in line:
            left, _, right = line.partition("=")
            left = left.strip()
            if mode == "meta":
                doc.meta[left] = right.strip().strip('"')
            elif mode == "type":
                doc.types[name][left] = read_field(left, right)
            elif mode == "array":
                doc.arrays[prefix].fields[left] = read_field(left, right)
            else:
                path = f"{prefix}.{left}" if prefix else left
                doc.fields[path] = read_field(path, right)
        else:
            raise SchemaError(f"V017: line {number} is no part of a schema: {raw}")
    return doc


def _array_rules(array: Array, text: str) -> None:
    if m := re.search(r":\((\d*)(?:\.\.(\d*))?\)", text):
        array.least = int(m[1]) if m[1] else None
        array.most = int(m[2]) if m[2] else array.least if m[2] is None else None
    if ":unique" in text:
        array.unique = True


def _object_rule(doc: Document, section: str, line: str) -> None:
    word, _, rest = line[1:].partition(" ")
    names = tuple(n.strip() for n in rest.split(",") if n.strip())
    if word == "invariant":
        doc.invariants.append((section, rest.strip()))
    elif word in ("one_of", "exactly_one", "at_most_one"):
        lo, hi = {"one_of": (1, None), "exactly_one": (1, 1), "at_most_one": (0, 1)}[word]
        doc.cardinalities.append((section, names, lo, hi))
    elif word == "of" and (m := re.match(r"\((\d*)\.\.(\d*)\)\s*(.*)$", rest.strip())):
        doc.cardinalities.append((section, tuple(n.strip() for n in m[3].split(",")), int(m[1] or 0), int(m[2]) if m[2] else None))


def _kind(f: Field) -> str:
    return "reference" if f.type.startswith("@") else "enum" if f.enum else f.type


def _conflicts(at: str, own: dict[str, Field], whole: Field, types: dict[str, dict[str, Field]]) -> list[tuple[str, str]]:
    """What is wrong with fields that override a type's, or with types that are joined into one."""
    names = [n.strip().lstrip("@") for n in whole.type.split("&")]
    out: list[tuple[str, str]] = []
    bound = lambda x: x if isinstance(x, (int, float)) else None
    if whole.override:
        base = {n: f for t in names for n, f in types.get(t, {}).items() if n}
        for n, f in own.items():
            if (old := base.get(n)) is None:
                continue
            if _kind(old) != _kind(f):
                out.append((f"{at}.{n}", f"the type changes from {_kind(old)} to {_kind(f)}"))
            if old.required and not f.required:
                out.append((f"{at}.{n}", "a required field becomes optional"))
            if old.least is not None or old.most is not None:
                lower = bound(old.least) is not None and (bound(f.least) is None or f.least < old.least)
                upper = bound(old.most) is not None and (bound(f.most) is None or f.most > old.most)
                if (f.least is not None or f.most is not None) and (lower or upper):
                    out.append((f"{at}.{n}", "bounds become wider"))
    elif len(names) > 1:
        seen: dict[str, Field] = {}
        for t in names:
            for n, f in types.get(t, {}).items():
                if n and n in seen and _moved(seen[n], "") != _moved(f, ""):
                    out.append((f"{at}.{n}", f"it differs between the types joined, {' and '.join(names)}"))
                elif n:
                    seen.setdefault(n, f)
    return out


def definition_problems(doc: Document) -> list[tuple[str, str]]:
    """V017: path and message for what a schema says against itself: overrides, joined types, columns of tables."""
    out: list[tuple[str, str]] = []
    for name, fields in doc.types.items():
        if "" in fields:
            out += _conflicts(f"@{name}", {n: f for n, f in fields.items() if n}, fields[""], doc.types)
    for path, whole in doc.fields.items():
        if path == "" or path.endswith("."):
            at = path.rstrip(".")
            own = {p[len(at) + 1 :] if at else p: f for p, f in doc.fields.items() if p != path and (not at or p.startswith(f"{at}.")) and "." not in (p[len(at) + 1 :] if at else p)}
            out += _conflicts(at, own, whole, doc.types)
    for path, array in doc.arrays.items():
        for column in array.columns:
            dots, places = column.count("."), len(re.findall(r"\[\d+\]", column))
            f = array.fields.get(re.sub(r"\[\d+\]$", "", column))
            if dots > 1 or places > 1 or dots and places:
                out.append((f"{path}[].{column}", "a column has one level"))
            elif f is not None and f.type.startswith("@"):
                out.append((f"{path}[].{column}", "a column is of a simple type"))
    return out


def write_schema(doc: Document) -> str:
    """A schema's text, that reads into the same."""
    kinds = {"integer": "##", "currency": "#$", "percent": "#%", "number": "#", "boolean": "?", "binary": "^", "null": "~"}

    def line(name: str, f: Field) -> str:
        kind = f"({', '.join(f.enum)})" if f.enum else kinds.get(f.type, f.type)
        if f.places is not None:
            kind += f".{f.places}"
        more = f" :({'' if f.least is None else f.least}..{'' if f.most is None else f.most})" if f.least is not None or f.most is not None else ""
        more += (f" :/{f.pattern}/" if f.pattern else "") + (f" :format {f.format}" if f.format else "")
        more += "".join(f" :{w} {a} {op} {str(v).lower() if isinstance(v, bool) else v}" for w, cs in (("if", f.required_if), ("unless", f.required_unless)) for a, op, v in cs)
        return f"{name} = {'!' * f.required}{'-' * f.deprecated}{kind}{more}{' :computed' * f.computed}{' :unique' * f.unique}{' :override' * f.override}"

    out = [f"@import {i}" + (f" as {doc.aliases[i]}" if i in doc.aliases else "") for i in doc.imports]
    if doc.meta:
        out += ["{$}", *(f'{k} = "{v}"' for k, v in doc.meta.items())]
    for name, fields in doc.types.items():
        out += [f"{{@{name}}}", *(line(p, f) for p, f in fields.items())]
    for path, a in doc.arrays.items():
        bounds = f" :({'' if a.least is None else a.least}..{'' if a.most is None else a.most})" if a.least is not None or a.most is not None else ""
        out += [f"{{{path}[]}}{bounds}{' :unique' * a.unique}", *(line(p, f) for p, f in a.fields.items())]
    sections = list(dict.fromkeys([p.rpartition(".")[0] for p in doc.fields] + [s for s, _ in doc.invariants] + [s for s, *_ in doc.cardinalities]))
    for s in sections:
        out.append(f"{{{s}}}")
        out += [line(p.rpartition(".")[2], f) for p, f in doc.fields.items() if p.rpartition(".")[0] == s]
        out += [f":invariant {e}" for at, e in doc.invariants if at == s]
        out += [f":of ({lo}..{'' if hi is None else hi}) {', '.join(names)}" for at, names, lo, hi in doc.cardinalities if at == s]
    return "\n".join(out) + "\n"


def _loaded(doc: Document, read: Callable[[str], str], most: int, deepest: int) -> dict[str, Document]:
    """What the imports name, and what these import, each file once; a circle is an error."""
    seen: dict[str, Document] = {}

    def load(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise SchemaError(f"I011: imports go in a circle: {' > '.join((*above, name))}")
        if len(above) > deepest:
            raise SchemaError(f"I012: more than {deepest} imports in one another")
        if name not in seen:
            if len(seen) >= most:
                raise SchemaError(f"I013: more than {most} imports")
            seen[name] = parse_schema(read(name))
            for inner in seen[name].imports:
                load(inner, (*above, name))

    for name in doc.imports:
        load(name, ())
    return seen


def resolve_imports(doc: Document, read: Callable[[str], str], most: int = 100, deepest: int = 32) -> Document:
    """Adds what the imports name, each file once; a document's own definitions win, and a circle is an error."""
    out = Document(dict(doc.meta), {}, {}, {}, list(doc.invariants), list(doc.cardinalities), [])
    for other in [*_loaded(doc, read, most, deepest).values(), doc]:
        out.types |= other.types
        out.fields |= other.fields
        out.arrays |= other.arrays
    return out


def _referred(fields: dict[str, Field]) -> list[str]:
    return [n.strip().lstrip("@") for f in fields.values() if f.type.startswith("@") for n in f.type.split("&") if n.strip(" @")]


def flatten(doc: Document, read: Callable[[str], str], conflicts: str = "namespace", shake: bool = True, most: int = 100, deepest: int = 32) -> tuple[Document, list[str]]:
    """One schema without imports, and warnings.

    An import's types take its alias as a prefix (``alias.type``), and with ``namespace``
    its fields, arrays and rules do, too (``alias_path``).  Of two types of one name the
    later counts and a warning says so; with ``error`` the earlier.  With ``shake``, types
    that neither the schema itself has nor anything refers to are left out.
    """
    if conflicts not in ("namespace", "overwrite", "error"):
        raise SchemaError(f"no way to resolve conflicts: {conflicts}")
    out, warnings, homes = Document(dict(doc.meta)), [], {}

    def add(name: str, fields: dict[str, Field], home: str) -> None:
        if name in out.types:
            warnings.append(f"type {name} is there twice")
            if conflicts == "error":
                return
        out.types[name], homes[name] = fields, home

    loaded = _loaded(doc, read, most, deepest)
    for path, other in loaded.items():
        alias = doc.aliases.get(path, "")
        for name, fields in other.types.items():
            add(f"{alias}.{name}" if alias else name, fields, alias)
        moved = (lambda p, alias=alias: f"{alias}_{p}") if alias and conflicts == "namespace" else (lambda p: p)
        out.fields |= {moved(p): _moved(f, moved(p)) for p, f in other.fields.items()}
        out.arrays |= {moved(p): a for p, a in other.arrays.items()}
        out.invariants += [(moved(at), rule) for at, rule in other.invariants]
        out.cardinalities += [(moved(at), *rest) for at, *rest in other.cardinalities]
    for name, fields in doc.types.items():
        add(name, fields, "")
    out.fields |= doc.fields
    out.arrays |= doc.arrays
    out.invariants += doc.invariants
    out.cardinalities += doc.cardinalities
    if shake:
        kept: set[str] = set()
        left = [(n, "") for n in doc.types] + [(n, doc.aliases.get(p, "")) for p, other in loaded.items() for n in _referred(other.fields) + [x for a in other.arrays.values() for x in _referred(a.fields)]]
        left += [(n, "") for n in _referred(doc.fields) + [x for a in doc.arrays.values() for x in _referred(a.fields)]]
        while left:
            name, home = left.pop()
            found = next((n for n in (f"{home}.{name}", name) if n in out.types), None)
            if found is not None and found not in kept:
                kept.add(found)
                left += [(n, homes[found]) for n in _referred(out.types[found])]
        if gone := [n for n in out.types if n not in kept]:
            warnings.append(f"{len(gone)} types that nothing uses are left out")
            out.types = {n: f for n, f in out.types.items() if n in kept}
    return out, warnings
