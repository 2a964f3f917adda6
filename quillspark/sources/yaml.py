"""A reader of plain YAML: maps, lists, scalars and comments, as path rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

Row = tuple[str, str, "str | None", str]
_KEY = re.compile(r"""((?:"[^"]*"|'[^']*'|[^:#"'\[{])[^:]*?)\s*:(?:\s+(.*)|)$""")


def scalar(text: str) -> tuple[str, str | None]:
    """A scalar's type and value."""
    t, low = text.strip(), text.strip().lower()
    if t in ("", "~") or low == "null":
        return "null", None
    if len(t) > 1 and t[0] == t[-1] and t[0] in "\"'":
        return "string", t[1:-1]
    if low in ("true", "yes", "on"):
        return "boolean", "true"
    if low in ("false", "no", "off"):
        return "boolean", "false"
    if re.fullmatch(r"[+-]?\d+", t):
        return "integer", str(int(t))
    if re.fullmatch(r"[+-]?(?:\d+\.\d*|\.\d+|\d+(?=[eE]))(?:[eE][+-]?\d+)?", t):
        return "number", t
    return "string", t


def _lines(text: str) -> list[tuple[int, str]]:
    out = []
    for raw in text.split("\n"):
        bare = re.sub(r"""^((?:[^#"']|"[^"]*"|'[^']*'|(?<=\S)#)*?)(?:(?<!\S)#.*)?$""", r"\1", raw.rstrip())
        if bare.strip() and bare.strip() != "---":
            out.append((len(bare) - len(bare.lstrip()), bare.strip()))
    return out


def parse_yaml(text: str) -> Iterator[Row]:
    """Path rows of a text, in order."""
    lines = _lines(text)
    rows: list[Row] = []

    def block(at: int, indent: int, path: str) -> int:
        """Reads the lines from ``at`` on that stand at ``indent``; gives where it stopped."""
        n = 0
        while at < len(lines) and lines[at][0] >= indent:
            depth, line = lines[at]
            if line == "-" or line.startswith("- "):
                rest, here = line[1:].strip(), f"{path}[{n}]"
                n += 1
                if not rest:
                    at = block(at + 1, lines[at + 1][0], here) if at + 1 < len(lines) and lines[at + 1][0] > depth else leaf(here, "", at)
                elif _KEY.match(rest):
                    # A map that begins on the dash's line stands where its first key does.
                    lines[at] = (depth + len(line) - len(rest), rest)
                    at = block(at, lines[at][0], here)
                else:
                    at = leaf(here, rest, at)
                continue
            m = _KEY.match(line)
            if m is None:
                raise ValueError(f"no YAML: {line}")
            name = m[1].strip().strip("\"'")
            here = f"{path}.{name}" if path else name
            if m[2]:
                at = leaf(here, m[2], at)
            elif at + 1 < len(lines) and (lines[at + 1][0] > depth or lines[at + 1][0] == depth and lines[at + 1][1].startswith("-")):
                at = block(at + 1, lines[at + 1][0], here)
            else:
                at = leaf(here, "", at)
            if at < len(lines) and lines[at][0] < depth:
                return at
        return at

    def leaf(path: str, value: str, at: int) -> int:
        rows.append((path, *scalar(value), ""))
        return at + 1

    if lines:
        block(0, lines[0][0], "")
    return iter(rows)
