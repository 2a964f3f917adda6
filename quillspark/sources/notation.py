"""A reader of the native notation: typed assignments, headers and tables, as path rows."""

from __future__ import annotations

import re

Row = tuple[str, str, "str | None", str]
_VALUE = re.compile(r'"""(?s:.*?)"""|"(?:[^"\\]|\\.)*"|[^\s;,]+')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}
MOST_INDEX, DEEPEST = 10_000, 64


class NotationError(ValueError):
    """The text doesn't parse; the message begins with a code."""


def unquoted(s: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        return _ESCAPES.get(m[2], m[2])

    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", one, s)


def value(word: str) -> tuple[str, str | None]:
    """A literal's type and value, by its prefix or form."""
    if word.startswith('"""'):
        return "string", word[3:-3]
    if word.startswith('"'):
        return "string", unquoted(word[1:-1])
    if word == "~":
        return "null", None
    if word in ("true", "false", "?true", "?false"):
        return "boolean", word.lstrip("?")
    for prefix, kind, form in (("##", "integer", r"[+-]?\d+"), ("#$", "currency", r"[+-]?\d+(?:\.\d+)?(?::[A-Za-z]{3})?"), ("#%", "percent", r"[+-]?\d+(?:\.\d+)?"), ("#", "number", r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")):
        if word.startswith(prefix):
            if not re.fullmatch(form, word[len(prefix) :]):
                raise NotationError(f"P001: no {kind}: {word}")
            return kind, word[len(prefix) :]
    if word.startswith("@"):
        return "reference", word[1:]
    if word.startswith("^"):
        return "binary", word[1:]
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", word):
        return "date", word
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}T\S+", word):
        return "timestamp", word
    if re.fullmatch(r"T\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?\S*", word):
        return "time", word
    if re.fullmatch(r"P(?=[\dT])[\dYMWDTHS.]+", word):
        return "duration", word
    return "string", word


def _checked(path: str) -> str:
    for n in re.findall(r"\[(\d+)\]", path):
        if int(n) > MOST_INDEX:
            raise NotationError(f"P003: index beyond {MOST_INDEX}: {path}")
    if path.count(".") + path.count("[") > DEEPEST:
        raise NotationError(f"P011: deeper than {DEEPEST}: {path}")
    return path


def _joined(prefix: str, name: str) -> str:
    return _checked(f"{prefix}.{name}" if prefix and not name.startswith("[") else prefix + name)


def parse_notation(text: str) -> list[list[Row]]:
    """Each chained document's path rows, in order; a later assignment of a path takes the earlier one's place."""
    documents: list[dict[str, Row]] = [{}]
    prefix, absolute, columns, table, n = "", "", [], "", 0
    text = re.sub(r'"""(?s:.*?)"""', lambda m: '"' + m[0][3:-3].replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"', text)
    for number, raw in enumerate(text.splitlines(), 1):
        line = re.sub(r'^((?:[^";]|"(?:[^"\\]|\\.)*")*);.*$', r"\1", raw).strip()
        if not line:
            continue
        if re.fullmatch(r"---\s*", line):
            documents.append({})
            prefix, absolute, columns = "", "", []
            continue
        if line.startswith("{") and line.endswith("}"):
            head = line[1:-1].strip()
            m = re.match(r"([^:\s]*)\[\]\s*:\s*(.+)$", head)
            columns = []
            if m:
                table, columns, n = _place(m[1], absolute), [c.strip() for c in m[2].split(",")], 0
            elif head.startswith("."):
                prefix = _place(head, absolute)
            else:
                prefix = absolute = head
            continue
        if columns and "=" not in re.sub(r'"(?:[^"\\]|\\.)*"', "", line):
            cells = [c.strip() for c in re.findall(r'(?:^|,)((?:"(?:[^"\\]|\\.)*"|[^,"])*)', line)]  # an empty cell is no assignment
            for c, cell in zip(columns, cells):
                if cell:
                    path = _joined(f"{table}[{n}]", c)
                    documents[-1][path] = (path, *value(cell), "")
            n += 1
            continue
        m = re.match(r"([^=\s]+)\s*=\s*(.*)$", line)
        if m is None:
            raise NotationError(f"P001: line {number}: no assignment")
        path, rest = _joined(prefix, m[1]), m[2].strip()
        mods = re.match(r"(?:[!*]|-(?!\d))*", rest)[0]
        rest = rest[len(mods) :].strip()
        word = _VALUE.match(rest)
        if word is None and not rest.startswith("%"):
            raise NotationError(f"P001: line {number}: no value")
        if rest.startswith('"') and word and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', word[0]):
            raise NotationError(f"P004: line {number}: a quote is open")
        kind, v = ("verb", rest) if rest.startswith("%") else value(word[0])
        documents[-1][path] = (path, kind, v, "".join(c for c in "!-*" if c in mods))
    return [list(d.values()) for d in documents]


def _place(head: str, absolute: str) -> str:
    return _joined(absolute, head[1:]) if head.startswith(".") else head
