"""Tables and path tables as text: one line a row, or one text a document."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.kernel import S, Value, field, let, of
from quillspark.operators.documents import _sort_key, literal


def csv_lines(df: DataFrame, columns: Sequence[str] | None = None, delimiter: str = ",", name: str = "line") -> DataFrame:
    """A CSV line for each row, quoted where needed; other columns are kept."""
    names = list(columns or df.columns)

    def cell(n: str):
        s = S(of(df, n))
        risky = s.contains(delimiter) | s.contains('"') | s.contains("\n") | s.contains("\r")
        return F.when(risky, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return df.select(*[c for c in df.columns if c not in names], F.concat_ws(delimiter, *(cell(n) for n in names)).alias(name))


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.options(header="true", sep=delimiter, quote='"', escape='"', emptyValue="").csv(path)


def json_lines(df: DataFrame, columns: Sequence[str] | None = None, nulls: bool = True, name: str = "line", pretty: bool = False) -> DataFrame:
    """A JSON object for each row, ``pretty`` over several lines; without ``nulls`` null fields are left out. NaN and infinities are null."""
    names = list(columns or df.columns)

    def finite(n: str):
        v = of(df, n)
        return F.when(~F.isnan(v.col) & (F.abs(v.col) != float("inf")), v.col) if isinstance(v.type, (T.DoubleType, T.FloatType)) else v.col

    made = F.to_json(F.struct(*(finite(n).alias(n) for n in names)), {"ignoreNullFields": str(not nulls).lower(), "pretty": str(pretty).lower()})
    return df.select(*[c for c in df.columns if c not in names], made.alias(name))


def xml_lines(df: DataFrame, columns: Sequence[str] | None = None, row_tag: str = "row", name: str = "line") -> DataFrame:
    """An XML element for each row: columns named ``@x`` are attributes, ``_text`` is text, nulls are left out."""
    names = list(columns or df.columns)
    made = F.to_xml(F.struct(*(F.col(f"`{n}`").alias(n) for n in names)), {"rowTag": row_tag, "attributePrefix": "@", "valueTag": "_text", "indent": ""})
    return df.select(*[c for c in df.columns if c not in names], made.alias(name))


def _escaped(s, quote: bool = False):
    for plain, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quote else ())):
        s = F.replace(s, F.lit(plain), F.lit(shown))
    return s


def _kind(v: Value) -> str:
    kinds = ((T.BooleanType, "boolean"), (T.IntegralType, "integer"), (T.DecimalType, "currency"), (T.NumericType, "number"), (T.DateType, "date"), (T.TimestampType, "timestamp"))
    return next((name for kind, name in kinds if isinstance(v.type, kind)), "")


def _element(v: Value, tag: str, path: str, cdata: Sequence[str], hint: str, attributes: str = ""):
    """A value as an element; null is none, an array one for each item, an object's ``@x`` are attributes."""
    if v.is_array:
        return F.coalesce(F.array_join(F.transform(v.col, lambda x: _element(Value(x, v.item), tag, path, cdata, hint)), ""), F.lit(""))
    head, body = F.lit(f"<{tag}{attributes}"), None
    if isinstance(v.type, T.StructType):
        parts = [(n, field(v, n)) for n in v.type.fieldNames()]
        for n, x in parts:
            if n.startswith("@"):
                head = F.concat(head, F.coalesce(F.concat(F.lit(f' {n[1:]}="'), _escaped(S(x), True), F.lit('"')), F.lit("")))
        inner = [F.coalesce(_escaped(S(x)), F.lit("")) if n == "_text" else _element(x, n, f"{path}.{n}" if path else n, cdata, hint) for n, x in parts if not n.startswith("@")]
        body = F.concat(F.lit(""), *inner)
    else:
        kind = _kind(v)
        head = F.lit(f"<{tag}{attributes}" + (f' {hint}="{kind}"' if hint and kind else ""))
        body = F.concat(F.lit("<![CDATA["), F.replace(S(v), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>")) if path in cdata else _escaped(S(v))
    return F.when(v.col.isNull(), F.lit("")).otherwise(F.concat(head, F.lit(">"), body, F.lit(f"</{tag}>")))


def xml_elements(df: DataFrame, columns: Sequence[str] | None = None, row_tag: str = "row", name: str = "line", namespaces: dict[str, str] | None = None, cdata: Sequence[str] = (), hint: str = "") -> DataFrame:
    """An XML element for each row, as :func:`xml_lines`, with more say over its form.

    ``namespaces`` are prefixes (or "") and their URIs, declared on the row's element;
    tags and attributes take a prefix by their columns' names (``p:x``, ``@p:x``).
    ``cdata`` names paths whose text is written as it is.  ``hint`` is the attribute that
    tells the type of values other than text, none if empty.
    """
    names = list(columns or df.columns)
    declared = "".join(f' xmlns{":" if p else ""}{p}="{uri}"' for p, uri in (namespaces or {}).items())
    row = of(df.select(F.struct(*(F.col(f"`{n}`").alias(n) for n in names)).alias("_row")), "_row")
    row = Value(F.struct(*(F.col(f"`{n}`").alias(n) for n in names)), row.type)
    return df.select(*[c for c in df.columns if c not in names], _element(row, row_tag, "", cdata, hint, declared).alias(name))


@dataclass(frozen=True)
class Place:
    """Where a column stands in a record, and how it is filled up."""

    column: str
    pos: int
    len: int
    fill: str = " "
    right: bool = True


def fixed_lines(df: DataFrame, places: Sequence[Place], width: int = 0, fill: str = " ", name: str = "line") -> DataFrame:
    """A fixed-width line for each row; values that are too long are cut, gaps and the end are filled up."""
    pieces, at = [], 0
    for p in sorted(places, key=lambda p: p.pos):
        if p.pos < at:
            raise ValueError(f"'{p.column}' stands on another field")
        s = S(of(df, p.column))
        pieces += [F.lit(" " * (p.pos - at))] if p.pos > at else []
        pieces.append(F.rpad(s, p.len, p.fill) if p.right else F.lpad(F.left(s, F.lit(p.len)), p.len, p.fill))
        at = p.pos + p.len
    line = F.concat(*pieces)
    used = {p.column for p in places}
    return df.select(*[c for c in df.columns if c not in used], (F.rpad(line, width, fill) if width > at else line).alias(name))


def flat_text(paths: DataFrame) -> DataFrame:
    """Per document its ``path=value`` lines, sorted by path."""
    rows = paths.select("doc_id", F.struct("path", F.concat(F.col("path"), F.lit("="), F.coalesce("value", F.lit(""))).alias("line")).alias("e"))
    return rows.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n"), F.lit("\n")).alias("text"))


def notation_text(paths: DataFrame, sort: bool = False, headers: bool = False, crlf: bool = False) -> DataFrame:
    """Per document its text in the native notation, an assignment a line, in order or sorted as the canonical form is.

    With ``headers`` a line ``{section}`` stands before assignments of another section than
    the last, and their paths begin there; with ``crlf`` lines end as on Windows.
    """
    key = F.struct(_sort_key("path")) if sort else F.struct("ord")
    said = F.concat(F.lit(" = "), F.coalesce("mods", F.lit("")), literal())
    section = F.regexp_extract("path", r"^(.*)\.[^.]*$", 1) if headers else F.lit("")
    own = F.when(section != "", F.expr("substring(path, length(regexp_extract(path, '^(.*)[.][^.]*$', 1)) + 2)")).otherwise(F.col("path")) if headers else F.col("path")
    rows = paths.select("doc_id", F.struct(key.alias("k"), section.alias("section"), F.concat(own, said).alias("line")).alias("e"))
    end = "\r\n" if crlf else "\n"

    def lines(found):
        def one(e, i):
            new = F.when(i == 0, e["section"] != "").otherwise(e["section"] != F.get(found, i - 1)["section"])
            return F.concat(F.when(new, F.concat(F.lit("{"), e["section"], F.lit("}" + end))).otherwise(F.lit("")), e["line"])

        return F.array_join(F.transform(found, one if headers else (lambda e: e["line"])), end)

    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("_e")).select("doc_id", F.concat(let(F.col("_e"), lines), F.lit(end)).alias("text"))


def _yaml(v: Value, depth: int):
    """A value below its key, beginning with what stands on the key's line."""
    pad = "  " * depth
    if isinstance(v.type, T.StructType):
        parts = [F.concat(F.lit(f"\n{pad}{n}:"), _yaml(field(v, n), depth + 1)) for n in v.type.fieldNames()]
        return F.when(v.col.isNull(), F.lit(" null")).otherwise(F.concat(F.lit(""), *parts))
    if v.is_array:
        inner = lambda x: F.concat(F.lit(f"\n{pad}-"), _yaml_item(Value(x, v.item), depth + 1))
        return F.when(v.col.isNull(), F.lit(" null")).when(F.size(v.col) == 0, F.lit(" []")).otherwise(F.array_join(F.transform(v.col, inner), ""))
    if v.is_string:
        s = S(v)
        risky = s.rlike(r"^(?:|~|null|true|false|yes|no|on|off|[+-]?[\d.].*|[\s\"'\[{!&*#?|>%@`-].*|.*(?::|\s#|\s$|\n).*)$")
        shown = F.when(risky, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(s)
        return F.when(v.col.isNull(), F.lit(" null")).otherwise(F.concat(F.lit(" "), shown))
    return F.when(v.col.isNull(), F.lit(" null")).otherwise(F.concat(F.lit(" "), S(v)))


def _yaml_item(v: Value, depth: int):
    if isinstance(v.type, T.StructType):
        return F.regexp_replace(_yaml(v, depth), r"^\n\s*", " ")
    return _yaml(v, depth)


def yaml_text(df: DataFrame, columns: Sequence[str] | None = None, name: str = "text") -> DataFrame:
    """A YAML text for each row."""
    names = list(columns or df.columns)
    parts = [F.concat(F.lit(f"{n}:"), _yaml(of(df, n), 1), F.lit("\n")) for n in names]
    return df.select(*[c for c in df.columns if c not in names], F.concat(*parts).alias(name))


def dump(paths: DataFrame, folder: str) -> None:
    """Documents of a path table as files in the native notation, a folder ``doc_id=...`` for each."""
    notation_text(paths).write.partitionBy("doc_id").text(folder)
