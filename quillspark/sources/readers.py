"""Text formats as tables and path tables.

Where Spark has a reader it is used, with every value as text; types are told value
by value (:func:`inferred`), as the formats have no column types.  Formats without
one are read from a text column: flat files, fixed width and records by expressions,
YAML and the native notation by a parser over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.notation import parse_notation
from quillspark.sources.yaml import parse_yaml


def inferred(s: Column, quotes: bool = False, tilde: bool = False) -> Column:
    """A text's type and value: ``struct<type, value>``; empty text is null, words and numbers are told by their form.

    ``quotes`` takes matching quotes for text; ``tilde`` takes ~ for null.
    """
    low = F.lower(s)
    null = (s == "") | (low == "null") | (F.lit(tilde) & (s == "~"))
    quoted = F.lit(quotes) & s.rlike(r"^(?s)(?:\".*\"|'.*')$") & (F.length(s) > 1)
    integer = s.rlike(r"^\s*[+-]?\d+(?:_\d+)*\s*$")
    number = s.rlike(r"^\s*[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+)(?:[eE][+-]?\d+)?\s*$") & s.rlike("[.eE]")
    kind = F.when(null | s.isNull(), F.lit("null")).when(quoted, F.lit("string")).when(low.isin("true", "false"), F.lit("boolean")).when(integer, F.lit("integer")).when(number, F.lit("number")).otherwise(F.lit("string"))
    bare = F.regexp_replace(F.trim(s), "[_+]", "")
    value = F.when(null, F.lit(None)).when(quoted, F.substr(s, F.lit(2), F.length(s) - 2)).when(low.isin("true", "false"), low).when(integer, bare).when(number, F.trim(s)).otherwise(s)
    return F.struct(kind.alias("type"), value.alias("value"))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """A CSV file's columns as text, empty cells null; short rows are filled up and long ones cut."""
    return spark.read.options(sep=delimiter, header=str(header).lower(), quote='"', escape='"', multiLine="true", mode="PERMISSIVE", inferSchema="false", emptyValue="", nullValue="").csv(path)


def csv_table(df: DataFrame, column: str, names: Sequence[str], delimiter: str = ",") -> DataFrame:
    """Lines of CSV in a text column as columns; the rest of each row is kept."""
    schema = ", ".join(f"`{n}` string" for n in names)
    parsed = df.withColumn("_csv", F.from_csv(column, schema, {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "emptyValue": "", "nullValue": ""}))
    return parsed.select(*[c for c in df.columns if c != column], "_csv.*")


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """Elements as rows; attributes are named ``@name``, text beside children ``_text``, and all leaves are text."""
    reader = spark.read.options(rowTag=row_tag, attributePrefix="@", valueTag="_text", inferSchema="false")
    return (reader.schema(schema) if schema else reader).format("xml").load(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``doc_id`` (their path) and ``text``."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))


def flat_paths(df: DataFrame, key: str, column: str) -> DataFrame:
    """Lines ``a.b[0] = value`` of a text column as a path table; the last of a path counts."""
    lines = df.select(F.col(key).alias("doc_id"), F.posexplode(F.split(column, r"\r?\n")).alias("ord", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"(?U)^\s+|\s+$", "")))
    split = r"^((?:[^=\[\"']|\[[^\]]*\]|\"[^\"]*\"|'[^']*')*)=(.*)$"
    pairs = lines.where("line != '' and not startswith(line, '#') and not startswith(line, ';')").select("doc_id", F.col("ord").cast("bigint").alias("ord"), F.trim(F.regexp_extract("line", split, 1)).alias("path"), inferred(F.trim(F.regexp_extract("line", split, 2)), True, True).alias("x"))
    rows = pairs.where("path != ''").groupBy("doc_id", "path").agg(F.min("ord").alias("ord"), F.max_by("x", "ord").alias("x"))
    return rows.select("doc_id", "ord", "path", "x.type", "x.value", F.lit("").alias("mods"))


@dataclass(frozen=True)
class Field:
    """A field of a fixed-width record; ``type`` is string, integer, number or date."""

    name: str
    pos: int
    len: int
    type: str = "string"
    implied_decimals: int = 0


def fixed_width(df: DataFrame, column: str, fields: Sequence[Field]) -> DataFrame:
    """A text column's fields as columns, by place; what doesn't read as its type is null."""
    cols = []
    for f in fields:
        raw = F.regexp_replace(F.substr(F.col(column), F.lit(f.pos + 1), F.lit(f.len)), r"\s+$", "")
        if f.type == "integer":
            raw = F.trim(raw).try_cast("bigint")
        elif f.type == "number":
            raw = F.trim(raw).try_cast("double") / float(10**f.implied_decimals)
        elif f.type == "date":
            raw = F.when(raw == "", F.lit(None)).when(raw.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2), F.substring(raw, 7, 2))).otherwise(raw)
        cols.append(raw.alias(f.name))
    return df.select(*[c for c in df.columns if c != column], *cols)


def discriminator(line: str, by: str, pos: int = 0, length: int = 1, index: int = 0, path: str = "") -> Column:
    """A record's type: by ``position``, by ``field`` (between commas) or by a JSON ``path``."""
    if by == "position":
        return F.substr(F.col(line), F.lit(pos + 1), F.lit(length))
    if by == "field":
        return F.coalesce(F.trim(F.get(F.split(line, ","), F.lit(index))), F.lit(""))
    return F.coalesce(F.get_json_object(line, f"$.{path}"), F.lit(""))


def route(df: DataFrame, kind: Column, known: Sequence[str], unknown: str = "error") -> tuple[dict[str, DataFrame], DataFrame]:
    """Records by type, and those of no known type (as errors, warnings, or skipped).

    One scan is filtered for each type; the input should be a table that is cheap to read again.
    """
    typed = df.withColumn("record_type", kind)
    lost = typed.where(~F.col("record_type").isin(*known)).withColumns({"code": F.lit("UNKNOWN_RECORD_TYPE"), "level": F.lit(unknown)})
    return {k: typed.where(F.col("record_type") == k) for k in known}, lost.where(F.lit(unknown != "skip"))


_PATHS = "doc_id {key}, ord long, path string, type string, value string, mods string"


def _parsed(df: DataFrame, key: str, column: str, parse) -> DataFrame:
    """Path rows of each text by a parser; a text that doesn't parse gives one row of type ``error``."""
    schema = _PATHS.format(key=df.schema[key].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                try:
                    found = list(parse(text or ""))
                except ValueError as e:
                    found = [("", "error", str(e), "")]
                take += [i] * len(found)
                rows += [(n, *r) for n, r in enumerate(found)]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["doc_id", "ord", "path", "type", "value", "mods"])

    return df.select(key, column).mapInArrow(run, schema)


def yaml_paths(df: DataFrame, key: str, column: str) -> DataFrame:
    """A text column of YAML (maps, lists, scalars, comments) as a path table."""
    return _parsed(df, key, column, parse_yaml)


def notation_paths(df: DataFrame, key: str, column: str) -> DataFrame:
    """A text column of the native notation as a path table; of chained documents the first (see :func:`notation_chains`)."""
    return _parsed(df, key, column, lambda text: parse_notation(text)[0])


def notation_chains(df: DataFrame, key: str, column: str) -> DataFrame:
    """Chained documents (``---`` between) as path rows with their ``version``, from 0."""
    parts = df.select(key, F.posexplode(F.split(column, r"(?m)^---\s*$")).alias("version", "_part"))
    parsed = _parsed(parts.withColumn("_id", F.struct(F.col(key), "version")), "_id", "_part", lambda text: parse_notation(text)[0])
    return parsed.select(F.col(f"doc_id.{key}").alias("doc_id"), F.col("doc_id.version").alias("version"), "ord", "path", "type", "value", "mods")


