"""The library's functions by name, over tables of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillspark.operators.documents import canonical as canonicalize  # noqa: F401
from quillspark.operators.documents import diff, overlay as collapse_chain, patch  # noqa: F401
from quillspark.operators.validation import validate  # noqa: F401
from quillspark.plans import parse_transform, run as execute_transform  # noqa: F401
from quillspark.plans.schema import parse_schema, resolve_imports, write_schema as serialize_schema  # noqa: F401
from quillspark.sources.readers import notation_chains as parse_documents  # noqa: F401
from quillspark.sources.readers import notation_paths as parse  # noqa: F401
from quillspark.sources.readers import read_texts
from quillspark.sources.writers import csv_lines as to_csv  # noqa: F401
from quillspark.sources.writers import dump  # noqa: F401
from quillspark.sources.writers import fixed_lines as to_fixed_width  # noqa: F401
from quillspark.sources.writers import json_lines as to_json  # noqa: F401
from quillspark.sources.writers import notation_text as dumps  # noqa: F401
from quillspark.sources.writers import xml_lines as to_xml  # noqa: F401

loads = parse


def load(spark, path: str) -> DataFrame:
    """Files in the native notation as a path table; documents are named by their file."""
    return parse(read_texts(spark, path), "doc_id", "text")


def path(*segments: str | int) -> str:
    """A path from names and places: ``path("a", 0, "b")`` is ``a[0].b``."""
    out = ""
    for s in segments:
        out += f"[{s}]" if isinstance(s, int) else f".{s}" if out and not str(s).startswith("[") else str(s)
    return out


def validate_document(df: DataFrame, key: str, schema: str, section: str = "") -> DataFrame:
    """Violation rows of a table whose rows are a schema's section, given the schema's text."""
    return validate(df, key, parse_schema(schema).rules(section))


def validate_with_imports(df: DataFrame, key: str, schema: str, read, section: str = "") -> DataFrame:
    """:func:`validate_document` for a schema that imports others; ``read`` gives the text that an import's path names."""
    return validate(df, key, resolve_imports(parse_schema(schema), read).rules(section))
