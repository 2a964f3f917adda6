"""Registered queries with their SQL, by family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.queries import documents, formats, tables, transforms, verbs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for family in FAMILIES:
        found |= family.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in FAMILIES:
        found |= family.oracle_sql()
    return found


FAMILIES = (transforms, verbs, tables, documents, formats)
