"""Measures of printed forms as columns: lengths, contrast and pages of bound arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.kernel import N, S, Value, constant, double
from quillspark.functions.registry import null, verb

#: Pixels of one unit, at 96 to the inch.
PIXELS = {"inch": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "pt": 96 / 72}


@verb("toPixels", least=2)
def to_pixels(v: Value, unit: Value) -> Value:
    factor = PIXELS.get(str(constant(unit, "")))
    return null(v.type) if factor is None else double(F.rint(N(v) * factor * 1000) / 1000)


@verb("fromPixels", least=2)
def from_pixels(v: Value, unit: Value) -> Value:
    factor = PIXELS.get(str(constant(unit, "")))
    return null(v.type) if factor is None else double(F.rint(N(v) / factor * 1000) / 1000)


def _luminance(colour):
    """Relative luminance of ``#rrggbb``."""
    bare = F.regexp_replace(colour, "^#", "")

    def channel(at: int):
        s = F.conv(F.substring(bare, at, 2), 16, 10).try_cast("double") / 255
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return F.when(bare.rlike("^[0-9a-fA-F]{6}$"), 0.2126 * channel(1) + 0.7152 * channel(3) + 0.0722 * channel(5))


@verb("contrastRatio", least=2)
def contrast_ratio(front: Value, back: Value) -> Value:
    a, b = _luminance(S(front)), _luminance(S(back))
    known = a.isNotNull() & b.isNotNull()
    return double(F.when(known, (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)))


def pages(df: DataFrame, array: str, first: int, more: int | None = None) -> DataFrame:
    """A row for each page that an array takes: ``page`` (from 0) and its ``items``, ``first`` on the first page and ``more`` on others."""
    size, rest = F.coalesce(F.size(array), F.lit(0)), int(more or first)
    n = 1 + F.ceil(F.greatest(size - first, F.lit(0)) / rest).cast("int")
    start = F.when(F.col("page") == 0, F.lit(1)).otherwise(F.lit(first + 1) + (F.col("page") - 1) * rest)
    length = F.when(F.col("page") == 0, F.lit(first)).otherwise(F.lit(rest))
    return df.withColumn("page", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("items", F.slice(array, start, length))
