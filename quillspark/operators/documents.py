"""Collections of documents as path tables: one row for each assignment.

Columns: ``doc_id``, ``ord`` (the assignment's place in its document), ``path``
(``a.b[0].c``), ``type``, ``value`` (the literal's text, null for null) and ``mods``
(any of ``!-*``, in that order).  All operators work on any number of documents at
once and shuffle by document and path at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillspark.session import checkpointed

COLUMNS = ["doc_id", "ord", "path", "type", "value", "mods"]


def literal_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.DateType):
        return "date"
    return "timestamp" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else "string"


def from_table(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A document for each row: its key, and an assignment for each other column, nulls too."""
    from quillspark.functions.kernel import of, shown

    names = [c for c in (columns or df.columns) if c != key]
    rows = [F.struct(F.lit(i).cast("bigint").alias("ord"), F.lit(n).alias("path"), F.when(df[n].isNull(), F.lit("null")).otherwise(F.lit(literal_type(df.schema[n].dataType))).alias("type"), shown(of(df, n)).alias("value")) for i, n in enumerate(names)]
    return df.select(F.col(key).alias("doc_id"), F.inline(F.array(*rows))).withColumn("mods", F.lit(""))


def to_table(paths: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A row for each document with the named paths as columns of the given types; text that doesn't fit is null."""
    picked = paths.where(F.col("path").isin(*columns))
    return picked.groupBy("doc_id").agg(*(F.max(F.when(F.col("path") == p, F.col("value"))).try_cast(kind).alias(p) for p, kind in columns.items()))


def _same(a: str, b: str):
    return (F.col(f"{a}.type") == F.col(f"{b}.type")) & F.col(f"{a}.value").eqNullSafe(F.col(f"{b}.value"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Change rows from ``a`` to ``b``: ``doc_id, op, path, to_path, ord, old_*, new_*``.

    ``op`` is add, delete, modify or move.  A deletion and an addition of one value
    are a move; of several of one value, the first goes with the first.
    """
    sides = lambda df, name: df.select("doc_id", "path", F.struct(*(c for c in ("ord", "type", "value", "mods"))).alias(name))
    both = sides(a, "a").join(sides(b, "b"), ["doc_id", "path"], "full")
    changed = both.where(F.col("a").isNotNull() & F.col("b").isNotNull() & ~(_same("a", "b") & F.col("a.mods").eqNullSafe(F.col("b.mods"))))
    nth = Window.partitionBy("doc_id", F.col("x.type"), F.col("x.value")).orderBy("x.ord", "path")
    gone = both.where("b is null").select("doc_id", "path", F.col("a").alias("x")).withColumn("nth", F.row_number().over(nth))
    come = both.where("a is null").select("doc_id", "path", F.col("b").alias("x")).withColumn("nth", F.row_number().over(nth))
    g, c = gone.alias("g"), come.alias("c")
    on = (F.col("g.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("g.x.type") == F.col("c.x.type")) & F.col("g.x.value").eqNullSafe(F.col("c.x.value")) & (F.col("g.nth") == F.col("c.nth"))
    met = g.join(c, on, "full")
    moved = F.col("g.path").isNotNull() & F.col("c.path").isNotNull()
    rest = met.select(
        F.coalesce("g.doc_id", "c.doc_id").alias("doc_id"),
        F.when(moved, F.lit("move")).when(F.col("g.path").isNotNull(), F.lit("delete")).otherwise(F.lit("add")).alias("op"),
        F.coalesce("g.path", "c.path").alias("path"),
        F.when(moved, F.col("c.path")).alias("to_path"),
        F.coalesce("c.x.ord", "g.x.ord").alias("ord"),
        F.col("g.x").alias("old"),
        F.col("c.x").alias("new"),
    )
    modified = changed.select("doc_id", F.lit("modify").alias("op"), "path", F.lit(None).cast("string").alias("to_path"), F.col("b.ord").alias("ord"), F.col("a").alias("old"), F.col("b").alias("new"))
    parts = [F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("old", "new") for f in ("type", "value", "mods")]
    return rest.unionByName(modified).select("doc_id", "op", "path", "to_path", "ord", *parts)


def patch(a: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The patched documents, and errors (``doc_id, op, path``) of changes to paths that aren't there.

    Deletions come first, then modifications, additions and moves; a move takes
    along the value, and what it moves onto is replaced.
    """
    at = a.select("doc_id", "path").withColumn("_there", F.lit(True))
    tested = changes.where("op in ('delete', 'modify', 'move')").join(at, ["doc_id", "path"], "left")
    errors = tested.where("_there is null").select("doc_id", "op", "path")
    touched = changes.where("op in ('delete', 'move')").select("doc_id", "path").unionByName(changes.where("op in ('add', 'move')").select("doc_id", F.coalesce("to_path", "path").alias("path")))
    kept = a.join(touched.distinct(), ["doc_id", "path"], "left_anti")
    new = changes.where("op = 'modify'").select("doc_id", "path", F.struct("new_type", "new_value", "new_mods").alias("n"))
    kept = kept.join(new, ["doc_id", "path"], "left").select("doc_id", "ord", "path", F.when(F.col("n").isNotNull(), F.col("n.new_type")).otherwise(F.col("type")).alias("type"), F.when(F.col("n").isNotNull(), F.col("n.new_value")).otherwise(F.col("value")).alias("value"), F.when(F.col("n").isNotNull(), F.col("n.new_mods")).otherwise(F.col("mods")).alias("mods"))
    added = changes.where("op = 'add'").select("doc_id", "ord", "path", F.col("new_type").alias("type"), F.col("new_value").alias("value"), F.col("new_mods").alias("mods"))
    moved = a.join(changes.where("op = 'move'").select("doc_id", "path", "to_path", F.col("ord").alias("to_ord"), "new_mods"), ["doc_id", "path"]).select("doc_id", F.col("to_ord").alias("ord"), F.col("to_path").alias("path"), "type", "value", F.coalesce("new_mods", "mods").alias("mods"))
    return kept.unionByName(added).unionByName(moved).select(*COLUMNS), errors


def _prefixes(path: str):
    """The path's proper ancestors with what follows them, ``.`` or ``[``."""
    places = F.filter(F.sequence(F.lit(1), F.length(path)), lambda i: F.substr(F.col(path), i, F.lit(1)).isin(".", "["))
    return F.transform(places, lambda i: F.struct(F.substr(F.col(path), F.lit(1), i - 1).alias("p"), F.substr(F.col(path), i, F.lit(1)).alias("c")))


def overlay(versions: DataFrame) -> DataFrame:
    """Collapses chains (``doc_id, version`` and the other columns) to their last state.

    A later write of a path wins.  A null removes the path and all below it, and a
    null at ``path[]`` clears the array's elements, unless they are written again.
    Metadata (paths from ``$.``) are the last version's.
    """
    last = versions.groupBy("doc_id").agg(F.max("version").alias("_last"))
    meta = versions.where(F.col("path").startswith("$.")).join(last, "doc_id").where("version = _last").select(*COLUMNS)
    data = versions.where(~F.col("path").startswith("$."))
    at = F.struct("version", "ord")
    writes = data.where("type != 'null'").groupBy("doc_id", "path").agg(F.max(at).alias("at"), F.max_by(F.struct("type", "value", "mods"), at).alias("x"), F.min(at).alias("first"))
    nulls = data.where("type = 'null'")
    stones = nulls.groupBy("doc_id", F.regexp_replace("path", r"\[\]$", "").alias("p"), F.col("path").endswith("[]").alias("array")).agg(F.max(at).alias("gone"))
    reach = writes.select("doc_id", "path", "at", F.explode(F.concat(F.transform(_prefixes("path"), lambda e: F.struct(e["p"].alias("p"), e["c"].alias("c"))), F.array(F.struct(F.col("path").alias("p"), F.lit("=").alias("c"))))).alias("e"))
    hit = reach.select("doc_id", "path", "at", "e.p", "e.c").join(stones, ["doc_id", "p"]).where("gone > at and (not array or c = '[')")
    kept = writes.join(hit.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_anti")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("first", "path")).cast("bigint")
    return kept.select("doc_id", place.alias("ord"), "path", "x.type", "x.value", "x.mods").unionByName(meta)


def _sort_key(path: str):
    """A text that sorts as canonical order does: metadata first, extensions last, array places by number."""
    first = F.when(F.col(path).startswith("$"), F.lit("0")).when(F.col(path).startswith("&"), F.lit("2")).otherwise(F.lit("1"))
    steps = F.regexp_extract_all(path, F.lit(r"[^.\[\]]+|\[[^\]]*\]"), F.lit(0))
    keyed = F.transform(steps, lambda s: F.when(s.startswith("["), F.concat(F.lit("\u0002"), F.lpad(F.translate(s, "[]", ""), 20, "0"))).otherwise(F.concat(F.lit("\u0001"), s)))
    return F.concat(first, F.array_join(keyed, "\u0000"))


def literal():
    """The canonical text of ``type`` and ``value``."""
    v = F.col("value")
    escaped = v
    for old, new in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(old), F.lit(new))
    trimmed = F.when(v.contains(".") & ~v.rlike("[eE]"), F.regexp_replace(v, r"\.?0+$", "")).otherwise(v)
    amount, code = F.substring_index(v, ":", 1), F.when(v.contains(":"), F.concat(F.lit(":"), F.upper(F.substring_index(v, ":", -1)))).otherwise(F.lit(""))
    places = F.when(amount.contains("."), F.length(F.substring_index(amount, ".", -1))).otherwise(F.lit(0))
    padded = F.concat(F.when(amount.contains("."), amount).otherwise(F.concat(amount, F.lit("."))), F.repeat(F.lit("0"), F.greatest(2 - places, F.lit(0))))
    forms = {"null": F.lit("~"), "boolean": v, "string": F.concat(F.lit('"'), escaped, F.lit('"')), "number": F.concat(F.lit("#"), trimmed), "integer": F.concat(F.lit("##"), v), "currency": F.concat(F.lit("#$"), padded, code), "percent": F.concat(F.lit("#%"), v), "reference": F.concat(F.lit("@"), v), "binary": F.concat(F.lit("^"), v)}
    out = v
    for kind, form in forms.items():
        out = F.when(F.col("type") == kind, form).otherwise(out)
    return out


def canonical(paths: DataFrame) -> DataFrame:
    """Per document its canonical text (a line for each path, sorted) and the text's SHA-256."""
    lines = paths.select("doc_id", F.struct(_sort_key("path").alias("k"), F.concat(F.col("path"), F.lit(" = "), F.coalesce("mods", F.lit("")), literal()).alias("line")).alias("e"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.concat(e["line"], F.lit("\n"))), "")
    return lines.groupBy("doc_id").agg(text.alias("text")).withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256))


def dangling(paths: DataFrame) -> DataFrame:
    """V013: references to paths that their document doesn't hold, as a value or above values."""
    refs = paths.where("type = 'reference'").select("doc_id", "path", F.col("value").alias("target"))
    held = paths.select("doc_id", F.explode(F.array_append(F.transform(_prefixes("path"), lambda e: e["p"]), F.col("path"))).alias("target")).distinct()
    return refs.join(held, ["doc_id", "target"], "left_anti").select("doc_id", "path", "target")


def cycles(paths: DataFrame) -> DataFrame:
    """V012: references whose chain never ends, those that lead into a cycle too.

    Each round doubles the steps that have been followed, and drops chains that end,
    until there are more steps than any document has references.
    """
    hop = checkpointed(paths.where("type = 'reference'").select("doc_id", F.col("path").alias("a"), F.col("value").alias("b")).distinct())
    most = hop.groupBy("doc_id").agg(F.count_distinct("a").alias("n")).agg(F.max("n")).first()[0] or 0
    far, reached = hop, 1
    while reached <= most:
        again = far.select("doc_id", F.col("a").alias("b"), F.col("b").alias("c"))
        far = checkpointed(far.join(again, ["doc_id", "b"]).select("doc_id", "a", F.col("c").alias("b")).distinct())
        reached *= 2
    return far.select("doc_id", F.col("a").alias("path")).distinct()
