"""Documents to training tokens, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  The first four return
the columns of ``documents``:

* ``language_id`` drops what has no letters or no language told with confidence;
* ``near_duplicates`` keeps one row of each group (five-word shingles, similarity 0.8),
  that with the least id, null ids last; of repeated rows one stays, and rows that
  share an id but not a text are judged each by its own;
* ``decontaminate`` drops what holds a passage of the benchmark;
* ``secrets`` keeps every document and replaces secrets' values in its text
  (``n_chars`` follows the text);
* ``bpe`` returns ``doc_id``, ``n_tokens``, ``token_ids`` and the SHA-256 of what
  the ids decode to, and nothing else.

Null texts have no language and leave in the first stage.  A table without rows
passes through as one.  Further columns of ``documents`` are carried along up to
the last stage, whatever they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe_codec, decontaminate, language_id, near_duplicates, secrets
from quillspark.llm.common import Scratch
from quillspark.llm.queries import vocabulary


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(docs, F.lit(True)))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if rows == ids:
        lesser = near_duplicates.near_duplicates(docs, words=5, percent=80).where("not kept").select("doc_id")
        return docs.join(lesser, "doc_id", "left_anti").select(*docs.columns)
    # Some ids are repeated or null: rows are told apart by a number, written down with them.
    row = f"_row_{uuid.uuid4().hex[:8]}"
    keyed = Scratch(spark, "rows").keep(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates.near_duplicates(keyed, key=row, words=5, percent=80).select(row, "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("least")
    first = groups.join(keyed.select(row, "doc_id"), row).groupBy("component_id").agg(least).select(f"least.{row}")
    return keyed.join(first, row, "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_texts(docs.select("doc_id", "text"), vocabulary(), decoded="decoded").select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

#: SQL can't express these stages; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        after = scratch.keep(stage(spark, docs, sf_dir), name)
        if hasattr(docs, "_quill_path"):
            scratch.drop(docs)
        docs = after
    return docs
