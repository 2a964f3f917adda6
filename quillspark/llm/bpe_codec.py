"""BPE encoding and decoding of a text column.

No shuffle and no shared state: each worker loads the vocabulary file (its path
is a parameter), encodes whole texts and decodes the ids again.  A null text is
the empty text; it has no ids and decodes to the empty text.  Rows stay as they
are, repeated or not; other columns are carried along, those that have the name of
a new column under ``<name>_in``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillspark.llm.common import batches, make_room, slim_batches, texts_of
from quillspark.llm.word_bpe import WordBpe


def encode_texts(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Adds ``ids`` (array<int>) and, if named, ``decoded``: the ids' text."""
    df, text = make_room(df, [ids, *([decoded] if decoded else [])], text)
    slim_batches(df.sparkSession)
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema.add(decoded, T.StringType())

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordBpe(path)
        for batch in batches(rows):
            found = [codec.encode(t) for t in texts_of(batch.column(at))]
            more = [pa.array(found, pa.list_(pa.int32()))]
            if decoded:
                more.append(pa.array(map(codec.decode, found), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, ids, *([decoded] if decoded else [])])

    return df.mapInArrow(run, schema)


def codec_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_tokens``, ``ids_sha256`` (decimal ids joined by a space), ``decoded_sha256``.

    Encodes and decodes as :func:`encode_texts` does, but sends back digests.
    """
    slim_batches(df.sparkSession)
    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordBpe(path)
        decimal = codec.decimal.__getitem__
        for batch in batches(rows):
            n, ids_sha, text_sha = [], [], []
            for t in texts_of(batch.column(1)):
                ids = codec.encode(t)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
