"""Token counts by a two-tier lookup on the map side.

First tier: a compact table of the lengths (in tokens) of frequent pre-tokens,
broadcast: at most ``table_size`` pre-tokens of at most ``WORD_CHARS`` characters each.
It is made in one task from a bounded sample: ``sample`` rows, of which no more is read
than ``sample_bytes``.  The sample settles speed alone, as the table's lengths are
exact and a pre-token that it lacks goes to the second tier: it is merged in full and
its length kept in a cache of the worker, bounded in bytes.  All texts are counted
whole, each read once, and no pre-token is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import batches, slim_batches, texts_of
from quillspark.llm.word_bpe import WORD_CHARS, WordBpe, cost_of


def frequent_lengths(df: DataFrame, path: str, text: str, table_size: int, sample: int, sample_bytes: int) -> tuple[str, bytes]:
    """Frequent pre-tokens of the sample, line by line, and the length of each in tokens (those of 255 and more are left out)."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, counts, room = WordBpe(path), Counter(), sample_bytes
        for batch in batches(rows):
            for t in texts_of(batch.column(0)):
                if room <= 0:
                    break
                room -= len(t)
                for _, words in codec.parts(t):
                    counts.update(words)
        top = sorted((-n, w) for w, n in counts.items() if len(w) <= WORD_CHARS)[:table_size]
        lengths = [(w, len(codec.encode_word(w))) for _, w in top]
        lengths = [(w, n) for w, n in lengths if n < 255]
        yield pa.RecordBatch.from_arrays([pa.array(["\n".join(w for w, _ in lengths)]), pa.array([bytes(n for _, n in lengths)], pa.binary())], names=["words", "lengths"])  # pre-tokens hold no line ends

    n = df.count()
    some = df.select(text) if n <= sample else df.select(text).where(F.rand(17) < 1.2 * sample / n).limit(sample)
    found = some.coalesce(1).mapInArrow(count, "words string, lengths binary").first()
    return (found.words, bytes(found.lengths)) if found else ("", b"")


class _Lengths(dict):
    """Length of a pre-token: the broadcast table's, else merged here and kept, in bounded memory."""

    def __init__(self, table: dict[str, int], codec: WordBpe, cache_bytes: int):
        super().__init__(table)
        self.table, self.codec, self.most, self.room = table, codec, cache_bytes, cache_bytes

    def __missing__(self, word: str) -> int:
        out = len(self.codec.encode_word(word))
        if len(word) <= WORD_CHARS:
            self.room -= cost_of(word)
            if self.room < 0:
                self.clear()
                self.update(self.table)
                self.room = self.most
            self[word] = out
        return out


def count_tokens(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048, table_size: int = 16384, sample: int = 2048, sample_bytes: int = 32 << 20, cache_bytes: int = 96 << 20) -> DataFrame:
    """Per row: key, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    A null text counts as empty (0 bytes, 0 tokens).  Each row gives one row, in
    ties and repeats as well; an empty table gives an empty one.  Columns other
    than key and text are not read.
    """
    spark = df.sparkSession
    slim_batches(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(df, path, text, table_size, sample, sample_bytes))
    schema = T.StructType([df.schema[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordBpe(path)
        names, sizes = table.value
        lengths = _Lengths(dict(zip(names.split("\n"), sizes)) if sizes else {}, codec, cache_bytes)
        length = lengths.__getitem__
        for batch in batches(rows):
            n_bytes, n_tokens = [], []
            for t in texts_of(batch.column(1)):
                n_bytes.append(len(t.encode()))
                n_tokens.append(sum(sum(map(length, words)) if special is None else 1 for special, words in codec.parts(t)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
