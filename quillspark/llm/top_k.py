"""Exact top-k by inner product, a block of candidates at a time.

Vectors become integers, ``floor(scale * x)``.  Candidates lie in ranges of ids
(range partitions); a task orders its range by the signs along fixed directions, so
that near vectors lie together, and packs them into blocks: a block is a range of that
order, not of ids.  A block has a forward index (its vectors, one row each)
and each dimension's greatest and least value.  For a query, the sum of the
greater of ``q * greatest`` and ``q * least`` bounds the score of any vector of the
block.  Blocks are taken in falling order of that bound and scored through the
forward index until the bound falls below the k-th score so far.

Queries are sent in blocks of at most ``query_block`` vectors, one block's result
written before the next begins.  A first search over one row in ``SEEDS`` gives each
query a score that its k-th is not below; with it, tasks pass over blocks at once and
return only what may be among the best: some k times ``SEEDS`` rows a query, however
many tasks there are, and these are ranked in the end.  Vectors that are
null, hold null or non-finite components, or have another length than most, take
no part.  Rows are told apart, not ids: of rows that share an id each is a query and
a candidate by itself, and a query's own row alone is no candidate for it.  Ties go to
smaller ids; of fewer than k candidates all are returned.  An empty table, or one
without queries, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.common import Scratch, batches

BLOCK, SEEDS = 256, 64
_LOWEST = -(1 << 62)


def sound(vector: str):
    """Whether a vector can take part, as a column."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(vector: str, scale: int):
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def near_order(vectors: np.ndarray) -> np.ndarray:
    """An order in which near vectors lie together: by the signs along a few fixed directions."""
    centred = vectors - vectors.mean(0)
    directions = np.random.default_rng(7).standard_normal((vectors.shape[1], 12))
    bits = (centred @ directions > 0).astype(np.int64)
    return np.lexsort((*bits.T[::-1],)) if len(vectors) else np.empty(0, np.int64)


class Blocks:
    """Forward indexes of one range, with each dimension's greatest and least value by block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = near_order(vectors)
        self.blocks = []
        for lo in range(0, len(order), BLOCK):
            at = order[lo : lo + BLOCK]
            self.blocks.append((ids[at], rows[at], vectors[at]))
        self.greatest = np.array([v.max(0) for *_, v in self.blocks])
        self.least = np.array([v.min(0) for *_, v in self.blocks])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries by blocks: no vector of the block scores more."""
        return np.maximum(queries, 0) @ self.greatest.T + np.minimum(queries, 0) @ self.least.T

    def best(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: int = _LOWEST) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the range for one query row that score ``floor`` at least: ids and scores, best first."""
        ids, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in np.argsort(-bounds, kind="stable"):
            least = max(floor, scores[-1]) if len(ids) == k else floor
            if bounds[b] < least:
                break
            found, rows, vectors = self.blocks[b]
            more = vectors @ query
            good = (rows != own) & (more >= least)
            ids, scores = np.concatenate([ids, found[good]]), np.concatenate([scores, more[good]])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
        return ids, scores


def top_k(df: DataFrame, is_query, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", query_block: int = 16384, range_rows: int = 65536) -> DataFrame:
    """For each row that ``is_query`` (a column) picks: ``query_id``, ``rank`` (from 1), the candidate's key, ``score``."""
    spark = df.sparkSession
    scratch = Scratch(spark, "top-k")
    known = df.where(sound(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), integers(vector, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    common = known.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = common["d"] if common else 0
    rows = known.where(F.size("v") == size)
    ranges = max(spark.sparkContext.defaultParallelism, -(-(common["count"] if common else 0) // range_rows))
    # Written once, so that a row keeps its number.
    rows = scratch.keep(rows.repartitionByRange(ranges, "id").withColumn("row", F.monotonically_increasing_id()), "ranges")
    schema = "query long, query_id long, id long, score long"
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    results: list[DataFrame] = []

    def search(among: DataFrame, queries: tuple[np.ndarray, np.ndarray, np.ndarray], floors: dict[int, int]) -> tuple[DataFrame, object]:
        """``queries``: row numbers, ids, vectors; ``floors`` by row number."""
        sent = spark.sparkContext.broadcast((*queries, np.array([floors.get(int(i), _LOWEST) for i in queries[0]], np.int64)))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = list(batches(parts))
            if not found:
                return
            ids, numbers = (np.concatenate([np.asarray(b.column(c)) for b in found]) for c in (0, 2))
            index = Blocks(ids, numbers, np.concatenate([_matrix(b.column(1)) for b in found]))
            q_rows, q_ids, vectors, least = sent.value
            for lo in range(0, len(q_ids), 512):
                cut = slice(lo, lo + 512)
                best = [index.best(int(i), q, bounds, k, int(f)) for i, q, bounds, f in zip(q_rows[cut], vectors[cut], index.bounds(vectors[cut]), least[cut])]
                sizes = [len(ids) for ids, _ in best]
                columns = [np.repeat(q_rows[cut], sizes), np.repeat(q_ids[cut], sizes), *(np.concatenate(c) for c in zip(*best))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "query_id", "id", "score"])

        return among.select("id", "v", "row").mapInArrow(run, schema), sent

    def answer(block: list) -> None:
        queries = np.array([r.row for r in block], np.int64), np.array([r.id for r in block], np.int64), np.array([r.v for r in block], np.int64)
        seeds, sent = search(rows.where(F.pmod(F.xxhash64("row"), F.lit(SEEDS)) == 0), queries, {})
        kth = seeds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query", "score")
        floors = {r.query: r.score for r in kth.collect()}  # a number for each query of the block
        sent.unpersist()
        found, sent = search(rows, queries, floors)
        results.append(scratch.keep(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best"))
        sent.unpersist()

    block: list = []
    for row in rows.where("q").select("id", "v", "row").toLocalIterator():
        block.append(row)
        if len(block) == query_block:
            answer(block)
            block = []
    if block:
        answer(block)
    if not results:
        return spark.createDataFrame([], f"query_id long, rank int, `{key}` long, score long")
    ranked = results[0]
    for more in results[1:]:
        ranked = ranked.unionByName(more)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
