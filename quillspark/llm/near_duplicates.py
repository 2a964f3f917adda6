"""Near-duplicate groups of texts by SetSketch registers, confirmed on full sets.

A text's set holds its distinct shingles of ``words`` consecutive words (white
space ends a word, letters A-Z become small); a shorter text is one shingle, and
a text without words (or null) is the empty set, linked with nothing.  Two sets
are linked from a similarity of ``percent`` per cent on.

1.  One pass makes each text's set key and registers.  Equal sets fold into one
    representative, the least id, before anything else is compared.
2.  Keys of eight registers put representatives into buckets.  A bucket first
    links each member with its least one only: one pair a text.  Confirmed links
    make first components.
3.  What is left are pairs in one bucket but in different components.  All buckets
    with the same largest component (the hub) are taken together, each member once,
    and members outside of the hub are compared with all, block by block.  A first
    pass compares registers alone and keeps the members that have a partner whose
    likely similarity is not clearly below the threshold.  The second pass has
    their texts too and confirms such pairs on full sets, each text's likeliest
    partners first and none that has come into its component meanwhile.  Rows are
    members of blocks, never pairs: n copies give about n rows for each block.
4.  Components of all links give each text the least id that it can reach.

Thus every pair that shares a bucket is linked, refused or within one component.
A pair at the threshold shares no bucket with a probability of about one in a
million, independent of the table's size.

Rows with a null id have a null component and are kept.  Repeated rows of an id
are copies.  If an id comes with several texts, each row is judged by its own
text, except that comparisons use one text of those for which the id stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import setsketch as S
from quillspark.llm.common import Scratch, WordHashes, batches, beside, bytes_of, slim_batches
from quillspark.llm.components import component_roots

_S_BLOCK, _A_BLOCK = 256, 1024


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text's word hashes."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        acc = words[: n - k + 1].copy()
        for j in range(1, k):
            acc = S.mix64(acc) * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j]
        return np.unique(S.mix64(acc + np.uint64(k)))


def _hashes(data: bytes, seen: WordHashes) -> np.ndarray:
    words = data.lower().split()  # of bytes: A-Z, and white space 09-0D and 20, only
    return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def _sketches(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen = WordHashes()
        for batch in batches(rows):
            sets = [shingle_set(_hashes(t, seen), words) for t in bytes_of(batch.column(1))]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            regs: list[bytes | None] = [None] * len(sets)
            if len(full):
                found = S.registers(np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]]))
                for i, r in zip(full, found):
                    regs[i] = r.tobytes()
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], names=["id", "n", "set_key", "regs"])

    return df.select(F.col(key).cast("long"), text).mapInArrow(run, "id long, n long, set_key binary, regs binary")


def _bands(reps: DataFrame) -> DataFrame:
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, S.REGISTERS)
            keys = S.band_keys(regs)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), S.BANDS)), pa.array(np.tile(np.arange(S.BANDS, dtype=np.int8), len(regs))), pa.array(keys.ravel())], names=["id", "band", "bucket"])

    return reps.select("id", "regs").mapInArrow(run, "id long, band byte, bucket long")


#: Bits of the filter that picks texts before they are shuffled: 4 MB, whatever the table's size.
_FILTER_BITS = 1 << 25


def _filter_places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = S.mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return h % np.uint64(_FILTER_BITS), (h >> np.uint64(32)) % np.uint64(_FILTER_BITS)


def _texts(df: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """``id, t`` of the rows whose key is among ``ids(id)``.

    A Bloom filter of fixed size drops most other rows where they are read, so
    that only texts that are needed are shuffled; the join then is exact.
    """

    def words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            places = np.concatenate(_filter_places(np.asarray(batch.column(0))))
            word, bit = (places >> np.uint64(6)).astype(np.int64), np.uint64(1) << (places & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], names=["word", "bits"])

    found = ids.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(_FILTER_BITS // 64, np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    sent = df.sparkSession.sparkContext.broadcast(bits)

    def pick(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            known = batch.filter(batch.column(0).is_valid())
            if not known.num_rows:
                continue
            hit = np.ones(known.num_rows, bool)
            for places in _filter_places(np.asarray(known.column(0))):
                hit &= (sent.value[(places >> np.uint64(6)).astype(np.int64)] >> (places & np.uint64(63))) & np.uint64(1) == 1
            if hit.any():
                yield known.filter(pa.array(hit))

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(pick, "id long, t string").join(ids, "id", "left_semi")


def _confirmed(pairs: DataFrame, df: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = _texts(df, ids, key, text)
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sets = WordHashes(), {}

        def of(i: int, data: bytes) -> np.ndarray:
            kept = sets.get(i)
            if kept is None or kept[0] != data:
                if len(sets) >= 512:
                    sets.clear()
                sets[i] = kept = (data, shingle_set(_hashes(data, seen), words))
            return kept[1]

        for batch in batches(batches_):
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for x, y, tx, ty in zip(a, b, bytes_of(batch.column(2)), bytes_of(batch.column(3))):
                p, q = of(x, tx), of(y, ty)
                both = len(np.intersect1d(p, q, assume_unique=True))
                good.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long").distinct()


def _survivors(regs_s: np.ndarray, n_s: np.ndarray, regs_a: np.ndarray, n_a: np.ndarray, wanted: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Wanted pairs (rows of s and of a) that share a key and whose likely similarity, also given, is not clearly too low."""
    least = S.least_estimate(percent / 100)
    wanted &= 100 * np.minimum(n_s[:, None], n_a[None, :]) >= percent * np.maximum(n_s[:, None], n_a[None, :])
    x, y = np.nonzero(wanted)
    words_s, words_a = regs_s.view(np.uint64), regs_a.view(np.uint64)
    out = []
    for cut in range(0, len(x), 16384):
        p, q = x[cut : cut + 16384], y[cut : cut + 16384]
        shares = (words_s[p] == words_a[q]).any(1)
        p, q = p[shares], q[shares]
        above, below = np.count_nonzero(regs_s[p] > regs_a[q], 1), np.count_nonzero(regs_s[p] < regs_a[q], 1)
        likely = S.likely_jaccard(above, below, n_s[p], n_a[q])
        good = likely >= least
        out.append((p[good], q[good], likely[good]))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out))


class _Block:
    """The members of one block: those outside of the hub (side 0) and those to compare them with (side 1)."""

    def __init__(self, rows: pa.Table):
        take = lambda c: rows.column(c).to_numpy()
        self.rows, self.side, self.ids, self.comp, self.n, self.hub = rows, take("side"), take("id"), take("comp"), take("n"), take("hub")[0]
        self.regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint8).reshape(-1, S.REGISTERS)

    def survivors(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of s, rows of a and likely similarities, some rows of s at a time."""
        left, right = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)
        for lo in range(0, len(left), 64):
            s = left[lo : lo + 64]
            wanted = (self.comp[s][:, None] != self.comp[right][None, :]) & ((self.comp[right] == self.hub)[None, :] | (self.ids[s][:, None] < self.ids[right][None, :]))
            p, q, likely = _survivors(self.regs[s], self.n[s], self.regs[right], self.n[right], wanted, percent)
            yield s[p], right[q], likely


def _by_block(rows: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
    """Calls ``use`` on each block of rows that are sorted by hub, i, j."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches(rows):
        keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(3)], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if last is not None and tuple(keys[lo]) != last:
                yield from use(pa.Table.from_batches(kept))
                kept.clear()
            last = tuple(keys[lo])
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield from use(pa.Table.from_batches(kept))


_ROW = "hub long, i int, j int, side byte, id long, comp long, n long, regs binary"


def _blocks(members: DataFrame) -> DataFrame:
    """Members (hub, id, comp, n, regs, and the hub's total and rest) dealt to blocks."""
    n_s, n_a, spread = F.ceil(F.col("rest") / _S_BLOCK).cast("int"), F.ceil(F.col("total") / _A_BLOCK).cast("int"), F.xxhash64("id")
    left = members.where("comp != hub").select("hub", F.pmod(spread, n_s).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), n_a - 1)).alias("j"), F.lit(0).cast("byte").alias("side"), "id", "comp", "n", "regs")
    right = members.select("hub", F.explode(F.sequence(F.lit(0), n_s - 1)).alias("i"), F.pmod(spread, n_a).cast("int").alias("j"), F.lit(1).cast("byte").alias("side"), "id", "comp", "n", "regs")
    return left.unionByName(right)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "side", "id")


def _with_partners(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of blocks that have a partner left, by registers alone."""

    def use(table: pa.Table) -> Iterator[pa.RecordBatch]:
        block = _Block(table)
        needed = np.zeros(table.num_rows, bool)
        for s, a, _ in block.survivors(percent):
            needed[s] = needed[a] = True
        if needed.any():
            yield from table.filter(pa.array(needed)).combine_chunks().to_batches()

    return _dealt(rows).mapInArrow(lambda rows: _by_block(rows, use), _ROW)


def _block_links(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links among blocks whose rows carry the text as ``t``, as many as join components."""

    def links(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHashes()

        def use(table: pa.Table) -> Iterator[pa.RecordBatch]:
            block, texts = _Block(table), bytes_of(table.column("t").combine_chunks())
            sets: dict[int, np.ndarray] = {}
            parent: dict[int, int] = {}

            def root(c: int) -> int:
                while parent.setdefault(c, c) != c:
                    parent[c] = c = parent[parent[c]]
                return c

            def of(row: int) -> np.ndarray:
                i = int(block.ids[row])
                if i not in sets:
                    sets[i] = shingle_set(_hashes(texts[row], seen), words)
                return sets[i]

            out = []
            for s, a, likely in block.survivors(percent):
                for row in np.unique(s):
                    mine = s == row
                    order = a[mine][np.argsort(-likely[mine], kind="stable")]
                    own, c = of(row), int(block.comp[row])
                    for lo in range(0, len(order), 16):
                        more = [r for r in order[lo : lo + 16] if root(int(block.comp[r])) != root(c)]
                        if not more:
                            continue
                        others = [of(r) for r in more]
                        both = np.concatenate(others)
                        at = np.minimum(np.searchsorted(own, both), len(own) - 1)
                        common = np.add.reduceat(own[at] == both, np.concatenate([[0], np.cumsum([len(o) for o in others])[:-1]]), dtype=np.int64)
                        for r, o, n in zip(more, others, common.tolist()):
                            if 100 * n >= percent * (len(own) + len(o) - n) and root(int(block.comp[r])) != root(c):
                                parent[root(int(block.comp[r]))] = root(c)
                                out.append((int(block.ids[row]), int(block.ids[r])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

        return _by_block(rows, use)

    return _dealt(rows).mapInArrow(links, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row: key, ``n_shingles``, ``component_id`` and ``kept`` (the key is the component's least)."""
    spark = df.sparkSession
    slim_batches(spark)
    scratch = Scratch(spark, "near-duplicates")
    found = scratch.keep(_sketches(df, key, text, words), "sketches")

    copies = found.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("set_key", "rep")
    # One set may be that of a third of all rows.
    rows = beside(found, copies, ["set_key"], ["id"], "left").select("id", "n", "regs", F.coalesce("rep", "id").alias("rep"))
    rows = scratch.keep(rows.select("id", "n", "rep", F.when(F.expr("id = rep"), F.col("regs")).alias("regs")), "rows")
    scratch.drop(found)
    reps = rows.where("regs is not null").dropDuplicates(["id"]).select("id", "n", "regs") if _repeats(rows) else rows.where("regs is not null").select("id", "n", "regs")

    bands = _bands(reps)
    buckets = scratch.keep(bands.groupBy("bucket").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("total")).where("total > 1"), "buckets")
    members = scratch.keep(bands.join(buckets.select("bucket", "low"), "bucket"), "members")
    scratch.drop(buckets)

    tried = scratch.keep(members.where("low < id").groupBy("id").agg(F.min("low").alias("low")).select(F.col("low").alias("a"), F.col("id").alias("b")), "first-pairs")
    links = scratch.keep(_confirmed(tried, df, key, text, words, percent), "first-links")
    roots = component_roots(links, scratch)
    scratch.drop(tried, links)

    placed = members.join(roots.withColumnRenamed("node", "id"), "id", "left").select("bucket", "band", "id", F.coalesce("root", "id").alias("comp"))
    placed = scratch.keep(placed, "placed")
    parts = placed.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = parts.groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("hub"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
    hubs = scratch.keep(placed.join(mixed, "bucket").select("hub", "id", "comp").distinct(), "hubs")
    sizes = hubs.groupBy("hub").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("comp != hub")).alias("rest"))
    # One hub may hold most members.
    blocks = _blocks(beside(hubs, sizes, ["hub"], ["id"]).join(reps, "id"))
    left = scratch.keep(_with_partners(blocks, percent), "with-partners")
    scratch.drop(members, placed, hubs)
    needed = _texts(df, left.select("id").distinct(), key, text).dropDuplicates(["id"])
    more = scratch.keep(_block_links(left.join(needed, "id").select(*left.columns, "t"), words, percent), "second-links")
    scratch.drop(left)

    by = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"r{name}"))
    lifted = more.join(by("a"), "a", "left").join(by("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = component_roots(lifted, scratch)
    scratch.drop(more)
    final = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    final = final.unionByName(tops)  # the nodes of tops are roots or stand alone, so none is there twice
    out = rows.select("id", "n", "rep").join(final.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.coalesce("root", "rep")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _repeats(rows: DataFrame) -> bool:
    """Whether an id stands for several sets."""
    a = rows.where("regs is not null").agg(F.count("id"), F.countDistinct("id")).first()
    return a[0] != a[1]
