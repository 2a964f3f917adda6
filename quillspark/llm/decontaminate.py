"""Benchmark decontamination by suffix arrays of the training texts.

Each task packs its documents into shards of about ``shard_words`` words (a longer
document is a shard of its own) and builds a suffix array of each: all places of the
shard in the order of the words that follow, as many as the longest test item has.
Words are numbered by the shard, so that the array does not depend on the tests.
All test suffixes are then searched side by side by bisection, one word deeper at a
time, which gives the places of each suffix's window and its longest verbatim match.
Nothing is shuffled.

A word is a run of digits, letters a-z (A-Z become small) and characters beyond
ASCII.  A window is ``window`` consecutive words of an item; an item of fewer
words, but not none, is one window.  A document's word is hit if it stands inside
an occurrence of any window.

The test items are read and sent to the executors in blocks of at most
``block_bytes`` of text (one item, if that is longer); a larger benchmark takes
several passes, each of which adds to what the last has found and is written down,
after which its block is released.  Null texts have no words.  Items that share an id
count as one, those with a null id too: the list of items has a null for them.
Repeated documents are judged row by row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, batches, bytes_of, make_room, slim_batches

#: Separators become spaces and A-Z become small; the rest, bytes from 0x80 on included, belongs to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text that a task holds before it closes a shard.
_SHARD_BYTES = 32 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class _Numbers(dict):
    """Words numbered from 1 on, as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class Tests:
    """The suffixes of a block of test items, over the block's own vocabulary."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        numbers, texts = _Numbers(), []
        for name, text in items:
            if found := words_of(text):
                texts.append((name, np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))))
        self.words = list(numbers)
        self.names = sorted({n for n, _ in texts}, key=lambda n: (n is None, n or ""))
        place = {n: i for i, n in enumerate(self.names)}
        gap = np.zeros(1, np.int64)
        #: All items, each followed by 0.
        self.flat = np.concatenate([gap[:0], *(x for _, ids in texts for x in (ids, gap))])
        sizes = np.array([len(ids) for _, ids in texts], np.int64)
        needs = np.minimum(sizes, window)
        counts = sizes - needs + 1
        begins = np.cumsum(sizes + 1) - sizes - 1
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        #: Of each suffix with a window: its place in ``flat``, its window's words, its item, its words, and its place in the item.
        self.at, self.need = np.repeat(begins, counts) + inside, np.repeat(needs, counts)
        self.item = np.repeat(np.array([place[n] for n, _ in texts], np.int64), counts)
        self.size, self.inside = np.repeat(sizes, counts) - inside, inside
        self.window, self.longest = window, int(sizes.max(initial=0))


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """All places of ``ids`` (from 0 on) in the order of the ``depth`` numbers, or more, that begin there."""
    n = len(ids)
    rank, done, order = ids, 1, None
    tied = np.arange(n)
    while len(tied):
        bits = max(1, int(rank.max())).bit_length()
        parts = max(2, 63 // bits)
        places = tied if order is None else order[tied]
        key = rank[places]
        for j in range(1, parts):
            ahead = places + j * done
            key = key << bits | np.where(ahead < n, rank[np.minimum(ahead, n - 1)], 0)
        by = np.argsort(key)
        key, places = key[by], places[by]
        if order is None:
            order = places
        else:
            order[tied] = places
        # A place's rank is where its group of equals begins; groups keep their stretch of the order.
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.maximum.accumulate(np.where(begins, tied, 0))
        if rank is ids:
            rank = np.empty(n, np.int64)
        rank[places] = heads + 1
        done *= parts
        if done >= depth:
            break
        alone = begins & np.append(begins[1:], True)
        tied = tied[~alone]
    return np.arange(0) if order is None else order


class Shard:
    """Suffix array over the words of some documents; test suffixes are searched in it."""

    def __init__(self, docs: list[list[bytes]], depth: int):
        numbers = _Numbers()
        gap = np.zeros(1, np.int64)  # 0 is no word, so that no match runs over a document's end
        self.ids = np.concatenate([gap[:0], *(x for d in docs for x in (np.fromiter(map(numbers.__getitem__, d), np.int64, len(d)), gap))])
        self.begins = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])[:-1]])
        self.numbers = numbers
        self.order = suffix_order(self.ids, depth)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.ids, minlength=len(numbers) + 1))])

    def _bound(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        going = np.flatnonzero(lo < hi)
        while len(going):
            mid = (lo[going] + hi[going]) >> 1
            found = self.ids[np.minimum(self.order[mid] + depth, len(self.ids) - 1)]
            right = found <= word[going] if after else found < word[going]
            lo[going[right]] = mid[right] + 1
            hi[going[~right]] = mid[~right]
            going = going[lo[going] < hi[going]]
        return lo

    def _deeper(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of stretches of the order that agree up to ``depth``, the parts whose next word is ``word``."""
        lo = self._bound(lo, hi, depth, word, False)
        return lo, self._bound(lo, hi, depth, word, True)

    def _places(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all stretches, and the stretch of each."""
        sizes = hi - lo
        owner = np.repeat(np.arange(len(lo)), sizes)
        return self.order[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)], owner

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, "right") - 1

    def search(self, tests: Tests) -> tuple[dict[int, list[int]], np.ndarray, dict[int, tuple[int, int, int, int]]]:
        """Per document its items; whether each word is hit; per document its longest match (length, item, word of the document, word of the item)."""
        hit = np.zeros(len(self.ids), bool)
        get = self.numbers.get
        known = np.array([-1, *(get(w, -1) for w in tests.words)], np.int64)
        words = known[tests.flat]
        words[tests.flat == 0] = -1
        live = np.flatnonzero(words[tests.at] > 0)
        lo, hi = self.first[words[tests.at[live]]], self.first[words[tests.at[live]] + 1]
        whole: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for depth in range(1, tests.window + 1):
            full = tests.need[live] == depth
            if full.any():
                whole.append((live[full], lo[full], hi[full]))
            live, lo, hi = live[~full], lo[~full], hi[~full]
            if not len(live):
                break
            lo, hi = self._deeper(lo, hi, depth, words[tests.at[live] + depth])
            good = lo < hi
            live, lo, hi = live[good], lo[good], hi[good]
        if not whole:
            return {}, hit, {}
        suffix, lo, hi = (np.concatenate(c) for c in zip(*whole))
        need = tests.need[suffix]
        # Windows that occur, each once: equal ones have the same stretch.
        _, one, window = np.unique(lo * (tests.window + 1) + need, return_index=True, return_inverse=True)
        places, owner = self._places(lo[one], hi[one])
        edges = np.bincount(places, minlength=len(hit) + 1)[: len(hit) + 1] - np.bincount(places + need[one][owner], minlength=len(hit) + 1)[: len(hit) + 1]
        hit = np.cumsum(edges[:-1]) > 0
        docs = self.doc_of(places)
        pairs = np.unique(docs * len(one) + owner)
        # Items of each window, then items of each document.
        has = np.unique(window * len(tests.names) + tests.item[suffix])
        starts = np.searchsorted(has // len(tests.names), np.arange(len(one) + 1))
        doc, w = pairs // len(one), pairs % len(one)
        n = starts[w + 1] - starts[w]
        item = has[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[w], n)] % len(tests.names)
        items: dict[int, list[int]] = {}
        for x in np.unique(np.repeat(doc, n) * len(tests.names) + item).tolist():
            items.setdefault(x // len(tests.names), []).append(x % len(tests.names))
        return items, hit, self._longest(tests, words, suffix, lo, hi, need)

    def _longest(self, tests: Tests, words: np.ndarray, suffix: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
        best: dict[int, tuple[int, int, int, int]] = {}

        def note(length: int, suffix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            _, one = np.unique(lo, return_index=True)
            places, owner = self._places(lo[one], hi[one])
            by = np.argsort(places)
            docs, first = np.unique(self.doc_of(places[by]), return_index=True)
            for d, at in zip(docs.tolist(), by[first].tolist()):
                s = suffix[one[owner[at]]]
                best[d] = (length, int(tests.item[s]), int(places[at] - self.begins[d]), int(tests.inside[s]))

        for depth in np.unique(need).tolist():
            here = need == depth
            note(depth, suffix[here], lo[here], hi[here])
        here = (need == tests.window) & (tests.size[suffix] > tests.window)
        live, lo, hi, depth = suffix[here], lo[here], hi[here], tests.window
        sizes = np.zeros(len(tests.at), np.int64)
        sizes[live] = hi - lo
        while len(live):
            lo, hi = self._deeper(lo, hi, depth, words[tests.at[live] + depth])
            good = lo < hi
            live, lo, hi = live[good], lo[good], hi[good]
            depth += 1
            if not len(live):
                break
            if depth == tests.window + 1:
                # A window all of whose places continue the suffix before it has no longest match of its own.
                longer = np.zeros(len(tests.at) + 1, np.int64)
                longer[live + 1] = hi - lo
                own = (longer[live] != sizes[live]) | (tests.inside[live] == 0)
                live, lo, hi = live[own], lo[own], hi[own]
            note(depth, live, lo, hi)
            more = tests.size[live] > depth
            live, lo, hi = live[more], lo[more], hi[more]
        return best


_STATE = "n_words long, n_hit long, hits binary, items array<string>, longest struct<words: long, item_id: string, doc_word: long, item_word: long>"
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("hits", pa.binary()),
        ("items", pa.list_(pa.string())),
        ("longest", pa.struct([("words", pa.int64()), ("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64())])),
    ]
)


def _either(a: bytes | None, b: bytes | None) -> bytes | None:
    if a is None or b is None:
        return a or b
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


def _judged(texts: list[bytes], tests: Tests, shard_words: int) -> list[list]:
    """Of each text: number of words, of words hit, bits of words hit (None: none), names of items, longest match."""
    out = n_words, n_hit, hits, items, longest = [], [], [], [], []
    docs: list[list[bytes]] = []

    def flush() -> None:
        shard = Shard(docs, tests.longest)
        found, hit, best = shard.search(tests)
        for d, (words, at) in enumerate(zip(docs, shard.begins.tolist())):
            n_words.append(len(words))
            n_hit.append(int(hit[at : at + len(words)].sum()) if d in found else 0)
            hits.append(np.packbits(hit[at : at + len(words)]).tobytes() if d in found else None)
            items.append([tests.names[i] for i in found.get(d, ())])
            x = best.get(d)
            longest.append(x and {"words": x[0], "item_id": tests.names[x[1]], "doc_word": x[2], "item_word": x[3]})
        docs.clear()

    held = 0
    for text in texts:
        found = words_of(text)
        if docs and held + len(found) > shard_words:
            flush()
            held = 0
        docs.append(found)
        held += len(found) + 1
    if docs:
        flush()
    return out


def _joined(old: list, new: list[list]) -> list[list]:
    """What passes before have found, and what one more has."""
    n_words, _, hits, items, longest = new
    hits = [_either(a["hits"], b) for a, b in zip(old, hits)]
    items = [sorted({*a["items"], *b}, key=lambda n: (n is None, n or "")) for a, b in zip(old, items)]
    longest = [b if a["longest"] is None or b is not None and b["words"] > a["longest"]["words"] else a["longest"] for a, b in zip(old, longest)]
    return [n_words, [int.from_bytes(x or b"").bit_count() for x in hits], hits, items, longest]


def _pass(df: DataFrame, text: str, tests: Tests, shard_words: int, first: bool):
    """The rows with the column ``_state``; and the broadcast that it needs.

    Only texts (and what was found before) go to the workers, and only what is found comes back.
    """
    sent = df.sparkSession.sparkContext.broadcast(tests)

    def shards(parts: Iterator) -> Iterator[pa.Array]:
        tests = sent.value
        held: list[tuple[pa.Array, pa.Array | None]] = []
        size = 0

        def flush() -> Iterator[pa.Array]:
            state = _judged([t for column, _ in held for t in bytes_of(column)], tests, shard_words)
            lo = 0
            for column, old in held:
                found = [c[lo : lo + len(column)] for c in state]
                lo += len(column)
                if old is not None:
                    found = _joined(old.to_pylist(), found)
                yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(found, _ARROW)], fields=list(_ARROW))
            held.clear()

        for part in parts:
            held.append((part, None) if first else part)
            size += held[-1][0].nbytes + len(held[-1][0])
            # About six bytes a word: one shard's worth.
            if size >= min(6 * shard_words, _SHARD_BYTES):
                yield from flush()
                size = 0
        if held:
            yield from flush()

    @F.arrow_udf(_STATE)
    def judged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return shards(parts)

    @F.arrow_udf(_STATE)
    def judged_again(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return shards(parts)

    column = F.col(text).cast("string")
    state = judged.asNondeterministic()(column) if first else judged_again.asNondeterministic()(column, F.col("_state"))
    return df.withColumn("_state", state), sent


def _blocks(benchmark: DataFrame, item_key: str, item_text: str, window: int, block_bytes: int) -> Iterator[Tests]:
    """The test items, one block after the other; at least one block."""
    block: list[tuple[str | None, bytes]] = []
    size = n = 0
    for name, body in benchmark.select(F.col(item_key).cast("string"), F.col(item_text).cast("string")).toLocalIterator():
        data = (body or "").encode()
        if block and size + len(data) > block_bytes:
            yield Tests(block, window)
            block, size, n = [], 0, n + 1
        block.append((name, data))
        size += len(data)
    if block or not n:
        yield Tests(block, window)


def find_overlaps(df: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = 10, shard_words: int = 1 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """Adds ``n_words``, ``n_hit``, ``items`` (sorted ids as strings, null last) and ``longest`` (a longest match and where it stands, or null).

    Columns of these names that are there already are carried as ``<name>_in``.
    """
    df, text = make_room(df, ["n_words", "n_hit", "items", "longest", "_state"], text)
    slim_batches(df.sparkSession)
    scratch = Scratch(df.sparkSession, "overlaps")
    blocks = _blocks(benchmark, item_key, item_text, window, block_bytes)
    out, sent = _pass(df, text, next(blocks), shard_words, True)
    done = None
    for tests in blocks:
        before, done = done, scratch.keep(out, "passes")
        sent.unpersist()
        if before is not None:
            scratch.drop(before)
        out, sent = _pass(done, text, tests, shard_words, False)
    return out.select(*df.columns, *(F.col(f"_state.{n}").alias(n) for n in ("n_words", "n_hit", "items", "longest")))


def decontaminate(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` that hold no occurrence of any window; columns as they were."""
    found = find_overlaps(df, benchmark, **options).where("n_hit = 0")
    # The columns of df come first, in order, whatever they had to be called meanwhile.
    return found.select(*(F.col(c).alias(name) for c, name in zip(found.columns, df.columns)))


def overlap_digests(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: key, ``n_words``, ``n_hit``, ``n_items`` (null counts as one), ``items_sha256`` (null left out), ``contaminated``, ``longest``."""
    found = find_overlaps(df.select(key, text), benchmark, text=text, **options)
    return found.select(key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")
