"""Verbs that make values: identifiers and numbers in sequence."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.kernel import S, constant, integer, text, whole
from quillspark.functions.numeric import _LOW, _times, text_seed
from quillspark.functions.registry import verb

#: The alphabet of short identifiers.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_-"
ORDER = "_ord"


def _xor_hash(codes, start: int):
    return F.aggregate(codes, F.lit(start).cast("bigint"), lambda h, c: (h * 33).bitwiseXOR(c).bitwiseAND(F.lit(_LOW)))


def _signed_shift(h, bits: int):
    """A shift to the right of a 32-bit number that keeps its sign; the low byte of it."""
    signed = F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)
    return F.shiftright(signed, bits).bitwiseAND(F.lit(0xFF))


@verb("uuid", least=0)
def uuid(seed=None):
    """Random; or from two hashes of a seed, with the bits of version 5 set."""
    if seed is None or seed.is_null:
        return text(F.uuid())
    codes = F.transform(F.filter(F.split(S(seed), ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("bigint"))
    a, b = _xor_hash(codes, 5381), _xor_hash(codes, 52711)
    octets = [_signed_shift(h, 4 * i) for h in (a, b) for i in range(8)]
    octets[6] = octets[6].bitwiseAND(F.lit(0x0F)).bitwiseOR(F.lit(0x50))
    octets[8] = octets[8].bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))
    h = F.lower(F.concat(*(F.lpad(F.hex(o), 2, "0") for o in octets)))
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    return text(F.when(seed.col.isNotNull(), made).otherwise(F.uuid()))


@verb("nanoid", least=0)
def nanoid(size=None, seed=None):
    n = F.greatest(F.coalesce(whole(size), F.lit(21)), F.lit(1)) if size is not None else F.lit(21)
    letters = F.array(*(F.lit(c) for c in ALPHABET))
    if seed is None or seed.is_null:
        return text(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda _: F.get(letters, F.floor(F.rand() * len(ALPHABET)).cast("int"))), ""))
    start = text_seed(S(seed), 5381, False)

    def number(k):
        s = (start + k * F.lit(0x6D2B79F5)).bitwiseAND(F.lit(_LOW))
        t = _times(s.bitwiseXOR(F.shiftright(s, 15)), s.bitwiseOR(F.lit(1)))
        u = _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))
        t = t.bitwiseXOR((t + u).bitwiseAND(F.lit(_LOW)))
        return t.bitwiseXOR(F.shiftright(t, 14)).bitwiseAND(F.lit(0x3F))

    return text(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: F.get(letters, F.pmod(number(k.cast("bigint")), F.lit(len(ALPHABET))).cast("int"))), ""))


@verb("sequence", least=0)
def sequence(name=None, start=None, *within):
    """A running number over the rows in the order of the column ``_ord``, by partition of further arguments.

    Without them all rows are numbered in one task; large tables are numbered by
    :func:`quillspark.operators.relational.numbered`, which keeps its tasks.
    """
    first = int(constant(start, 1)) if start is not None else 1
    w = Window.partitionBy(*(v.col for v in within)).orderBy(ORDER)
    return integer(F.row_number().over(w) + (first - 1))


@verb("resetSequence")
def reset_sequence(name, to=None):
    """The value it is set to."""
    return integer(F.lit(int(constant(to, 0)) if to is not None else 0))
