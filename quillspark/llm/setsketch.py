"""SetSketch registers: exponentially spaced, truncated minima of hashed sets.

A register is ``floor(1 - log_b(x))``, cut to 0..255, where ``x`` is the least of
the set's values in an exponential distribution of rate ``a``.  Registers of a
union are the maxima of both sides' registers, and registers of similar sets tend
to be equal, so that groups of them serve as keys for a candidate search.  From
the counts of greater, smaller and equal registers, and from both sets' sizes,
the Jaccard similarity follows by maximum likelihood.
"""

from __future__ import annotations

import numpy as np

BASE, RATE = 1.2, 20.0
#: Registers of a set, and registers in a key: one key is eight registers, that is one 64-bit word.
REGISTERS, WIDTH = 512, 8
BANDS = REGISTERS // WIDTH
_CHUNK = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        words = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1), words.astype(np.uint32)


FACTORS, SHIFTS = _seeds()


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least 32-bit values of each set under each register's hash.

    ``hashes``: the sets' 64-bit hashes, one set after the other, none empty;
    ``starts``: where each set begins.  Works through chunks that fit a cache;
    the least of a set's chunks is the set's.
    """
    out = np.full((len(starts), REGISTERS), 0xFFFFFFFF, np.uint32)
    ends = np.append(starts[1:], len(hashes))
    first = 0
    while first < len(starts):
        last = first + 1
        while last < len(starts) and ends[last] - starts[first] <= _CHUNK:
            last += 1
        for lo in range(int(starts[first]), int(ends[last - 1]), _CHUNK):
            part = hashes[lo : min(lo + _CHUNK, int(ends[last - 1]))]
            h = (part >> np.uint64(32)).astype(np.uint32) ^ part.astype(np.uint32)
            cuts = np.maximum(starts[first:last] - lo, 0) if last > first + 1 else np.zeros(1, np.int64)
            work = np.empty_like(h)
            for i in range(REGISTERS):
                np.multiply(h, FACTORS[i], out=work)
                np.add(work, SHIFTS[i], out=work)
                least = np.minimum.reduceat(work, cuts)
                np.minimum(out[first:last, i], least, out=out[first:last, i])
        first = last
    return out


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (uint8, one row a set) of non-empty sets; see :func:`minima`."""
    u = (minima(hashes, starts).astype(np.float64) + 0.5) / 2.0**32
    x = -np.log1p(-u) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key (int64) for each band of each set; different bands' keys differ."""
    words = np.ascontiguousarray(regs).view(np.uint64)
    with np.errstate(over="ignore"):
        return mix64(mix64(words) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _greater(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likely_jaccard(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 36) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity.

    ``above``, ``below``: how many of a's registers are greater or smaller than
    b's.  The log likelihood has one peak, which a ternary search finds.
    """
    equal = REGISTERS - above - below
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)
    tiny = 1e-12

    def value(j: np.ndarray) -> np.ndarray:
        p, q = _greater(np.maximum(u - v * j, 0.0)), _greater(np.maximum(v - u * j, 0.0))
        return above * np.log(np.maximum(p, tiny)) + below * np.log(np.maximum(q, tiny)) + equal * np.log(np.maximum(1 - p - q, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(steps):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        left = value(a) < value(b)
        lo, hi = np.where(left, a, lo), np.where(left, hi, b)
    return (lo + hi) / 2


def least_estimate(threshold: float, deviations: float = 4.5) -> float:
    """An estimate below this speaks against a similarity of ``threshold`` by so many standard deviations."""
    return threshold - deviations * (threshold * (1 - threshold) / REGISTERS) ** 0.5
