"""Vectorised work on the UTF-8 bytes of a batch of texts (numpy, no per-character Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random odd-free 64-bit value for each byte, and the base of the rolling sums.
RANDOM = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
BASE = U(0x9E3779B97F4A7C15)
BASE2 = U(0xD1342543DE82EF95)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def inverse(odd: int) -> int:
    return pow(int(odd), -1, 2**64)


class Powers:
    """base**i and base**-i modulo 2**64 for i up to the longest buffer so far."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 18)
            for name, base in (("up", self.base), ("down", U(inverse(self.base)))):
                powers = np.full(size, base, U)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=U))
        return self.up[:n], self.down[:n]


POWERS, POWERS2 = Powers(BASE), Powers(BASE2)


def prefix_sums(values: np.ndarray, powers: Powers) -> np.ndarray:
    """sums[i] = sum of values[j] * base**j over j < i."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], dtype=U, out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of the values between start and end, wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def chunks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes. Null is empty."""
    column = column.fill_null("") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(len(column), max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of all words: runs of bytes that are not ASCII white space, lower case A-Z."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    inner = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets[offsets <= n]] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inner[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inner[1:]
    starts = np.flatnonzero(inner & (edge[:-1] | ~before))
    ends = np.flatnonzero(inner & (edge[1:] | ~after)) + 1
    sums = prefix_sums(RANDOM[LOWER[data]], POWERS)
    docs = np.searchsorted(offsets, starts, "right") - 1
    return span_hash(sums, starts, ends, POWERS), docs


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each document its distinct shingles of ``size`` words, sorted; one shingle of all words
    if there are fewer, none if there are no words."""
    hashes, docs = words(data, offsets)
    weight = mix(np.arange(1, size + 1, dtype=U) * BASE) | U(1)
    n = len(hashes)
    runs = np.zeros(max(0, n - size + 1), U)
    for k in range(size):
        runs += hashes[k : n - size + 1 + k] * weight[k] if n >= size else U(0)
    runs = mix(runs)
    at = np.searchsorted(docs, np.arange(len(offsets)))
    for d in range(len(offsets) - 1):
        a, b = at[d], at[d + 1]
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        elif b > a:
            with np.errstate(over="ignore"):
                yield mix((hashes[a:b] * weight[: b - a]).sum(keepdims=True, dtype=U) + U(b - a) * BASE2)
        else:
            yield runs[:0]
