"""Word and shingle hashes of whole texts, many texts at a time, in numpy.

A word is a run of characters other than space and U+0009 to U+000D. Its hash is a polynomial of its
UTF-8 bytes, the same wherever the word stands, so equal words have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SLICE = 1 << 20


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(size, x, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return tuple(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slice_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a slice that begins and ends between words."""
    space = _SPACES[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    power, inverse = _powers(1 << max(20, (len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def hashes(texts: list[str | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and how many words each text has."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    offsets = np.cumsum([len(c) + 1 for c in coded])
    starts, found, at = [], [], 0
    while at < len(data):
        end = min(at + _SLICE, len(data))
        while end < len(data) and not _SPACES[data[end - 1]]:  # on to the end of the word
            more = np.flatnonzero(_SPACES[data[end : end + 4096]])
            end = end + int(more[0]) + 1 if len(more) else min(end + 4096, len(data))
        s, h = _slice_hashes(data[at:end])
        starts.append(s + at)
        found.append(h)
        at = end
    ends = np.searchsorted(np.concatenate(starts), offsets)
    return np.concatenate(found), np.diff(ends, prepend=0)


def combine(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of `width` consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(_BASE) + words[j : j + n]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128, n_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in parts of at most that many rows and about that much text, so that memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(sizes, base + n_bytes))))
            yield batch.slice(at, end - at)
            at = end


class Bits:
    """A set of hashes as a bit table of bounded size: it never misses a member, and holds few others."""

    def __init__(self, table: np.ndarray, log2: int):
        self.table, self.log2 = table, log2

    def has(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for place in places(x, self.log2):
            out &= (self.table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return out


def places(x: np.ndarray, log2: int) -> list[np.ndarray]:
    shift = np.uint64(64 - log2)
    return [x >> shift, (x * np.uint64(0xD6E8FEB86659FD93)) >> shift]
