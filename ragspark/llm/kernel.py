"""Numpy helpers used inside Arrow tasks: blocks of documents as bytes, spans and their hashes.

Nothing here knows about Spark's scheduling; a caller passes the Arrow batches of its partition.
A block joins documents by newline bytes, so that no word or line crosses a document, and is closed
at ``BLOCK`` bytes.  A longer document is a block of its own; memory follows the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20
PIECE = 1 << 20
SPACE = b" \t\n\x0b\x0c\r"


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, list[bytes]]]:
    """Ranges of rows of at most ``most`` bytes together (or one row) with their bytes, one range at a time."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            yield start, i, blobs(column.slice(start, i - start))
            start, size = i, 0
        size += n + 1
    if start < len(sizes):
        yield start, len(sizes), blobs(column.slice(start))


def joined(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a block, a newline after each item, and the n + 1 bounds of the items."""
    bounds = np.zeros(len(items) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in items], out=bounds[1:])
    return np.frombuffer(b"\n".join(items) + b"\n", np.uint8), bounds


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Membership table of bytes, from inclusive ranges."""
    table = np.zeros(256, np.bool_)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


def not_space() -> np.ndarray:
    """Bytes of ``[^\\x20\\x09-\\x0D]``; every byte of a non-ASCII character belongs."""
    return ~byte_set((0x20, 0x20), (0x09, 0x0D))


def spans(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last element must be False."""
    edge = np.flatnonzero(member[1:] != member[:-1]) + 1
    if len(member) and member[0]:
        edge = np.concatenate((np.zeros(1, np.int64), edge))
    return edge[0::2], edge[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit words: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class SpanHash:
    """64-bit polynomial hashes of byte spans, a piece of the buffer at a time."""

    def __init__(self, seed: int = 7):
        self.value = np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.grow(PIECE)

    def grow(self, size: int) -> None:
        def powers(b: int) -> np.ndarray:
            p = np.full(size + 1, b % 2**64, np.uint64)
            p[0] = 1
            return np.cumprod(p)

        self.power, self.inverse = powers(self.base), powers(pow(self.base, -1, 2**64))

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ordered, disjoint spans; equal bytes give equal hashes, an empty span gives mix(0)."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            if hi - lo >= len(self.power):
                self.grow(hi - lo)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(self.value[buf[lo:hi]] * self.power[: hi - lo], out=total[1:])
            s = starts[i:j] - lo
            out[i:j] = (total[ends[i:j] - lo] - total[s]) * self.inverse[s]
            i = j
        return mix(out)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.zeros(len(counts), np.int64)
    np.cumsum(counts[:-1], out=shift[1:])
    return np.arange(total, dtype=np.int64) + np.repeat(starts - shift, counts)


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` positions lie in any of the ranges [start, end)."""
    depth = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(depth[:size]) > 0


def per_item(flags: np.ndarray, positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` of the ordered ``positions`` that fall between neighbouring bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    cut = np.searchsorted(positions, bounds)
    return total[cut[1:]] - total[cut[:-1]]
