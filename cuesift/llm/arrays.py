"""Texts of an Arrow batch as flat byte arrays, and words found in them.

All helpers work on a few megabytes at a time, so a task's memory follows the
slice size and its longest single text, not the batch or the partition.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Text bytes worked on at once.
SLICE_BYTES = 1 << 20

# A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes of words split at ASCII white space: all but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

# Bytes of words made of digits, letters and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64


def kept_by_worker(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gave when this Python worker first asked for ``name``.

    Spark reuses its Python workers, so the value serves all their tasks.
    """
    held = vars(sys.modules.setdefault("__kept_by_worker__", types.ModuleType("__kept_by_worker__")))
    if name not in held:
        held[name] = make()
    return held[name]


def row_key() -> Column:
    """128 bits of a document's id and text; repeated rows share them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the ``n + 1`` bounds of its rows; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    bounds = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column) or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with at most ``limit`` bytes of text, or one longer row."""
    _, bounds = flat(batch.column(name))
    row = 0
    while row < batch.num_rows:
        last = int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1
        last = max(last, row + 1)
        yield batch.slice(row, last - row)
        row = last


def words(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the ``n + 1`` word bounds of the rows.

    A word is a run of bytes with ``member[byte]``; it never spans two rows.
    """
    inside = member[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    filled = bounds[:-1] < bounds[1:]
    heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


class _Powers:
    """Powers of the base and of its inverse, made where they are used."""

    def __init__(self) -> None:
        self.size = 0

    def __getstate__(self) -> dict:
        return {"size": 0}

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if self.size < size:
            self.size = 1 << max(20, size.bit_length())
            self.up = self._run(_BASE)
            self.down = self._run(pow(_BASE, -1, 1 << 64))
        return self.up, self.down

    def _run(self, base: int) -> np.ndarray:
        out = np.full(self.size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_POWERS = _Powers()


def mix(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


# A value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _POWERS.upto(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def joined_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbouring values; rows are not told apart."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    # factors without a simple relation to each other, so that order counts
    factors = mix(np.arange(101, 101 + size, dtype=np.uint64)) | np.uint64(1)
    for place in range(size):
        out += hashes[place : place + n] * factors[place]
    return mix(out)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size``-word shingles and the ``n + 1`` shingle bounds of the rows.

    A row with fewer words, but not none, has its whole sequence as one shingle.
    """
    counts = np.diff(bounds)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(out_bounds[-1], np.uint64)
    long = counts >= size
    if long.any():
        every = joined_hashes(hashes, size)
        first = np.repeat(bounds[:-1][long], made[long])
        place = np.arange(len(first)) - np.repeat(np.cumsum(made[long]) - made[long], made[long])
        out[np.repeat(long, made)] = every[first + place]
    for row in np.flatnonzero((counts > 0) & ~long):
        part = hashes[bounds[row] : bounds[row + 1]]
        out[out_bounds[row]] = joined_hashes(part, len(part))[0]
    return out, out_bounds
