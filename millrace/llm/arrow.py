"""Words and word hashes of a whole Arrow string column at once, as numpy arrays.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return, so they are the matches of `[^\\x20\\x09-\\x0D]+`. Hashes depend on the bytes alone: every
executor and every rerun gives the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text worked on at once; about 40 bytes of memory are used for each.
BLOCK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _STEP
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64)) | np.uint64(1)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and len + 1 offsets. A null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    found = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return found[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many bytes of text each; a longer text is a range of its own."""
    _, at = raw(column)
    start = 0
    while start < len(column):
        end = int(np.searchsorted(at, at[start] + size, "right")) - 1
        end = min(len(column), max(end, start + 1))
        yield start, end
        start = end


def words(column: pa.Array, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, then for each word its first byte, the byte after its last, and its row.

    `outside` marks the bytes that are in no word.
    """
    data, at = raw(column)
    inside = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[edge[:-1]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return data, starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span. Spans ascend and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    done = np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            last = int(np.searchsorted(done, done[first] + BLOCK_BYTES, "right")) - 1
            last = min(len(starts), max(last, first + 1))
            size = lengths[first:last]
            begin = done[first:last] - done[first]
            place = np.arange(done[last] - done[first]) - np.repeat(begin, size)
            power = np.full(int(size.max(initial=0)) + 1, _BASE, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            value = _BYTE[data[place + np.repeat(starts[first:last], size)]] * power[place]
            full = size > 0
            if full.any():
                out[first:last][full] = np.add.reduceat(value, begin[full])
            first = last
        return mix(out + lengths.astype(np.uint64))


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of `width` words. A row with fewer words has one run of them all."""
    count = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    runs = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    row = np.repeat(np.arange(n_rows), runs)
    begin = np.repeat(first, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    size = np.minimum(count, width)[row]
    found = np.zeros(len(row), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            there = size > k
            found[there] = mix(found[there] * _BASE + hashes[begin[there] + k])
    return found, row
