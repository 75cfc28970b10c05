"""Numpy kernels over the bytes of a batch of texts: spans, rolling hashes, sliding minima.

A batch is one byte array with row offsets, straight from Arrow's string buffers, so no
Python string is made. Callers cut batches into chunks (``chunks``) so that temporaries
stay a small multiple of ``CHUNK_BYTES`` however long a batch or a text is; one text is
never cut here.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null row is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of a single longer row."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set on the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACE = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_WORD = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row) of the maximal runs of other bytes; no run crosses a row."""
    inside = ~separators[data]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1]
    before[firsts[firsts < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    lasts = offsets[1:] - 1
    after[lasts[lasts >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * _U(pow(base, done, 1 << 64))
        done += step
    return out


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(16, int(n).bit_length())
    return _powers(base, size)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte codes times powers: any span's hash is a difference of two of them."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(BYTE_CODES[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, the same wherever it stands."""
    inverse = powers(BASE_INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def gram_hash(codes: np.ndarray, k: int, salt: int = 1) -> np.ndarray:
    """Hash of every k consecutive codes, from index 0 to len - k."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for j in range(k):
        total += codes[j : j + n] * _U(pow(BASE + 2 * salt, k - j, 1 << 64))
    return mix(total)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values; doubling, so about log2(width) passes."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:])[:n] if rest else out[:n]


def ranges_cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of the n places covered by any [start, end)."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.subtract.at(edge, ends, 1)
    return np.cumsum(edge[:-1]) > 0


def row_windows(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, row) of every ``width`` consecutive units inside one row."""
    ends = np.cumsum(counts)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(max(len(rows) - width + 1, 0))
    rows = rows[: len(first)]
    inside = first + width <= ends[rows]
    return first[inside], rows[inside]


def has_bits(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def bit_majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per row the 64-bit word whose bits are those set in over half of its hashes (zero without any).

    Bits are summed eight at a time in byte lanes over blocks of at most 255 hashes.
    """
    out = np.zeros(len(counts), _U)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    blocks = -(-n // 255)
    first_block = np.cumsum(blocks) - blocks
    row = np.repeat(np.arange(len(full)), blocks)
    starts = (np.cumsum(n) - n)[row] + 255 * (np.arange(len(row)) - first_block[row])
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> _U(bit)) & _U(0x0101010101010101), starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_block, axis=0)
        over = (2 * sums > n[:, None]).astype(np.uint8)
        out[full] |= np.ascontiguousarray(over).view(_U).ravel() << _U(bit)
    return out
