"""Words, lines and n-gram hashes of whole texts as numpy arrays over the UTF-8 bytes of an Arrow column.

The white space of the word patterns is ASCII, so byte positions cut texts exactly where code points
would. Texts are handled in runs of about ``RUN_BYTES``; only a single longer text makes a longer run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
_SEED = np.random.RandomState(20240607)


def _odd(n: int) -> np.ndarray:
    return _SEED.randint(0, 2**63 - 1, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_CODES = _odd(256)
GRAM_CODES = _odd(64)
BASE = int(_odd(1)[0])
CHECK_CODES = _odd(256)  # for a second hash of the same spans
BLOCK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base & 0xFFFFFFFFFFFFFFFF
    return np.multiply.accumulate(out)


INVERSE = pow(BASE, -1, 2**64)
UP, DOWN = powers(BASE, BLOCK), powers(INVERSE, BLOCK)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its texts; a missing text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets.astype(np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def runs(data: np.ndarray, offsets: np.ndarray, size: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``size`` bytes: first row, end row, their bytes and offsets."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def pieces(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separator bytes inside each text, and the row of each."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Starts, ends and rows of the lines of each text, cut at \n; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    rows = len(offsets) - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:] - 1
    last = np.flatnonzero(np.append(row[1:] != row[:-1], True))
    ends[last] = offsets[row[last] + 1]
    return starts, ends, row


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order that do not overlap; scratch memory is bounded by blocks."""
    out = np.zeros(len(starts), np.uint64)
    size = np.asarray(ends) - starts
    long = np.flatnonzero(size >= BLOCK)
    for i in long:
        out[i] = _long_hash(data[starts[i]:ends[i]], codes)
    k, n = 0, len(starts)
    while k < n:
        if size[k] >= BLOCK:
            k += 1
            continue
        low = starts[k]
        end = int(np.searchsorted(ends, low + BLOCK, side="right"))
        end = max(min(end, n), k + 1)
        high = ends[end - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(codes[data[low:high]] * UP[:high - low], out=sums[1:])
        s, e = starts[k:end] - low, ends[k:end] - low
        out[k:end] = (sums[e] - sums[s]) * DOWN[s]
        k = end
    return mix(out ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def _long_hash(data: np.ndarray, codes: np.ndarray) -> np.uint64:
    total, lift = 0, 1
    step = pow(BASE, BLOCK - 1, 2**64)
    for at in range(0, len(data), BLOCK - 1):
        part = data[at:at + BLOCK - 1]
        total += int((codes[part] * UP[:len(part)]).sum(dtype=np.uint64)) * lift
        lift = lift * step % 2**64
    return np.uint64(total % 2**64)


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive items of one row: index of the first item, hash."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += hashes[j:j + m] * (GRAM_CODES[j] if j < len(GRAM_CODES) else mix(np.array([j], np.uint64))[0] | np.uint64(1))
    first = np.flatnonzero(row[:m] == row[n - 1:])
    return first, mix(total[first] ^ np.uint64(n))


def counts(row: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(row, weights, minlength=rows).astype(np.int64)


def code_points(data: np.ndarray) -> np.ndarray:
    """n + 1 running counts of code points before each byte."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def repeated(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each value whether it occurs twice or more in its row."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    same = np.zeros(len(v), bool)
    if len(v) > 1:
        equal = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
        same[1:] = equal
        same[:-1] |= equal
    out = np.zeros(len(v), bool)
    out[order] = same
    return out


def later_copies(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row the number of values that equal an earlier one."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    again = np.flatnonzero((v[1:] == v[:-1]) & (r[1:] == r[:-1])) + 1
    return counts(r[again], rows)
