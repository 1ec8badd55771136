"""Counts of distinct byte spans inside a task, before Spark adds them up over tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import bytewords as B

#: Bytes of text counted together; a longer run repeats fewer words over its rows.
COUNT_BYTES = 8 << 20


@dataclass(frozen=True)
class Counted:
    """Distinct (group, span): an example of each, its occurrences and the rows that hold it."""

    example: np.ndarray
    group: np.ndarray
    n: np.ndarray
    rows: np.ndarray


def count_spans(hashes: np.ndarray, row: np.ndarray, group: np.ndarray) -> Counted:
    """Count spans given as 64-bit hashes, in ascending order of their rows, by the group of each row."""
    own = group[row]
    key = B.mix(hashes + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    new = np.append(True, key[1:] != key[:-1])[:len(key)]
    starts = np.flatnonzero(new)
    other_row = new | np.append(True, row[1:] != row[:-1])[:len(key)]
    rows = np.add.reduceat(other_row, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    return Counted(order[starts], own[order[starts]], np.diff(np.append(starts, len(key))), rows)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans as an Arrow string column."""
    size = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    picked = data[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, size)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(picked.tobytes())).cast(pa.string())
