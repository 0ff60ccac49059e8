"""Words of whole Arrow batches at once: boundaries and 64-bit hashes, in numpy over the UTF-8 bytes.

A word is a run of bytes other than [\\x20\\x09-\\x0D]; its hash ignores the case of A-Z.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z as a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]
#: Words of more bytes are hashed one by one.
LONG = 1024
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_KEYS = np.random.default_rng(20240607).integers(0, 1 << 64, LONG // 8 + 1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of the rows and the end) of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def groups(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows of about ``size`` bytes, one row at least."""
    if not len(column):
        return
    data, at = text_bytes(column)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


#: Splits at every ASCII character other than letters and digits.
MARKS = np.ones(256, bool)
MARKS[48:58] = MARKS[65:91] = MARKS[97:123] = MARKS[128:] = False


def boundaries(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the number of words); no word crosses a row's end."""
    inside = ~space[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(data))]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each word, from its length and eight bytes after the other through a keyed mix; no polynomial, which some pairs of words defeat."""
    size = ends - starts
    out = mix(size.astype(np.uint64))
    low = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))  # the eight bytes from each place on
    some = np.flatnonzero(size <= LONG)
    for k in range(LONG // 8):
        if k:
            some = some[size[some] > 8 * k]
        if not len(some):
            break
        part = eight[starts[some] + 8 * k] & _MASK[np.minimum(size[some] - 8 * k, 8)]
        out[some] = mix(out[some] + (part ^ _KEYS[k]))
    for i in np.flatnonzero(size > LONG):
        digest = hashlib.blake2b(low[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i : i + 1] = mix(out[i : i + 1] ^ np.uint64(int.from_bytes(digest, "little")))
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words; the caller picks those that lie within one row."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(m, np.uint64)
        for j in range(n):
            out = out * np.uint64(0x2545F4914F6CDD1D) + words[j : j + m]
        return mix(out)
