"""Text columns as numpy arrays: bytes, words and word keys of many documents at once.

Words are `[^\\x20\\x09-\\x0D]+`. Every function works on a block of rows whose
texts lie one after the other in one byte array, so that no Python object is
made per word. A block holds BLOCK bytes, or one longer document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

U = np.uint64
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15


class Block(NamedTuple):
    """Rows [first, first + len(ends)) of a batch: their bytes, and where each row's lie in them."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def text(self, row: int) -> bytes:
        return self.data[self.starts[row]:self.ends[row]].tobytes()


class Words(NamedTuple):
    """Words of a block in order: the row of each, and its bytes [start, end)."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is an empty text."""
    values = pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(batch: pa.RecordBatch, name: str = "text", size: int = BLOCK) -> Iterator[Block]:
    """Cut a batch into blocks of about `size` bytes; rows stay whole."""
    data, offsets = column(batch, name)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        own = offsets[first:last + 1] - offsets[first]
        yield Block(first, data[offsets[first]:offsets[last]], own[:-1], own[1:])
        first = last


def words(block: Block) -> Words:
    """All words of a block."""
    data = block.data
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a row begins here
    edge[block.starts] = True
    edge[-1] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    # rows without bytes share their start with the next row, which must win
    return Words(np.searchsorted(block.starts, start, "right") - 1, start, end)


_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k < n, kept for later calls."""
    if len(_powers["up"]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            out = np.full(size, base, U)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def running(values: np.ndarray) -> np.ndarray:
    """Sums of values[k] * BASE**k over all k before each position."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def word_keys(data: np.ndarray, found: Words) -> np.ndarray:
    """64-bit keys of words: equal words have equal keys wherever they stand."""
    sums = running(data.astype(U) + U(1))
    return mixed((sums[found.end] - sums[found.start]) * powers(len(data) + 1)[1][found.start])


def runs(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which n consecutive words of one row begin, and the key of each such run."""
    if len(keys) < n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(row[n - 1:] == row[:len(row) - n + 1])
    sums = running(keys)
    return at, mixed((sums[at + n] - sums[at]) * powers(len(keys) + 1)[1][at])


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def distinct(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once per row, sorted by row and key."""
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    return keys[first], row[first]


def strings(values) -> pa.Array:
    return pa.array(values, pa.string())


def plain(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A numeric column without nulls as numpy."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
