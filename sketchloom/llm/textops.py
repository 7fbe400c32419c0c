"""Vectorised text steps shared by the operators: rows of an Arrow batch as byte blocks, words and their hashes.

All of it works on whole texts. A block holds as many whole rows as fit in ``BLOCK`` bytes (a
longer text is a block of its own), so memory in a task is bounded by the block and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

# Words of `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

# Words of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower-cased: digits, a-z and every byte of other letters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


class Block(NamedTuple):
    first: int  # row of the batch
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than rows


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    """The rows of a string or binary column in byte blocks; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield Block(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the hash base (or of its inverse) modulo 2^64."""
    name = "inverse" if inverse else "base"
    known = _powers.get(name)
    if known is None or len(known) < n:
        steps = np.full(max(n, BLOCK + 1), _BASE_INVERSE if inverse else _BASE, dtype=np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if n <= 8 * BLOCK:
            _powers[name] = known
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``out[i]``: polynomial sum of the first ``i`` bytes; one element more than ``data``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span lies."""
    return mixed((prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts])


class Words(NamedTuple):
    starts: np.ndarray  # byte positions in the block
    ends: np.ndarray
    rows: np.ndarray  # row of the block
    first: np.ndarray  # index of each row's first word; one more than rows


def words(block: Block, letters: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of ``letters`` inside rows; a word never crosses rows."""
    inside = letters[block.data]
    n = len(inside)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = block.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    first = np.searchsorted(starts, block.offsets)
    rows = np.repeat(np.arange(len(block.offsets) - 1), np.diff(first))
    return Words(starts, ends, rows, first)


def word_hashes(block: Block, found: Words, data: np.ndarray | None = None) -> np.ndarray:
    prefix = prefix_hash(block.data if data is None else data)
    return span_hash(prefix, found.starts, found.ends)


_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


def shingles(hashes: np.ndarray, found: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and their first index per row (one more than rows).

    A row of fewer words has its whole sequence as its one shingle; a row without words has none.
    Lengths are mixed in, so a short row never equals a full shingle.
    """
    counts = np.diff(found.first)
    n = len(hashes)
    full = max(n - width + 1, 0)
    out = np.zeros(full, dtype=np.uint64)
    for k in range(width):
        out += hashes[k : k + full] * np.uint64(_ODD[k % len(_ODD)] + 2 * (k // len(_ODD)))
    out = mixed(out + np.uint64(width))
    per_row = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per_row)])
    # Index of each shingle's first word: rows' words in order, without the last width - 1 of a row.
    within = np.arange(first[-1]) - np.repeat(first[:-1], per_row)
    at = np.repeat(found.first[:-1], per_row) + within
    result = np.zeros(first[-1], dtype=np.uint64)
    long_row = np.repeat(counts >= width, per_row)
    result[long_row] = out[at[long_row]]
    for row in np.flatnonzero((counts > 0) & (counts < width)):
        some = hashes[found.first[row] : found.first[row + 1]]
        odd = np.array(_ODD[: len(some)], dtype=np.uint64)
        result[first[row]] = mixed(np.array([np.sum(some * odd) + np.uint64(len(some))], dtype=np.uint64))[0]
    return result, first


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each of the ranges that ``first`` delimits; 0 for an empty range."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, high bytes first: a shuffle's compression removes what sorting makes alike."""
    return values.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes()


def from_planes(data, kind: str = "u8") -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(size, -1).T)
    return flat.reshape(-1).view(f">{kind}").astype(kind)
