"""Shingles of whole texts in numpy: hashes, the smallest of each set, and the number of distinct ones.

Works on a slab of texts at a time, inside a task. A shingle is its place and its bytes in the slab; nothing is a
Python object. Equal hashes are compared byte by byte, so counts are those of shingles and not of hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from sketchloom.functions.seq import COMPLEMENT, DNA
from sketchloom.operators.superkmers import spans

SLAB = 1 << 19  # letters worked on at once
LANES = 1 << 14  # shingles hashed at once, so that a step's arrays stay in the cache

ASCII_UPPER = np.arange(256, dtype=np.uint8)
ASCII_UPPER[97:123] -= 32
FLIP = np.arange(256, dtype=np.uint8)
FLIP[[ord(c) for c in DNA]] = [ord(c) for c in COMPLEMENT]

TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def md5_numbers(data: np.ndarray, words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The first 60 bits of MD5 of ``size`` bytes from every start; ``words`` are the four bytes from every place on."""
    if size > 55:  # more than one block
        raw, ends = data.tobytes(), (starts + size).tolist()
        digests = b"".join([hashlib.md5(raw[a:b], usedforsecurity=False).digest()[:8] for a, b in zip(starts.tolist(), ends, strict=True)])
        return np.frombuffer(digests, dtype=">u8").astype(np.uint64) >> np.uint64(4)
    many, rest = len(starts), size % 4
    message = [words[starts + 4 * j] if 4 * j + 4 <= size else None for j in range(16)]
    fixed = {14: 8 * size}
    if rest:
        last = words[starts + (size - rest)]
        message[size // 4] = (last & np.uint32((1 << 8 * rest) - 1)) | np.uint32(0x80 << 8 * rest)
    else:
        fixed[size // 4] = 0x80
    first = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(many, x, dtype=np.uint32) for x in first)
    f, spare = np.empty(many, dtype=np.uint32), np.empty(many, dtype=np.uint32)
    for i in range(64):  # in place: an array for each step takes a quarter longer
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        a += f
        a += np.uint32((int(SINES[i]) + fixed.get(g, 0)) & 0xFFFFFFFF)
        if message[g] is not None:
            a += message[g]
        np.left_shift(a, np.uint32(TURNS[i]), out=spare)
        a >>= np.uint32(32 - TURNS[i])
        a |= spare
        a += b
        a, b, c, d = d, a, b, c
    a, b = (a + np.uint32(first[0])).byteswap(), (b + np.uint32(first[1])).byteswap()
    return (a.astype(np.uint64) << np.uint64(28)) | (b >> np.uint32(4))


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxhash_numbers(data: np.ndarray, words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """``xxhash64`` of Spark (seed 42), folded to non-negative."""
    lane = lambda at: words[starts + at].astype(np.uint64) | (words[starts + at + 4].astype(np.uint64) << np.uint64(32))
    step = lambda total, x: turned(total + x * P2, 31) * P1
    seed, at, nothing = np.uint64(42), 0, np.zeros(len(starts), dtype=np.uint64)
    if size >= 32:
        sums = [nothing + seed + P1 + P2, nothing + seed + P2, nothing + seed, nothing + seed - P1]
        while at + 32 <= size:
            sums = [step(s, lane(at + 8 * k)) for k, s in enumerate(sums)]
            at += 32
        h = turned(sums[0], 1) + turned(sums[1], 7) + turned(sums[2], 12) + turned(sums[3], 18)
        for s in sums:
            h = (h ^ step(nothing, s)) * P1 + P4
    else:
        h = nothing + seed + P5
    h = h + np.uint64(size)
    while at + 8 <= size:
        h = turned(h ^ step(nothing, lane(at)), 27) * P1 + P4
        at += 8
    if at + 4 <= size:
        h = turned(h ^ (words[starts + at].astype(np.uint64) * P1), 23) * P2 + P3
        at += 4
    while at < size:
        h = turned(h ^ (data[starts + at].astype(np.uint64) * P5), 11) * P1
        at += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return (h ^ (h >> np.uint64(32))) & np.uint64(0x7FFFFFFFFFFFFFFF)


# By the names of the column expressions in ``functions.seq``.
NUMBERS = {"fast_hash": xxhash_numbers, "portable_hash": md5_numbers}


class Shingles(NamedTuple):
    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray  # in bytes
    owner: np.ndarray  # ascending
    flipped: np.ndarray | None  # the reverse complement of the data; a shingle's is there at the mirrored place


def shingles_of(texts: pa.Array, owner: np.ndarray, k: int, alphabet: str | None, uppercase: bool, both: bool = False) -> Shingles:
    """The shingles of binary ``texts``, the owner of each given."""
    texts = texts.cast(pa.large_binary())
    _, offsets, buffer = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    if uppercase:
        data = ASCII_UPPER[data]
    letters = np.flatnonzero((data & 0xC0) != 0x80)
    edges = np.searchsorted(letters, offsets)
    place = np.append(letters, len(data))
    ends = np.repeat(edges[1:], np.diff(edges))
    begins = np.arange(len(letters)) + k <= ends
    if alphabet:
        bad = np.concatenate([[0], np.cumsum(~np.isin(data[letters], np.frombuffer(alphabet.encode(), dtype=np.uint8)))])
        at = np.flatnonzero(begins)
        at = at[bad[at + k] == bad[at]]
    else:
        at = np.flatnonzero(begins)
    flipped = None
    if both:
        turned_round = spans(letters[::-1], np.diff(place)[::-1]) if len(letters) < len(data) else np.arange(len(data))[::-1]
        flipped = FLIP[data[turned_round]]
    starts = place[at]
    return Shingles(data, starts, place[at + k] - starts, np.repeat(owner, np.diff(edges))[at], flipped)


def hashed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, numbers) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
    words = padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16 | padded[3:] << 24
    out = np.zeros(len(starts), dtype=np.uint64)
    for size in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == size)
        for at in range(0, len(some), LANES):
            part = some[at : at + LANES]
            out[part] = numbers(data, words, starts[part], size)
    return out


def unlike(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Do the shingles ``a`` and ``b`` differ?"""
    out = sizes[a] != sizes[b]
    for at in range(int(sizes[a].max(initial=0))):
        out |= (data[np.minimum(starts[a] + at, len(data) - 1)] != data[np.minimum(starts[b] + at, len(data) - 1)]) & (at < sizes[a])
    return out


def text_of(data: np.ndarray, start: int, size: int) -> bytes:
    return data[start : start + size].tobytes()


class Smallest(NamedTuple):
    owner: np.ndarray
    slot: np.ndarray
    h: np.ndarray
    cnt: np.ndarray
    kmer: pa.Array


def smallest(found: Shingles, n: int, prime: int, numbers, wanted: np.ndarray | None = None) -> Smallest:
    """The n smallest distinct hashes of each owner, of those ``wanted`` (ascending) if given, how often they occur, and the least shingle of each."""
    data, starts, sizes, owner, flipped = found
    h = hashed(data, starts, sizes, numbers)
    if flipped is not None:
        back = len(data) - starts - sizes
        other = hashed(flipped, back, sizes, numbers)
        starts = np.where(other <= h, len(data) + back, starts)
        h, data = np.minimum(h, other), np.concatenate([data, flipped])
    h = h % np.uint64(prime)
    if wanted is not None:
        spot = np.minimum(np.searchsorted(wanted, h.astype(np.int64)), len(wanted) - 1)
        some = np.flatnonzero(wanted[spot] == h.astype(np.int64))
        h, starts, sizes, owner = h[some], starts[some], sizes[some], owner[some]
    bits = int(prime).bit_length()
    if len(h) and bits + int(owner[-1]).bit_length() <= 64:
        order = np.argsort((owner.astype(np.uint64) << np.uint64(bits)) | h)
    else:
        order = np.lexsort((h, owner))
    h, owner, starts, sizes = h[order], owner[order], starts[order], sizes[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    cnt = np.diff(np.append(at, len(h)))
    of = owner[at]
    slot = np.arange(len(at)) - np.searchsorted(of, of)
    kept = slot < n
    at, cnt, of, slot = at[kept], cnt[kept], of[kept], slot[kept]
    best = at.copy()
    again = spans(at + 1, cnt - 1)
    group = np.repeat(np.arange(len(at)), cnt - 1)
    for g in np.unique(group[unlike(data, starts, sizes, again, at[group])]).tolist():
        best[g] = min(range(at[g], at[g] + cnt[g]), key=lambda x: text_of(data, int(starts[x]), int(sizes[x])))
    ends = np.cumsum(sizes[best])
    kmer = pa.Array.from_buffers(pa.large_binary(), len(best), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data[spans(starts[best], sizes[best])])])
    return Smallest(of, slot, h[at].astype(np.int64), cnt, kmer.cast(pa.large_string()).cast(pa.string()))


def distinct(found: Shingles, owners: int) -> np.ndarray:
    """The number of distinct shingles of each owner."""
    data, starts, sizes, owner, _ = found
    # The owner is part of the key, so that a set's shingles lie together only with their own copies.
    keys = hashed(data, starts, sizes, xxhash_numbers) * P1 + owner.astype(np.uint64) * P2
    order = np.argsort(keys)
    keys, owner, starts, sizes = keys[order], owner[order], starts[order], sizes[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    leader = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    again = np.flatnonzero(~new)
    apart = again[unlike(data, starts, sizes, again, leader[again]) | (owner[again] != owner[leader[again]])]
    count = np.bincount(owner[new], minlength=owners)
    for first in np.unique(leader[apart]).tolist():  # different shingles of one key
        members = [first, *apart[leader[apart] == first].tolist()]
        texts = {(int(owner[x]), text_of(data, int(starts[x]), int(sizes[x]))) for x in members}
        for of, _ in texts - {(int(owner[first]), text_of(data, int(starts[first]), int(sizes[first])))}:
            count[of] += 1
    return count


def slabs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """First row and end of a slab of ``(name, texts)`` rows, its texts and the row of each, from 0."""
    texts = batch.column("texts")
    edges = texts.offsets.to_numpy()
    flat = texts.values.cast(pa.large_binary())
    bounds = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    upto = bounds[edges]
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(upto, upto[row] + SLAB, side="right")) - 1)
        part = flat.slice(int(edges[row]), int(edges[end] - edges[row]))
        yield row, end, part, np.repeat(np.arange(end - row), np.diff(edges[row : end + 1]))
        row = end
