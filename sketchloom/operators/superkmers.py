"""Exact shingle counts and containment of DNA from super-k-mers: runs of neighbours travel, shingles do not.

Every shingle of k bases has a minimizer, the least hash of the strand-neutral m-mers inside it; neighbours mostly
share theirs. Sequences are cut into the longest runs of shingles with one minimizer, some (k + m) / 2 bases
for half as many shingles, packed at two bits a base and sent to the bin of their minimizer. Both strands of
a shingle have the same minimizer, so a bin holds all occurrences of its shingles, in the sets and in the
sample: counting, telling distinct ones and intersecting all happen there, and only sums per set leave it.

A bin that holds more than ``BIN`` shingles (a minimizer of repeats) is opened: its shingles, distinct per set
and piece, are dealt by their own hash over as many parts as it takes. Bins grow in number with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.seq import PIECE, explode_pieces
from sketchloom.session import materialize

MINIMIZER = 7
LONGEST = 32
SLAB = 1 << 20  # letters worked on at once
BIN_BYTES = 2 << 20  # of text a bin
BIN = 8 << 20  # shingles a bin may hold

CODE = np.full(256, 4, dtype=np.uint8)
CODE[[ord(c) for c in "ACGT"]] = np.arange(4, dtype=np.uint8)

ROWS = pa.schema(
    [("k", pa.int32()), ("bin", pa.int32()), ("part", pa.int32()), ("asked", pa.bool_()), ("names", pa.list_(pa.string()))]
    + [("owners", pa.binary()), ("sizes", pa.binary()), ("bases", pa.binary()), ("shingles", pa.int64())]
)
KIND = "k int, bin int, part int, asked boolean, names array<string>, owners binary, sizes binary, bases binary, shingles bigint"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def codes(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Both strands of the k bases from every position on, at two bits a base; by doubling."""
    two = np.uint64(2)
    forward = back = None
    length, step, one, other = 0, 1, bases.astype(np.uint64), (3 - bases.astype(np.int64)).astype(np.uint64) & np.uint64(3)
    while True:
        if k & step:
            if forward is None:
                forward, back = one, other
            else:
                n = min(len(forward), len(one) - length)
                forward, back = (forward[:n] << (two * np.uint64(step))) | one[length : length + n], back[:n] | (other[length : length + n] << (two * np.uint64(length)))
            length += step
        if length == k:
            n = max(len(bases) - k + 1, 0)
            return forward[:n], back[:n]
        one, other = (one[:-step] << (two * np.uint64(step))) | one[step:], other[:-step] | (other[step:] << (two * np.uint64(step)))
        step *= 2


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from every position on."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def pack(bases: np.ndarray) -> bytes:
    four = np.concatenate([bases, np.zeros(-len(bases) % 4, dtype=np.uint8)]).reshape(-1, 4)
    return (four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]).astype(np.uint8).tobytes()


def unpack(data, many: int) -> np.ndarray:
    packed = np.frombuffer(data, dtype=np.uint8)
    return np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).ravel()[:many]


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def runs_of(bases: np.ndarray, own: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, shingles and minimizer of the runs in a slab; ``own`` says where a shingle may begin, breaks are code 4."""
    none = np.zeros(0, dtype=np.int64)
    if len(bases) < k:
        return none, none, none.astype(np.uint64)
    bad = np.concatenate([[0], np.cumsum(bases > 3)])
    valid = (bad[k:] == bad[:-k]) & own[: len(bases) - k + 1]
    forward, back = codes(bases & 3, m)
    least = sliding_least(mixed(np.minimum(forward, back) + np.uint64(1)), k - m + 1)
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    starts = np.flatnonzero(begins)
    # A run ends before the next one, or where shingles stop being valid.
    until = np.concatenate([[0], np.cumsum(valid)])
    nexts = np.append(starts[1:], len(valid))
    return starts, until[nexts] - until[starts], least[starts]


def super_kmers(sequences: DataFrame, ks: list[int], bins: int, asked: bool = False, m: int = MINIMIZER, piece: int = PIECE) -> DataFrame:
    """Packed runs of ``sequences(name, seq)`` by bin, a row for each bin and slab of a task."""
    short = min(m, *ks)

    def slab(names: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        owner = names.dictionary_encode()
        texts = texts.cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
        offsets = offsets - offsets[0]
        sizes = np.diff(offsets)
        # A break after each piece; places are counted in letters, as pieces are.
        bases = np.full(len(data) + len(sizes), 4, dtype=np.uint8)
        to = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)
        bases[to] = CODE[data]
        letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        own = np.zeros(len(bases), dtype=bool)
        own[to] = letters[:-1] - np.repeat(letters[offsets[:-1]], sizes) < piece
        row = np.repeat(np.arange(len(sizes)), sizes + 1)
        texts_of = owner.indices.to_numpy()
        for k in ks:
            starts, shingles, least = runs_of(bases, own, k, short)
            place = ((least >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            starts, shingles, place = starts[order], shingles[order], place[order]
            cuts = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place)) if len(place) else np.zeros(1, dtype=np.int64)
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                used, own_of = np.unique(texts_of[row[starts[a:b]]], return_inverse=True)
                long = shingles[a:b] + k - 1
                rows.append(
                    (k, int(place[a]), 0, asked, [owner.dictionary[x].as_py() for x in used], own_of.astype(np.uint32).tobytes(), long.astype(np.uint32).tobytes(), pack(bases[spans(starts[a:b], long)]), int(shingles[a:b].sum()))
                )
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("piece")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLAB, side="right")))
                yield from slab(batch.column("name").slice(at, end - at), batch.column("piece").slice(at, end - at).fill_null(""))
                at = end

    return explode_pieces(sequences, max(ks) - 1, piece).filter("name is not null").mapInArrow(run, KIND)


def shingles_of(row: dict, strand_neutral: bool) -> tuple[np.ndarray, np.ndarray]:
    """Owner and code of every shingle in a packed row; opened rows hold codes already."""
    owners, sizes = (np.frombuffer(row[c], dtype=np.uint32) for c in ("owners", "sizes"))
    k = row["k"]
    if row["part"]:
        return owners.astype(np.int64), np.frombuffer(row["bases"], dtype=np.uint64)
    sizes = sizes.astype(np.int64)
    bases = unpack(row["bases"], int(sizes.sum()))
    forward, back = codes(bases, k)
    at = spans(np.cumsum(sizes) - sizes, sizes - k + 1)
    code = np.minimum(forward[at], back[at]) if strand_neutral else forward[at]
    return np.repeat(owners.astype(np.int64), sizes - k + 1), code


def binned(training: DataFrame, query: DataFrame | None, ks: list[int], strand_neutral: bool = True, counts: bool = False, m: int = MINIMIZER, piece: int = PIECE) -> DataFrame:
    """The rows of both sides, none of whose bins holds more than ``BIN`` shingles.

    With ``counts`` the shingles of opened bins are kept with every occurrence.
    """
    if not ks or max(ks) > LONGEST or min(ks) < 1:
        raise ValueError(f"shingles of 1 to {LONGEST} bases fit the packed form")
    spark = training.sparkSession
    sides = [training] if query is None else [training, query]
    size = sum(s.agg(F.sum(F.octet_length("seq"))).first()[0] or 0 for s in sides)
    bins = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BIN_BYTES))
    rows = super_kmers(training, ks, bins, False, m, piece)
    if query is not None:
        rows = rows.unionByName(super_kmers(query, ks, bins, True, m, piece))
    rows = materialize(rows, "super-kmers")
    large = rows.groupBy("k", "bin").agg(F.sum("shingles").alias("held")).filter(F.col("held") > BIN)
    if large.isEmpty():
        return rows
    large = materialize(large.select(F.col("k").alias("lk"), F.col("bin").alias("lb"), F.ceil(F.col("held") / BIN).cast("int").alias("parts")), "super-kmers-large")
    same = (F.col("k") == F.col("lk")) & (F.col("bin") == F.col("lb"))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                owner, code = shingles_of(row, strand_neutral)
                if not counts:
                    order = np.lexsort((code, owner))
                    owner, code = owner[order], code[order]
                    new = np.ones(len(code), dtype=bool)
                    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
                    owner, code = owner[new], code[new]
                part = (mixed(code + np.uint64(2)) % np.uint64(row["parts"])).astype(np.int64) + 1
                some = [(p, np.flatnonzero(part == p)) for p in np.unique(part).tolist()]
                out = [(row["k"], row["bin"], p, row["asked"], row["names"], owner[x].astype(np.uint32).tobytes(), b"", code[x].tobytes(), len(x)) for p, x in some]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ROWS, strict=True)], schema=ROWS)

    whole = rows.join(large, same, "left_anti")
    return whole.unionByName(rows.join(large, same).select(*rows.columns, "parts").mapInArrow(opened, KIND))


SUMS = "name string, k int, total bigint, distinct bigint, single bigint, hits bigint"


def bin_sums(rows: DataFrame, strand_neutral: bool) -> DataFrame:
    """Per set and length, over all bins: shingles, distinct ones, those that occur once, and those the sample has."""
    schema = pa.schema([("name", pa.string()), ("k", pa.int32()), *((c, pa.int64()) for c in ("total", "distinct", "single", "hits"))])

    def run(held: pa.Table) -> pa.Table:
        names: dict[str, int] = {}
        asked, owners, own = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
        for batch in held.to_batches(max_chunksize=256):
            for row in batch.to_pylist():
                owner, code = shingles_of(row, strand_neutral)
                if row["asked"]:
                    asked.append(np.unique(code))
                else:
                    owners.append(np.array([names.setdefault(x, len(names)) for x in row["names"]], dtype=np.int64)[owner])
                    own.append(code)
        sample, owner, code = np.unique(np.concatenate(asked)), np.concatenate(owners), np.concatenate(own)
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
        at = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1]))) if len(code) else np.zeros(0, dtype=np.int64)
        many, owner, code = np.diff(np.append(at, len(code))), owner[at], code[at]
        hit = sample[np.minimum(np.searchsorted(sample, code), len(sample) - 1)] == code if len(sample) else np.zeros(len(code), dtype=bool)
        total, distinct, single, hits = (np.bincount(owner, weights=w, minlength=len(names)).astype(np.int64) for w in (many, np.ones(len(code)), many == 1, hit))
        k = np.full(len(names), held["k"][0].as_py(), dtype=np.int32)
        return pa.Table.from_arrays([pa.array(list(names), pa.string()), pa.array(k), *map(pa.array, (total, distinct, single, hits))], schema=schema)

    sums = rows.groupBy("k", "bin", "part").applyInArrow(run, SUMS)
    return sums.groupBy("name", "k").agg(*[F.sum(c).alias(c) for c in ("total", "distinct", "single", "hits")])


def containment(training: DataFrame, query: DataFrame, ks: list[int], strand_neutral: bool = True, m: int = MINIMIZER, piece: int = PIECE) -> DataFrame:
    """``(name, k, hits, denom, ci)`` of every training set with a shingle, as ``truth.true_containment``."""
    sums = bin_sums(binned(training, query, ks, strand_neutral, False, m, piece), strand_neutral)
    return sums.select("name", "k", "hits", F.col("distinct").alias("denom"), (F.col("hits") / F.col("distinct")).alias("ci"))


def statistics(sequences: DataFrame, ks: list[int], strand_neutral: bool = True, m: int = MINIMIZER, piece: int = PIECE) -> DataFrame:
    """``(name, k, total, distinct, single)``: occurrences, distinct shingles, and those that occur once."""
    return bin_sums(binned(sequences, None, ks, strand_neutral, True, m, piece), strand_neutral).drop("hits")
