"""Exact shingles of DNA where the texts of a set lie together: nothing of the size of the shingles is shuffled.

Sets of up to ``sketch.WHOLE`` letters are brought together as texts, and a task counts, compares and tells apart their
shingles as numbers of two bits a base. Sets that are longer go the way of ``superkmers``. A sample of up to
``SAMPLE_BYTES`` goes to the tasks as its distinct shingles; a larger one meets the sets in the bins of ``superkmers``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.seq import DNA, PIECE, by_length, canonical, explode_pieces, explode_shingles
from sketchloom.operators import grams as numeric
from sketchloom.operators import sketch, superkmers, truth
from sketchloom.operators.superkmers import CODE, LONGEST, SUMS, codes

SAMPLE_BYTES = 2 << 20
LETTERS = np.frombuffer(DNA.encode(), dtype=np.uint8)


def require_packed(ks: list[int]) -> None:
    if not ks or max(ks) > LONGEST or min(ks) < 1:
        raise ValueError(f"shingles of 1 to {LONGEST} bases fit the packed form")


def bases_of(texts: pa.Array, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bases of binary ``texts``, a break (code 4) after each, and the owner of every place."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    sizes = np.diff(offsets)
    bases = np.full(len(data) + len(sizes), 4, dtype=np.uint8)
    bases[np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)] = CODE[numeric.ASCII_UPPER[data]]
    return bases, np.repeat(owner, sizes + 1)


def shingle_codes(bases: np.ndarray, owner: np.ndarray, k: int, strand_neutral: bool) -> tuple[np.ndarray, np.ndarray]:
    """Owner and code of every shingle; strand-neutral ones are the lesser of both strands, in the order of their letters."""
    if len(bases) < k:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    bad = np.concatenate([[0], np.cumsum(bases > 3)])
    at = np.flatnonzero(bad[k:] == bad[:-k])
    forward, back = codes(bases & 3, k)
    return owner[at], (np.minimum(forward, back) if strand_neutral else forward)[at]


def counted(owner: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes of each owner, ascending, and how often they occur."""
    bits = np.uint64(2 * k)
    if len(owner) and k < LONGEST and 2 * k + int(owner.max()).bit_length() <= 64:
        keys = np.sort((owner.astype(np.uint64) << bits) | code)
        owner, code = (keys >> bits).astype(np.int64), keys & ((np.uint64(1) << bits) - np.uint64(1))
    else:
        order = np.lexsort((code, owner))
        owner, code = owner[order], code[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    at = np.flatnonzero(new)
    return owner[at], code[at], np.diff(np.append(at, len(code)))


def kmers_of(code: np.ndarray, k: int) -> pa.Array:
    """The letters of codes."""
    turns = np.arange(2 * (k - 1), -1, -2, dtype=np.uint64)
    letters = LETTERS[((code[:, None] >> turns) & np.uint64(3)).astype(np.int64)]
    edges = np.arange(len(code) + 1, dtype=np.int32) * np.int32(k)
    return pa.StringArray.from_buffers(len(code), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(letters)))


def piece_slabs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bases of the pieces of a batch, some ``numeric.SLAB`` letters at once."""
    pieces = batch.column("piece").fill_null("").cast(pa.binary())
    upto, row = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False)), 0
    while row < len(pieces):
        end = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + numeric.SLAB, side="right")))
        yield bases_of(pieces.slice(row, end - row), np.zeros(end - row, dtype=np.int64))
        row = end


def sample_codes(query: DataFrame, ks: list[int], strand_neutral: bool, piece: int = PIECE) -> dict[int, np.ndarray] | None:
    """The distinct codes of a sample by length, ascending; None where it has more than ``SAMPLE_BYTES``."""
    if (query.agg(F.sum(F.octet_length("seq"))).first()[0] or 0) > SAMPLE_BYTES:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bases, owner in piece_slabs(batch):
                rows = [np.unique(shingle_codes(bases, owner, k, strand_neutral)[1]).tobytes() for k in ks]
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(rows, pa.binary())], ["k", "codes"])

    found = explode_pieces(query, max(ks) - 1, piece).select("piece").mapInArrow(run, "k int, codes binary").collect()
    none = np.zeros(0, dtype=np.uint64)
    return {k: np.unique(np.concatenate([none, *(np.frombuffer(r["codes"], dtype=np.uint64) for r in found if r["k"] == k)])) for k in ks}


def held_by(sample: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which of ``code`` the sorted ``sample`` has."""
    if not len(sample):
        return np.zeros(len(code), dtype=bool)
    return sample[np.minimum(np.searchsorted(sample, code), len(sample) - 1)] == code


def _sums(sets: DataFrame, ks: list[int], samples: dict[int, np.ndarray], strand_neutral: bool) -> DataFrame:
    """The columns ``superkmers.SUMS`` of every row ``(name, texts)`` that has a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts, of in numeric.slabs(batch):
                bases, place = bases_of(texts, of)
                names = batch.column("name").slice(row, end - row)
                for k in ks:
                    owner, code, many = counted(*shingle_codes(bases, place, k, strand_neutral), k)
                    hit = held_by(samples[k], code) if samples else np.zeros(len(code), dtype=bool)
                    sums = [np.bincount(owner, weights=w, minlength=end - row).astype(np.int64) for w in (many, np.ones(len(many)), many == 1, hit)]
                    some = np.flatnonzero(sums[0])
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(np.full(len(some), k, dtype=np.int32)), *(pa.array(x[some]) for x in sums)], [c.split()[0] for c in SUMS.split(", ")])

    return sketch._binary(sets.where("name is not null")).mapInArrow(run, SUMS)


def sums(training: DataFrame, query: DataFrame | None, ks: list[int], strand_neutral: bool = True, counts: bool = False, piece: int = PIECE) -> DataFrame:
    """Per set and length the columns ``superkmers.SUMS``; without ``counts``, ``total`` and ``single`` may be of distinct shingles."""
    require_packed(ks)
    samples = {} if query is None else sample_codes(query.where("name is not null"), ks, strand_neutral, piece)
    if samples is None:
        return superkmers.bin_sums(superkmers.binned(training, query, ks, strand_neutral, counts, piece=piece), strand_neutral)
    short, long = by_length(training, sketch.WHOLE)
    whole = _sums(short, ks, samples, strand_neutral)
    if long.isEmpty():
        return whole
    return whole.unionByName(superkmers.bin_sums(superkmers.binned(long, query, ks, strand_neutral, counts, piece=piece), strand_neutral))


def containment(training: DataFrame, query: DataFrame, ks: list[int], strand_neutral: bool = True, piece: int = PIECE) -> DataFrame:
    """``(name, k, hits, denom, ci)`` of every training set with a shingle, as ``truth.true_containment``."""
    found = sums(training, query, ks, strand_neutral, piece=piece)
    return found.select("name", "k", "hits", F.col("distinct").alias("denom"), (F.col("hits") / F.col("distinct")).alias("ci"))


def statistics(sequences: DataFrame, ks: list[int], strand_neutral: bool = True, piece: int = PIECE) -> DataFrame:
    """``(name, k, total, distinct, single)``: occurrences, distinct shingles, and those that occur once."""
    return sums(sequences, None, ks, strand_neutral, True, piece).drop("hits")


def intersection(training: DataFrame, query: DataFrame, ks: list[int], strand_neutral: bool = True, piece: int = PIECE) -> DataFrame:
    """The distinct shingles ``(k, kmer)`` that training and sample have in common.

    A task marks the sample's shingles that it meets and sends its marks, a bit for each.
    """
    require_packed(ks)
    samples = sample_codes(query, ks, strand_neutral, piece)
    if samples is None:
        return truth.intersection(*(truth.distinct_shingles(x, ks, strand_neutral=strand_neutral, piece=piece) for x in (training, query)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = {k: np.zeros(len(samples[k]), dtype=bool) for k in ks}
        for batch in batches:
            for bases, owner in piece_slabs(batch):
                for k in ks:
                    met[k] |= held_by(np.sort(shingle_codes(bases, owner, k, strand_neutral)[1]), samples[k])
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array([np.packbits(met[k]).tobytes() for k in ks], pa.binary())], ["k", "marks"])

    def merged(held: pa.Table) -> pa.Table:
        k = held["k"][0].as_py()
        marks = np.bitwise_or.reduce([np.frombuffer(x.as_py(), dtype=np.uint8) for x in held["marks"]])
        own = samples[k][np.unpackbits(marks, count=len(samples[k])).astype(bool)]
        return pa.table([pa.array(np.full(len(own), k, dtype=np.int32)), kmers_of(own, k)], ["k", "kmer"])

    marks = explode_pieces(training, max(ks) - 1, piece).select("piece").mapInArrow(run, "k int, marks binary")
    return marks.groupBy("k").applyInArrow(merged, "k int, kmer string")


CANONICAL = "name string, kmers bigint, first_kmer string, last_kmer string"


def canonical_summary(sequences: DataFrame, k: int, piece: int = PIECE) -> DataFrame:
    """``(name, kmers, first_kmer, last_kmer)``: how many distinct strand-neutral shingles a set has, the least and the greatest."""
    require_packed([k])
    short, long = by_length(sequences, sketch.WHOLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts, of in numeric.slabs(batch):
                owner, code, _ = counted(*shingle_codes(*bases_of(texts, of), k, True), k)
                some, first, many = np.unique(owner, return_index=True, return_counts=True)
                names = batch.column("name").slice(row, end - row).take(pa.array(some, pa.int64()))
                columns = [names, pa.array(many.astype(np.int64)), kmers_of(code[first], k), kmers_of(code[first + many - 1], k)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CANONICAL.split(", ")])

    spread = explode_shingles(long, k, step=piece).select("name", canonical(F.col("kmer")).alias("kmer")).distinct()
    own = spread.groupBy("name").agg(F.count("*").alias("kmers"), F.min("kmer").alias("first_kmer"), F.max("kmer").alias("last_kmer"))
    return sketch._binary(short).mapInArrow(run, CANONICAL).unionByName(own)
