"""Bottom-n sketches: the n smallest distinct hashes of a set, with multiplicities.

A sketch is a set of rows ``(name, slot, h, cnt, kmer)``; unused slots are simply absent. Counts are
true multiplicities, and two shingles that collide on a hash keep the smaller shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.functions.seq import (
    DNA,
    PIECE,
    Hasher,
    by_length,
    explode_pieces,
    fast_hash,
    reverse_complement,
    shingles,
)
from sketchloom.operators import grams as numeric
from sketchloom.session import BROADCAST_ROWS

# Letters of a set that one task works on whole; a longer set is dealt over tasks by its pieces.
WHOLE = 1 << 20

# Fixed value: the default modulus of the hash.
DEFAULT_PRIME = 9_999_999_999_971


@dataclass(frozen=True)
class SketchSpec:
    """Everything two sketches must agree on to be comparable, plus how to read the text."""

    n: int = 500
    ksize: int = 21
    prime: int = DEFAULT_PRIME
    alphabet: str | None = DNA
    uppercase: bool = True
    both_strands: bool = False
    hasher: Hasher = fast_hash
    piece: int = PIECE

    def hashed(self, kmer: Column) -> Column:
        """``struct(h, kmer)`` of a shingle; with both strands, of the strand that hashes lower."""
        own = self.hasher(kmer)
        if not self.both_strands:
            return F.struct(F.pmod(own, F.lit(self.prime)).alias("h"), kmer.alias("kmer"))
        flipped = reverse_complement(kmer)
        other = self.hasher(flipped)
        return F.struct(
            F.pmod(F.least(own, other), F.lit(self.prime)).alias("h"),
            F.when(other <= own, flipped).otherwise(kmer).alias("kmer"),
        )


def bottom_n(
    sequences: DataFrame,
    spec: SketchSpec = SketchSpec(),
    hash_list: list[int] | DataFrame | None = None,
    spread: int | None = None,
    kept: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Sketch every set in ``(name, seq)``.

    A set of up to ``WHOLE`` letters is sketched where its texts lie together, so that its shingles never leave the
    task. Of a longer one, a hash among the n smallest of the set is also among the n smallest of every piece it
    occurs in, so each piece is cut to its n smallest distinct hashes inside the scanning task and only those
    reach the first shuffle. That shuffle is keyed by ``(name, h)`` with map-side counting, hence a
    set of any size spreads over the cluster; the second one carries at most n rows per set and
    task, because the rank filter is applied before it too.

    ``hash_list`` keeps only the given hashes; an empty list means no restriction. Up to ``BROADCAST_ROWS`` of them go to the tasks as numbers. With
    more, or a hash that has no numpy form, all sets take the way of the longer ones, by column expressions.

    ``kept`` keeps sets by their ``name``: it is given the texts once they lie together by name, so that a join there
    moves them no second time, and sketches, several times as large, are not moved at all.
    """
    kept = kept or (lambda rows: rows)
    chosen = _numbers(hash_list)
    if spec.hasher.__name__ in numeric.NUMBERS and (hash_list is None or chosen is not None):
        wanted = chosen if chosen is not None and len(chosen) else None
        short, long = by_length(sequences, WHOLE)
        cut = explode_pieces(kept(long), spec.ksize - 1, spec.piece, spec.uppercase, spread)
        parts = _smallest(cut.select("name", F.array("piece").alias("texts")), spec, wanted=wanted)
        return _smallest(kept(short), spec, wanted=wanted).unionByName(merge_sketches(parts, spec.n))
    cut = explode_pieces(kept(sequences), spec.ksize - 1, spec.piece, spec.uppercase, spread)
    hashed = cut.select("name", F.transform(shingles("piece", spec.ksize, spec.alphabet), spec.hashed).alias("grams"))
    if isinstance(hash_list, list) and hash_list:
        hashed = hashed.select("name", F.filter("grams", lambda g: g["h"].isin(hash_list)).alias("grams"))
    if isinstance(hash_list, DataFrame):
        occurrences = hashed.select("name", F.explode("grams").alias("g")).select("name", "g.h", "g.kmer")
        wanted = hash_list.select("h").distinct()
        counted = _count(occurrences)
        if wanted.isEmpty():
            return keep_smallest(counted, spec.n)
        if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            counted = _count(occurrences.join(F.broadcast(wanted), "h", "left_semi"))
        else:  # count first, so that a frequent hash meets the list once per set
            counted = counted.join(wanted, "h", "left_semi")
        return keep_smallest(counted, spec.n)
    bound = hashed.select(
        "name",
        "grams",
        F.try_element_at(F.sort_array(F.array_distinct("grams.h")), F.lit(spec.n)).alias("bound"),
    )
    occurrences = bound.select(
        "name",
        F.explode(F.filter("grams", lambda g: F.col("bound").isNull() | (g["h"] <= F.col("bound")))).alias("g"),
    ).select("name", "g.h", "g.kmer")
    return keep_smallest(_count(occurrences), spec.n)


def _numbers(hash_list: list[int] | DataFrame | None) -> np.ndarray | None:
    """The hashes of a list in order, or nothing where there are too many; one that no shingle has stands for a list of nulls."""
    if hash_list is None:
        return None
    if isinstance(hash_list, DataFrame):
        rows = hash_list.select("h").distinct().limit(BROADCAST_ROWS + 1).collect()
        hash_list = [r["h"] for r in rows]
    if len(hash_list) > BROADCAST_ROWS:
        return None
    return np.unique(np.array([-1 if h is None else h for h in hash_list], dtype=np.int64))


def bottom_sets(sequences: DataFrame, spec: SketchSpec = SketchSpec()) -> DataFrame:
    """The same sketches as a row ``(name, hs, cs)`` each, for comparisons that need no shingle: hashes ascending, and counts."""
    if spec.hasher.__name__ not in numeric.NUMBERS:
        return as_sets(bottom_n(sequences, spec))
    short, long = by_length(sequences, WHOLE)
    cut = explode_pieces(long, spec.ksize - 1, spec.piece, spec.uppercase)
    parts = _smallest(cut.select("name", F.array("piece").alias("texts")), spec)
    return _smallest(short, spec, whole=True).unionByName(as_sets(merge_sketches(parts, spec.n)))


def as_sets(entries: DataFrame) -> DataFrame:
    """``(name, hs, cs)`` of sketch entries, or of what has this form already."""
    if "hs" in entries.columns:
        return entries
    rows = entries.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("h", "cnt"))).alias("slots"))
    return rows.select("name", F.col("slots.h").alias("hs"), F.col("slots.cnt").alias("cs"))


SLOTS = "name string, slot int, h bigint, cnt bigint, kmer string"
SETS = "name string, hs array<bigint>, cs array<bigint>"


def _smallest(sets: DataFrame, spec: SketchSpec, whole: bool = False, wanted: np.ndarray | None = None) -> DataFrame:
    """The sketch of every row ``(name, texts)``, of the ``wanted`` hashes if given: a row for each slot or, with ``whole``, one."""
    numbers = numeric.NUMBERS[spec.hasher.__name__]
    n, k, prime, alphabet, uppercase, both = spec.n, spec.ksize, spec.prime, spec.alphabet, spec.uppercase, spec.both_strands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts, owner in numeric.slabs(batch):
                found = numeric.smallest(numeric.shingles_of(texts, owner, k, alphabet, uppercase, both), n, prime, numbers, wanted)
                names = batch.column("name").slice(row, end - row)
                if whole:
                    some = np.unique(found.owner)
                    edges = pa.array(np.append(np.searchsorted(found.owner, some), len(found.owner)), pa.int32())
                    lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int64())) for x in (found.h, found.cnt)]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(some)), *lists], ["name", "hs", "cs"])
                    continue
                columns = [names.take(pa.array(found.owner)), pa.array(found.slot, pa.int32()), pa.array(found.h), pa.array(found.cnt, pa.int64()), found.kmer]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SLOTS.split(", ")])

    return _binary(sets).mapInArrow(run, SETS if whole else SLOTS)


def _binary(sets: DataFrame) -> DataFrame:
    texts = F.transform("texts", lambda x: F.coalesce(x, F.lit("")).cast("binary"))
    return sets.select(F.col("name").cast("string").alias("name"), texts.alias("texts"))


def _distinct(sets: DataFrame, spec: SketchSpec) -> DataFrame:
    """The number of distinct shingles of every row ``(name, texts)`` that has one."""
    k, alphabet, uppercase = spec.ksize, spec.alphabet, spec.uppercase

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts, owner in numeric.slabs(batch):
                many = numeric.distinct(numeric.shingles_of(texts, owner, k, alphabet, uppercase), end - row)
                some = np.flatnonzero(many)
                names = batch.column("name").slice(row, end - row).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([names, pa.array(many[some], pa.int64())], ["name", "true_num_kmers"])

    return _binary(sets).mapInArrow(run, "name string, true_num_kmers bigint")


def _count(occurrences: DataFrame) -> DataFrame:
    # The shingle is a key and not a min(): only fixed-width buffers keep this a hash aggregation.
    return occurrences.groupBy("name", "h", "kmer").agg(F.count("*").alias("cnt"))


def keep_smallest(counted: DataFrame, n: int) -> DataFrame:
    """Rank the hashes of ``(name, h, kmer, cnt)`` within each set and keep the first n as slots 0..n-1.

    Shingles that share a hash share its rank and merge here, after the cut; the rank's own sort
    order serves that aggregation.
    """
    order = Window.partitionBy("name").orderBy("h")
    return (
        counted.withColumn("rank", F.dense_rank().over(order))
        .where(F.col("rank") <= n)
        .groupBy("name", "h")
        .agg(F.min("rank").alias("rank"), F.sum("cnt").alias("cnt"), F.min("kmer").alias("kmer"))
        .select("name", (F.col("rank") - 1).alias("slot"), "h", "cnt", "kmer")
    )


def merge_sketches(entries: DataFrame, n: int) -> DataFrame:
    """Sketch of the union of disjoint parts: add counts per hash and keep the n smallest again."""
    summed = entries.groupBy("name", "h", "kmer").agg(F.sum("cnt").alias("cnt"))
    return keep_smallest(summed, n)


def down_sample(entries: DataFrame, size: int) -> DataFrame:
    """Keep the first ``size`` slots of every sketch."""
    return entries.where(F.col("slot") < size)


def cardinality(sequences: DataFrame, spec: SketchSpec = SketchSpec(), exact: bool = False) -> DataFrame:
    """Distinct shingles per set: ``(name, true_num_kmers)``.

    Sets of up to ``WHOLE`` letters are brought together as texts and counted there: nothing of the size of their
    shingles is shuffled. Of a longer set the exact count shuffles every distinct ``(name, kmer)``, and the estimate
    (about 1 % error), a mergeable sketch, one small row per set and task.
    """
    short, long = by_length(sequences, WHOLE)

    def grams(rows: DataFrame) -> DataFrame:
        cut = explode_pieces(rows, spec.ksize - 1, spec.piece, spec.uppercase)
        return cut.select("name", F.explode(shingles("piece", spec.ksize, spec.alphabet)).alias("kmer"))

    if exact:
        spread = grams(long).distinct().groupBy("name").agg(F.count("kmer").alias("true_num_kmers"))
        return _distinct(short, spec).unionByName(spread)
    # Texts are dealt by name already, so registers of the short sets are not.
    rows = short.select("name", F.explode("texts").alias("seq"))
    register = F.hll_sketch_agg(F.xxhash64("kmer"), F.lit(14))
    rough = F.hll_sketch_estimate(register).alias("true_num_kmers")
    return grams(rows).groupBy("name").agg(rough).unionByName(grams(long).groupBy("name").agg(rough))


def kmv_cardinality(entries: DataFrame, spec: SketchSpec = SketchSpec()) -> DataFrame:
    """``(name, true_num_kmers, error)`` from the sketches themselves, by their k minimum values: no text is read.

    Hashes are spread evenly below the prime, so n slots of which the last is at h stand for ``(n - 1) prime / (h + 1)``
    distinct shingles, with a relative standard error of ``1 / sqrt(n - 2)``. A sketch with free slots holds all its
    hashes and is exact but for collisions. Merged sketches give the cardinality of the union.
    """
    filled = entries.groupBy("name").agg(F.count("*").alias("filled"), F.max("h").alias("last"))
    full = F.col("filled") >= spec.n
    guess = F.round(F.lit(float(spec.n - 1) * float(spec.prime)) / (F.col("last") + 1)).cast("bigint")
    error = F.lit(1.0 / max(spec.n - 2, 1) ** 0.5)
    return filled.select("name", F.when(full, guess).otherwise(F.col("filled")).alias("true_num_kmers"), F.when(full, error).otherwise(0.0).alias("error"))


def describe(sequences: DataFrame, spec: SketchSpec = SketchSpec(), exact: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """One metadata row per set: ``(name, path, ksize, prime, n, true_num_kmers, hash, both_strands)``.

    Sets without any shingle are present with a count of zero. ``path`` is taken from the input
    when it has that column, else it is the name; a name with two paths is an error. ``counts`` takes the place of
    counting shingles here.
    """
    path = F.min("path") if "path" in sequences.columns else F.min("name")
    if "path" in sequences.columns:
        two = F.concat(F.lit("names must be unique; two files are named "), F.first("name"))
        path = F.when(F.min("path").eqNullSafe(F.max("path")), F.min("path")).otherwise(F.raise_error(two))
    names = sequences.groupBy("name").agg(path.alias("path"))
    counts = cardinality(sequences, spec, exact) if counts is None else counts.select("name", "true_num_kmers")
    return names.join(counts, "name", "left").select(
        "name",
        "path",
        F.lit(spec.ksize).alias("ksize"),
        F.lit(spec.prime).cast("bigint").alias("prime"),
        F.lit(spec.n).alias("n"),
        F.coalesce("true_num_kmers", F.lit(0).cast("bigint")).alias("true_num_kmers"),
        F.lit(spec.hasher.__name__).alias("hash"),
        F.lit(spec.both_strands).alias("both_strands"),
    )
