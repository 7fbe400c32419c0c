"""Containment at several shingle lengths at once, from sketches made at the largest one.

A sketch shingle answers for every shorter length through its prefix. Lookups work on either
strand: a sample shingle first matches as it is, and only if no key starts with it, by its reverse
complement. Which of the two applies, and whether the shingle passes the shortest length, depends
on the database alone, so both are settled when the lookup table is made and a sample shingle needs
one join.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.functions.seq import PIECE, explode_pieces, reverse_complement, windows
from sketchloom.session import materialize, scratch_dir
from sketchloom.sources.results import BY, SALTS, read_index, write_index


def _prefixes(ks: list[int], text: Column, most: Column | None = None) -> Column:
    """Array of ``struct(k, prefix)``, for the lengths up to ``most``."""
    pairs = F.transform(F.array(*[F.lit(k) for k in ks]), lambda k: F.struct(k.alias("k"), F.substring(text, F.lit(1), k).alias("prefix")))
    return F.filter(pairs, lambda p: p["k"] <= most) if most is not None else pairs


def prefix_index(entries: DataFrame, ks: list[int], starts: DataFrame | None = None) -> DataFrame:
    """``(k, key, name, slot, prefix, is_rc)``: each sketch shingle and its reverse complement, cut to each k.

    ``prefix`` is always the forward shingle's prefix, which is what hits are counted by. With ``starts(gate)`` only of
    strands that begin with one of them, at the shortest length; the others are never cut.
    """
    strands = F.array(
        F.struct(F.col("kmer").alias("strand"), F.lit(False).alias("is_rc")),
        F.struct(reverse_complement("kmer").alias("strand"), F.lit(True).alias("is_rc")),
    )
    rows = entries.select("name", "slot", "kmer", F.explode(strands).alias("s"))
    if starts is not None:
        rows = rows.withColumn("gate", F.substring("s.strand", 1, min(ks))).join(starts, "gate", "left_semi").drop("gate")
    cut = rows.select("name", "slot", "kmer", "s.is_rc", F.explode(_prefixes(ks, F.col("s.strand"))).alias("p"))
    return cut.select(
        "p.k",
        F.col("p.prefix").alias("key"),
        "name",
        "slot",
        F.expr("substring(kmer, 1, p.k)").alias("prefix"),
        "is_rc",
    )


def prefilter(index: DataFrame) -> DataFrame:
    """The distinct ``(k, prefix)`` of all keys and their reverse complements."""
    keys = index.select("k", F.col("key").alias("prefix")).distinct()
    return keys.union(keys.select("k", reverse_complement("prefix"))).distinct()


def lookup_table(index: DataFrame, first_k: int, ksize: int | None = None, chained: bool = False) -> DataFrame:
    """``(k, query, target)``: the key that a sample shingle ``query`` leads to; unique on (k, query).

    With ``chained`` also ``chain``: ``(k, target)`` of every query that this one starts with, itself included.

    A shingle longer than ``first_k`` must also start with a shingle of the prefilter at ``first_k``.
    At ``ksize``, the length the database was sketched at, both strands of every shingle are keys
    and flipping adds nothing; naming it saves that work.
    """
    keys = materialize(index.select("k", "key").distinct(), "keys")
    forward = keys.select("k", F.col("key").alias("query"), F.col("key").alias("target"))
    # A key starts with a key of the shortest length, so only flipped queries can miss the gate,
    # and most do: the gate comes before the comparison with the forward queries.
    gate = prefilter(keys.where(F.col("k") == first_k)).select(F.col("prefix").alias("gate"))
    flipped = (
        (keys.where(F.col("k") != ksize) if ksize else keys)
        .select("k", reverse_complement("key").alias("query"), F.col("key").alias("target"))
        .withColumn("gate", F.substring("query", 1, first_k))
        .join(gate, "gate", "left_semi")
        .drop("gate")
        .join(forward.select("k", "query"), ["k", "query"], "left_anti")
    )
    table = forward.union(flipped)
    return _chained(materialize(table, "queries")) if chained else table


def _chained(lookup: DataFrame) -> DataFrame:
    lengths = [row["k"] for row in lookup.select("k").distinct().collect()]
    heads = lookup.select("k", "query", "target", F.explode(_prefixes(lengths, F.col("query"), F.col("k"))).alias("p"))
    held = lookup.select(F.col("k").alias("hk"), F.col("query").alias("head"), F.col("target").alias("to"))
    met = heads.join(held, (F.col("p.k") == F.col("hk")) & (F.col("p.prefix") == F.col("head")))
    chain = F.array_sort(F.collect_list(F.struct(F.col("hk").alias("k"), F.col("to").alias("target"))))
    return met.groupBy("k", "query", "target").agg(chain.alias("chain"))


def sample_windows(sequences: DataFrame, ks: list[int], uppercase: bool = True, piece: int = PIECE) -> DataFrame:
    """One row ``(gate, span)`` per sample position: its longest window and the start that every length shares."""
    cut = explode_pieces(sequences, max(ks) - 1, piece, uppercase)
    spans = cut.select(F.explode(windows("piece", min(ks), max(ks))).alias("span"))
    return spans.select(F.substring("span", 1, min(ks)).alias("gate"), "span")


def gates(lookup: DataFrame, ks: list[int]) -> DataFrame:
    return lookup.select(F.substring("query", 1, min(ks)).alias("gate")).distinct()


def sample_prefixes(
    sequences: DataFrame, ks: list[int], lookup: DataFrame, uppercase: bool = True, piece: int = PIECE
) -> DataFrame:
    """One row ``(k, query)`` per sample position and length that fits there, for positions whose start is in the lookup."""
    spans = sample_windows(sequences, ks, uppercase, piece).join(gates(lookup, ks), "gate", "left_semi")
    return spans.select(F.explode(_prefixes(ks, F.col("span"), F.length("span"))).alias("p")).select(
        "p.k", F.col("p.prefix").alias("query")
    )


def targets_of(spans: DataFrame, lookup: DataFrame, ks: list[int]) -> DataFrame:
    """Distinct ``(k, key)`` that some window of the sample leads to; ``spans`` as :func:`sample_windows` gives them.

    Windows and queries are sorted together inside their common start. The greatest query up to a window has every
    query that the window starts with as a prefix, as has all that lies between the two. A lookup without chains, as
    stored ones are, is joined once for each length instead.
    """
    asked = spans.distinct().join(gates(lookup, ks), "gate", "left_semi")
    if "chain" not in lookup.columns:
        each = asked.select(F.explode(_prefixes(ks, F.col("span"), F.length("span"))).alias("p")).select("p.k", F.col("p.prefix").alias("query"))
        return each.distinct().join(lookup, ["k", "query"]).select("k", F.col("target").alias("key")).distinct()
    none = F.lit(None).cast(lookup.schema["chain"].dataType)
    keys = lookup.select(F.substring("query", 1, min(ks)).alias("gate"), F.col("query").alias("span"), "chain")
    both = keys.unionByName(asked.withColumn("chain", none))
    before = Window.partitionBy("gate").orderBy("span", F.col("chain").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = F.when(F.col("chain").isNotNull(), F.struct("span", "chain"))
    met = both.withColumn("near", F.last(key, ignorenulls=True).over(before)).where("chain is null and near is not null")
    shared = lambda x: F.col("span").substr(F.lit(1), x["k"]) == F.col("near.span").substr(F.lit(1), x["k"])
    found = F.filter("near.chain", lambda x: x["k"].isin(ks) & (x["k"] <= F.length("span")) & shared(x))
    return met.select(F.explode(found).alias("t")).select("t.k", F.col("t.target").alias("key")).distinct()


def matches(sequences: DataFrame, index: DataFrame, lookup: DataFrame, ks: list[int], uppercase: bool = True) -> DataFrame:
    """``(name, k, slot, prefix)`` for every index entry that some sample shingle leads to."""
    return entries_at(index, targets_of(sample_windows(sequences, ks, uppercase), lookup, ks)).select("name", "k", "slot", "prefix").distinct()


def entries_at(index: DataFrame, targets: DataFrame) -> DataFrame:
    """The index entries of the distinct ``targets(k, key)``; a stored index stays in its buckets, and the targets go there."""
    if "salt" not in index.columns:
        return index.join(targets, ["k", "key"], "left_semi")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    return index.join(targets.select("k", "key", salts), BY, "left_semi")


def matches_once(
    sequences: DataFrame, entries: DataFrame, ks: list[int], ksize: int | None = None, uppercase: bool = True
) -> DataFrame:
    """The same matches without a stored index.

    The sample's distinct shingles and their reverse complements filter the index entries while
    these are being made, so that lookup table and gate are those of the few entries concerned: a
    shingle's start at the shortest length is itself a shingle of the sample, hence the gate sees all
    the keys it would see in the whole index.
    """
    spans = materialize(sample_windows(sequences, ks, uppercase).distinct(), "asked")
    asked = spans.select(F.explode(_prefixes(ks, F.col("span"), F.length("span"))).alias("p"))
    strands = F.explode(F.array(F.col("p.prefix"), reverse_complement("p.prefix"))).alias("key")
    near = materialize(asked.select("p.k", strands).distinct(), "near-keys")
    # A key of the sample begins, on either strand, with a key of the shortest length.
    starts = near.where(F.col("k") == min(ks)).select(F.col("key").alias("gate"))
    index = materialize(prefix_index(entries, ks, starts).join(near, ["k", "key"], "left_semi"), "near-index")
    lookup = materialize(lookup_table(index, min(ks), ksize, chained=True), "near-lookup")
    return index.join(targets_of(spans, lookup, ks), ["k", "key"], "left_semi").select("name", "k", "slot", "prefix").distinct()


def hits(found: DataFrame) -> DataFrame:
    """Distinct matched prefixes ``(name, k, prefix)``: the non-zero cells of the hit matrices."""
    return found.select("name", "k", "prefix").distinct()


def denominators(entries: DataFrame, ks: list[int]) -> DataFrame:
    """Distinct prefixes per sketch and length: ``(name, k, denom)``."""
    # A sketch has at most n shingles, so one row holds them.
    whole = entries.groupBy("name").agg(F.collect_list("kmer").alias("kmers"))

    def distinct(k: int) -> Column:
        prefixes = F.transform("kmers", lambda x: F.substring(x, 1, k))
        return F.struct(F.lit(k).alias("k"), F.size(F.array_distinct(prefixes)).cast("bigint").alias("denom"))

    return whole.select("name", F.inline(F.array(*[distinct(k) for k in ks])))


def containment(found: DataFrame, entries: DataFrame, ks: list[int], meta: DataFrame | None = None) -> DataFrame:
    """``(name, k, hits, denom, ci)`` for every sketch and length, zero where nothing matched.

    With ``meta`` (any table with ``name``) sets without a shingle are present as well, with zeros.
    """
    numerators = hits(found).groupBy("name", "k").agg(F.count("*").alias("hits"))
    count = F.coalesce("hits", F.lit(0).cast("bigint"))
    sizes = denominators(entries, ks)
    if meta is not None:
        every = meta.select("name", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
        sizes = every.join(sizes, ["name", "k"], "left").withColumn("denom", F.coalesce("denom", F.lit(0).cast("bigint")))
    ratio = F.when(F.col("denom") > 0, count / F.col("denom")).otherwise(F.lit(0.0))
    return sizes.join(numerators, ["name", "k"], "left").select("name", "k", count.alias("hits"), "denom", ratio.alias("ci"))


def wide(results: DataFrame, ks: list[int]) -> DataFrame:
    """One row per sketch with a column ``k=<k>`` per length, ascending."""
    columns = [F.max(F.when(F.col("k") == k, F.col("ci"))).alias(f"k={k}") for k in ks]
    return results.groupBy("name").agg(*columns)


def select_results(frame: DataFrame, ks: list[int], threshold: float, location: int = -1) -> DataFrame:
    """Rows whose containment at ``ks[location]`` reaches the threshold, best at the largest k first."""
    at = F.col(f"`k={ks[location]}`")
    return frame.where(at >= threshold).orderBy(F.col(f"`k={ks[-1]}`").desc(), "name")


def prepare(entries: DataFrame, ks: list[int], ksize: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored prefix index and lookup table of a database, ready for many queries."""
    place = os.path.join(scratch_dir(entries.sparkSession), f"prefix-index-{uuid.uuid4().hex}")
    write_index(prefix_index(entries, ks), place)
    index = read_index(entries.sparkSession, place)
    return index, materialize(lookup_table(index, min(ks), ksize), "lookup")
