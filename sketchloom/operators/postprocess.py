"""Specific mode: repeat the containment with the shingles that point to one selected set only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.operators.multik import _prefixes


def selected_entries(entries: DataFrame, selected: DataFrame) -> DataFrame:
    """Entries of the sketches named in ``selected``."""
    return entries.join(selected.select("name").distinct(), "name", "left_semi")


def multiplicities(entries: DataFrame, ks: list[int]) -> DataFrame:
    """How many sketch slots carry each prefix: ``(k, prefix, slots, name)``.

    ``name`` is a carrier; for a prefix on a single slot it is the only one, so that unique prefixes
    need no join back to their sketch.
    """
    cut = entries.select("name", F.explode(_prefixes(ks, F.col("kmer"))).alias("p"))
    return cut.groupBy("p.k", "p.prefix").agg(F.count("*").alias("slots"), F.min("name").alias("name"))


def unique_prefixes(counts: DataFrame) -> DataFrame:
    return counts.where(F.col("slots") == 1).select("name", "k", "prefix")


def unique_tally(entries: DataFrame, ks: list[int]) -> DataFrame:
    """Unique prefixes per sketch and length: ``(name, k, num_unique)``."""
    every = entries.select("name").distinct().select("name", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    counts = unique_prefixes(multiplicities(entries, ks)).groupBy("name", "k").agg(F.count("*").alias("found"))
    zero = F.lit(0).cast("bigint")
    return every.join(counts, ["name", "k"], "left").select("name", "k", F.coalesce("found", zero).alias("num_unique"))


def specific_containment(
    hit_rows: DataFrame, entries: DataFrame, meta: DataFrame, ks: list[int]
) -> DataFrame:
    """``(name, k, hits, denom, ci)`` over the selected ``entries``, counting unique prefixes only.

    The denominator stays the number of distinct prefixes. A sketch with free slots counts one more,
    for the empty shingle of those slots, as the original tool does.
    """
    unique = unique_prefixes(multiplicities(entries, ks))
    kept = hit_rows.join(unique, ["name", "k", "prefix"], "left_semi")
    numerators = kept.groupBy("name", "k").agg(F.count("*").alias("hits"))
    cut = entries.select("name", "slot", F.explode(_prefixes(ks, F.col("kmer"))).alias("p"))
    per_prefix = cut.groupBy("name", "p.k", "p.prefix").agg(F.count("*").alias("slots"))
    totals = per_prefix.groupBy("name", "k").agg(F.count("*").alias("distinct"), F.sum("slots").alias("filled"))
    padded = F.when(F.col("filled") < F.col("n"), 1).otherwise(0)
    count = F.coalesce("hits", F.lit(0).cast("bigint"))
    return (
        totals.join(meta.select("name", "n"), "name")
        .withColumn("denom", F.col("distinct") + padded)
        .join(numerators, ["name", "k"], "left")
        .select("name", "k", count.alias("hits"), "denom", (count / F.col("denom")).alias("ci"))
    )
