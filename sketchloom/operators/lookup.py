"""Which sketches contain a given shingle: an inverted index and an equi-join.

This answers the same question as a tree of per-node shingle dictionaries; the shape of such a tree
never changes the answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inverted_index(entries: DataFrame) -> DataFrame:
    """``(kmer, name)``, clustered by shingle so that written files can be pruned."""
    return entries.select("kmer", "name")


def find(index: DataFrame, kmer: str) -> DataFrame:
    """Names of the sketches that hold ``kmer``; its length must be that of the index."""
    sample = index.select("kmer").first()
    if sample is None:
        raise ValueError("the index has no shingles and cannot be queried")
    if len(sample["kmer"]) != len(kmer):
        raise ValueError(f"the query has length {len(kmer)}, the index has {len(sample['kmer'])}")
    return index.where(F.col("kmer") == kmer).select("name")


def find_all(index: DataFrame, kmers: DataFrame) -> DataFrame:
    """``(kmer, name)`` for every queried shingle that some sketch holds."""
    return index.join(kmers.select("kmer").distinct(), "kmer", "left_semi")
