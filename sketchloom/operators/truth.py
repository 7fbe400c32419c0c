"""Exact containment from all (canonical) shingles, and the error of an estimate against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.functions.seq import DNA, PIECE, canonical, explode_pieces, shingles


def distinct_shingles(
    sequences: DataFrame, ks: list[int], alphabet: str | None = DNA, strand_neutral: bool = True, piece: int = PIECE
) -> DataFrame:
    """Distinct ``(name, k, kmer)`` of every length in one pass over the text."""

    def at(k: int):
        neutral = (lambda g: canonical(g)) if strand_neutral else (lambda g: g)
        return F.transform(
            shingles("piece", k, alphabet), lambda g: F.struct(F.lit(k).alias("k"), neutral(g).alias("kmer"))
        )

    cut = explode_pieces(sequences, max(ks) - 1, piece)
    # A piece carries the overlap of the longest length; shorter shingles found twice merge here.
    grams = cut.select("name", F.explode(F.flatten(F.array(*[at(k) for k in ks]))).alias("g"))
    return grams.select("name", "g.k", "g.kmer").distinct()


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shingles ``(k, kmer)`` that two samples have in common."""
    return left.select("k", "kmer").intersect(right.select("k", "kmer"))


def true_containment(training: DataFrame, query: DataFrame) -> DataFrame:
    """``(name, k, hits, denom, ci)`` from two frames of distinct shingles.

    The query side is unique on the join key, so a shingle that very many sets share makes a skewed
    partition on one side only, which adaptive execution splits.
    """
    asked = query.select("k", "kmer").distinct().withColumn("hit", F.lit(1))
    return (
        training.join(asked, ["k", "kmer"], "left")
        .groupBy("name", "k")
        .agg(F.count("hit").alias("hits"), F.count("*").alias("denom"))
        .withColumn("ci", F.col("hits") / F.col("denom"))
    )


def exact_median(values: DataFrame, group: str, value: str) -> DataFrame:
    """``(group, median)`` without bringing a group into one task.

    Equal values are counted first; a rough quantile grid then tells which bucket holds the middle,
    and only the rows of that bucket are ranked.
    """
    counted = values.groupBy(group, value).agg(F.count("*").alias("c"))
    grid = values.groupBy(group).agg(
        F.percentile_approx(value, [i / 200 for i in range(1, 200)], 2000).alias("grid"),
        F.count("*").alias("total"),
    )
    # One row per group, and at most 200 buckets each: groups are shingle lengths, a handful.
    placed = counted.join(F.broadcast(grid), group).withColumn("bucket", F.size(F.filter("grid", lambda g: g < F.col(value))))
    sums = placed.groupBy(group, "bucket").agg(F.sum("c").alias("in_bucket"))
    upto = F.sum("in_bucket").over(Window.partitionBy(group).orderBy("bucket"))
    offsets = sums.select(group, "bucket", (upto - F.col("in_bucket")).alias("skip"), upto.alias("upto"))
    low, high = F.expr("(total + 1) div 2"), F.expr("total div 2 + 1")
    middle = placed.join(F.broadcast(offsets), [group, "bucket"]).where((F.col("skip") < high) & (F.col("upto") >= low))
    reached = F.col("skip") + F.sum("c").over(Window.partitionBy(group, "bucket").orderBy(value))
    ranked = middle.withColumn("reached", reached).withColumn("passed", F.col("reached") - F.col("c"))

    def at(rank):
        return F.max(F.when((F.col("passed") < rank) & (F.col("reached") >= rank), F.col(value)))

    return ranked.groupBy(group).agg(((at(low) + at(high)) / 2).alias("median"))


def error_statistics(estimate: DataFrame, truth: DataFrame) -> DataFrame:
    """Per length: sum, mean and median of the absolute difference of two containment frames."""
    both = estimate.select("name", "k", F.col("ci").alias("est")).join(
        truth.select("name", "k", F.col("ci").alias("ref")), ["name", "k"]
    )
    gaps = both.select("k", F.round(F.abs(F.col("est") - F.col("ref")), 12).alias("gap"))
    sums = gaps.groupBy("k").agg(F.sum("gap").alias("total"), F.avg("gap").alias("mean"), F.count("*").alias("pairs"))
    return sums.join(exact_median(gaps, "k", "gap"), "k")
