"""Pairs of sketches at or above a similarity: the sparse form of the matrices, and a prefix-filtered join for its candidates.

A pair is found if the Jaccard index of either direction reaches the threshold, so the smaller sketch, of m
slots, shares at least ``a = ceil(threshold * m)`` hashes with the larger one. Hashes are ordered by
rising frequency; the first shared one is then among the first ``m - a + 1`` of the smaller sketch and has
at least ``a - 1`` behind it on either side.

:func:`similar_pairs` looks at these prefixes block by block (``blocks``): sketches are written once, and nothing is sent for a
candidate. Its work follows the square of the blocks and the pairs that are similar. :func:`candidate_pairs` is the same filter as a join over the whole
table: a long list is dealt into a grid of salted cells, so that neither side of a cell is larger than ``LIST``, and pairs that meet in
several hashes are counted by one aggregation; it shuffles a row for every meeting.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.operators.blocks import distinct_sketches, pair_table, sums
from sketchloom.operators.sketch import as_sets
from sketchloom.session import materialize, small_or_shuffled

LIST = 1024
HOME = 8192  # sketches of a home
PAIRS = 1 << 21  # pairs that one task compares at a time
MET = 3  # shared hashes in which a pair is to meet before it is compared
SLAB = 1 << 21  # slots of both sides that a pass walks


def least_shared(size: Column, threshold: float) -> Column:
    """``ceil(threshold * size)``, one at least; a hair below, so that rounding loses no pair."""
    return F.greatest(F.ceil(size * F.lit(threshold) - F.lit(1e-6)).cast("int"), F.lit(1))


def ranked(entries: DataFrame) -> DataFrame:
    """``name, h, many, place, size``: slots by rising frequency of their hash, as far as another sketch has it.

    ``place`` counts all slots of the sketch, the unshared ones first.
    """
    frequency = entries.groupBy("h").agg(F.count(F.lit(1)).alias("many"))
    shared = entries.select("name", "h").join(frequency.filter("many > 1"), "h")
    sizes = entries.groupBy("name").agg(F.count(F.lit(1)).alias("size"))
    own = Window.partitionBy("name")
    placed = shared.withColumns({"nth": F.row_number().over(own.orderBy("many", "h")), "held": F.count(F.lit(1)).over(own)}).join(sizes, "name")
    return placed.select("name", "h", "many", (F.col("size") - F.col("held") + F.col("nth") - 1).cast("int").alias("place"), F.col("size").cast("int").alias("size"))


def candidate_pairs(places: DataFrame, threshold: float, met: int = MET) -> DataFrame:
    """Distinct ``(small, large)`` that can reach the threshold; ``places`` as :func:`ranked` gives them.

    Of ``a`` hashes to share, the first ``l = min(met, a)`` shared ones have ``a - l`` others behind them on either side:
    pairs are told by these places and must meet in l of them. A place of a list is joined only with probes whose ``a - l``
    has a number of bits that it can reach, so the places at the end of long sketches, of the frequent hashes, meet no long probe.
    """
    cells = F.ceil(F.col("many") / LIST).cast("int")
    every = F.explode(F.sequence(F.lit(0), cells - 1))
    own = F.pmod(F.xxhash64("name"), cells).cast("int")
    need = least_shared(F.col("size"), threshold)
    times = F.least(F.lit(met), F.col("need"))
    bits = lambda many: F.length(F.bin(many))
    probe = places.withColumn("need", need).withColumn("times", times).withColumn("rest", F.col("need") - F.col("times"))
    probe = probe.filter(F.col("place") < F.col("size") - F.col("rest"))
    probe = probe.select(
        "h", own.alias("row"), every.alias("column"), bits(F.col("rest")).alias("bits"), F.col("name").alias("small"), F.col("size").alias("m"), "times", "rest"
    )
    behind = F.col("size") - F.col("place") - 1
    lists = places.select("h", "name", "place", "size", "many", F.explode(F.sequence(F.lit(1), bits(behind))).alias("bits"))
    lists = lists.select("h", every.alias("row"), own.alias("column"), "bits", F.col("name").alias("large"), behind.alias("behind"), "size")
    later = (F.col("size") > F.col("m")) | ((F.col("size") == F.col("m")) & (F.col("large") > F.col("small")))
    joined = probe.join(lists, ["h", "row", "column", "bits"]).filter(later & (F.col("behind") >= F.col("rest")))
    counted = joined.groupBy("small", "large").agg(F.count(F.lit(1)).alias("found"), F.first("times").alias("times"))
    return counted.filter("found >= times").select("small", "large")


def walked(pair: np.ndarray, many: int, h: np.ndarray, ci: np.ndarray, cj: np.ndarray, limit: int) -> list[np.ndarray]:
    """Shared hashes and multiplicities of i and j that each direction's capped walk reaches, for many pairs at once.

    ``h`` has the slots of both sides of each pair, ``ci`` and ``cj`` the count on either side (0: not there). The limit
    is looked at only where a round starts, as in ``blocks.rounds``.
    """
    span = int(h.max(initial=0)) + 1
    # Both sides come in order, so that a stable sort of one key only merges them.
    order = np.argsort(pair * span + h, kind="stable") if many * span < 1 << 63 else np.lexsort((h, pair))
    pair, h, ci, cj = pair[order], h[order], ci[order], cj[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (pair[1:] != pair[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    pair, ci, cj = pair[at], np.add.reduceat(ci, at), np.add.reduceat(cj, at)
    first = np.searchsorted(pair, np.arange(many + 1))
    start = np.repeat(first[:-1], np.diff(first))
    both, out = (ci > 0) & (cj > 0), []
    for ahead, behind in ((ci, cj), (cj, ci)):
        tag = np.where(both, 3, np.where(ahead > 0, 1, 2))
        before = np.concatenate([[3], tag[:-1]])
        before[first[:-1]] = 3
        begins = (before == 3) | ((before == 2) & (tag == 1))
        begun = np.maximum.accumulate(np.where(begins, np.arange(len(pair)), 0)) - start
        met = both & (begun <= limit)
        out += [sums(met.astype(np.int64), first), sums(np.where(met, ci, 0), first), sums(np.where(met, cj, 0), first)]
    return out


def homes(sets: DataFrame) -> DataFrame:
    """``id, name, hs, cs`` of ``(name, hs, cs)``: numbers whose upper half is a home, shared by some ``HOME`` sketches.

    Similar sketches often have their smallest hash in common, so it decides on the home; where it is that of many, with the name.
    """
    blocks = max(1, math.ceil(sets.count() / HOME))
    least = sets.select("name", F.col("hs")[0].alias("least"))
    alike = least.groupBy("least").agg(F.ceil(F.count(F.lit(1)) / HOME).alias("parts"))
    home = F.pmod(F.xxhash64("least", F.pmod(F.xxhash64("name"), F.col("parts"))), F.lit(blocks))
    placed = least.join(alike, "least").select("name", home.alias("home"))
    nth = F.row_number().over(Window.partitionBy("home").orderBy("name"))
    numbered = placed.select("name", (F.shiftleft("home", 32) + nth).alias("id"))
    return numbered.join(sets, "name").select("id", "name", "hs", "cs")


def similar_pairs(entries: DataFrame, limit: int, threshold: float) -> DataFrame:
    """Pairs ``name_i <= name_j`` of distinct sketches whose Jaccard index reaches ``threshold`` in a direction.

    Columns as those of ``blocks.pair_table``; a sketch is its own pair. Copies of a sketch share its pairs: find them
    with ``blocks.distinct_sketches``.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a similarity join needs a threshold above 0 and at most 1")
    heads = materialize(distinct_sketches(entries).where(F.col("name") == F.col("representative")).select("name"), "join-heads")
    rows = as_sets(entries).join(small_or_shuffled(heads), "name", "left_semi")
    return pair_table(rows, heads.count(), limit, threshold=threshold)
