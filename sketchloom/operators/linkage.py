"""Agglomerative linkage of similar sets by reciprocal nearest neighbours: the tree over sketches, without its dictionaries.

In every round each cluster finds its nearest neighbour, all pairs that are each other's nearest are merged at once,
and distances to the merged clusters follow from those to their parts (Lance-Williams). None of the linkages here
lets a merged cluster come nearer than its parts were, so merging pairs of one round at once gives the tree that merging the
nearest pair of all, one at a time, gives. Rounds grow with the depth of the tree.

Pairs may be sparse: a pair that is not listed has the distance ``absent``, the largest there is, and clusters that
only such pairs hold apart stay apart, so the result is a forest. Distances are one table, written anew each
round; only its emptiness reaches the driver.

Single linkage needs no rounds: a pair that lighter ones connect is never merged. Parts of the table drop such pairs each for itself, then fewer and larger
parts do, until a few pairs for each set are left; those of a connected component are merged in one task, nearest first.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.operators.blocks import distinct_sketches
from sketchloom.operators.cluster import components
from sketchloom.operators.simjoin import similar_pairs
from sketchloom.session import discard, materialize

METHODS = ("single", "complete", "average", "ward")
FOLD = 16  # parts of the pairs that become one, once each has dropped what it can


def _folded(pairs: DataFrame, sizes: DataFrame, others: DataFrame, method: str, absent: float | None) -> DataFrame:
    """``(x, y, d)`` with the ``x`` that merge made one: ``sizes(x, n, into, total, height, parts)``, ``others(y, ny)``."""
    rows = pairs.join(sizes, "x").join(others, "y")
    if method == "single":
        d = F.min("d")
    elif method == "complete":
        d = F.when(F.count(F.lit(1)) == F.first("parts"), F.max("d"))
    elif method == "average":
        missing = 0.0 if absent is None else absent
        d = F.lit(missing) + F.sum(F.col("n") * (F.col("d") - missing)) / F.first("total")
    else:
        near = F.sum((F.col("n") + F.col("ny")) * F.col("d") * F.col("d"))
        own = F.first(F.col("ny") * F.col("height") * F.col("height"))
        alone = F.first("parts") == 1
        d = F.when(alone, F.first("d")).otherwise(F.sqrt(F.greatest(near - own, F.lit(0.0)) / F.first(F.col("total") + F.col("ny"))))
    return rows.groupBy(F.col("into").alias("x"), "y").agg(d.alias("d")).where("d is not null")


def _trees(x: np.ndarray, y: np.ndarray, d: np.ndarray, many: int) -> Iterator[tuple[float, np.ndarray, list[int], list[int]]]:
    """By rising distance: the pairs at it and the trees of lighter pairs on both sides; all of them are connected before the next."""
    root = list(range(many))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    order = np.argsort(d, kind="stable")
    at = np.append(np.flatnonzero(np.append(True, d[order][1:] != d[order][:-1])), len(order)) if len(order) else [0]
    for a, b in zip(at[:-1], at[1:], strict=True):
        some = order[a:b]
        left, right = ([find(v) for v in side[some].tolist()] for side in (x, y))
        yield float(d[some[0]]), some, left, right
        for u, v in zip(left, right, strict=True):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)


def _coded(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The sets of a table of pairs in order, and the numbers of both sides."""
    x, y = (table.column(c).combine_chunks() for c in ("x", "y"))
    names = pc.unique(pa.concat_arrays([x, y]))
    names = names.take(pc.sort_indices(names.cast(pa.binary()) if pa.types.is_string(names.type) else names))
    return names, *(pc.index_in(side, names).to_numpy(zero_copy_only=False).astype(np.int64) for side in (x, y))


def _lightest(table: DataFrame) -> DataFrame:
    """Drop, in each part of the pairs ``(x, y, d)``, those whose sets lighter ones connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        part = pa.Table.from_batches(held)
        names, x, y = _coded(part)
        keep = [some[np.array(u) != np.array(v)] for _, some, u, v in _trees(x, y, part.column("d").to_numpy(), len(names))]
        yield from part.take(pa.array(np.sort(np.concatenate([np.zeros(0, np.int64), *keep])))).to_batches()

    return table.mapInArrow(run, table.schema)


def _singly(table: DataFrame, clusters: DataFrame) -> DataFrame:
    """The merges of single linkage from pairs ``(x, y, d)`` and ``clusters(x, n)``; equal distances go by name."""
    parts = table.rdd.getNumPartitions()
    while parts > 1:
        fewer = materialize(_lightest(table), "linkage-light")
        discard(table)
        parts = -(-parts // FOLD)
        table = fewer.coalesce(parts)
        table.stored_at = fewer.stored_at
    links = table.select(F.col("x").alias("src"), F.col("y").alias("dst"))
    placed = components(clusters.select(F.col("x").alias("name")), links)
    one, two = (clusters.select(F.col("x").alias(c), F.col("n").alias(f"n_{c}")) for c in "xy")
    whole = table.join(one, "x").join(two, "y").join(placed.withColumnRenamed("name", "x"), "x")
    kind = table.schema["x"].dataType.simpleString()

    def run(part: pa.Table) -> pa.Table:
        names, x, y = _coded(part)
        size = np.zeros(len(names), dtype=np.int64)
        size[x], size[y] = part.column("n_x").to_numpy(), part.column("n_y").to_numpy()
        size, out = size.tolist(), []
        for d, _, left, right in _trees(x, y, part.column("d").to_numpy(), len(names)):
            near: dict[int, set[int]] = {}
            for u, v in zip(left, right, strict=True):
                if u != v:
                    near.setdefault(u, set()).add(v)
                    near.setdefault(v, set()).add(u)
            done: set[int] = set()
            # The first tree of a group at this distance takes in its neighbours, the least name first.
            for u in sorted(near):
                if u in done:
                    continue
                done.add(u)
                ahead = list(near[u])
                heapify(ahead)
                while ahead:
                    v = heappop(ahead)
                    if v not in done:
                        done.add(v)
                        size[u] += size[v]
                        out.append((u, v, d, size[u]))
                        for w in near[v] - done:
                            heappush(ahead, w)
        rows = list(zip(*out, strict=True)) if out else [[]] * 4
        sides = [names.take(pa.array(r, pa.int64())) for r in rows[:2]]
        return pa.Table.from_arrays([*sides, pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.int64())], ["left", "right", "height", "size"])

    merged = whole.select("cluster", "x", "y", "d", "n_x", "n_y").groupBy("cluster").applyInArrow(run, f"left {kind}, right {kind}, height double, size bigint")
    return materialize(merged, "linkage-merges")


def linkage(pairs: DataFrame, method: str = "average", absent: float | None = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """``(left, right, height, size)``: one row per merge, from distances ``(a, b, d)`` of different sets.

    A cluster is called by its least member; ``left`` goes on as the name of both and ``right`` is never seen again, so a
    row's parts are the clusters of those names just before. A pair counts once, in either order, with its least
    distance; pairs at ``absent`` or beyond, of a set with itself, or with a null are left out. Equal distances go by name. ``ward`` needs
    the distances of all pairs and ``absent=None``; sets without a pair have no row. ``weights(name, n)`` are the sets that a name
    stands for; one each where not given.
    """
    if method not in METHODS:
        raise ValueError(f"unknown linkage {method!r}; there are {', '.join(METHODS)}")
    if (method == "ward") != (absent is None):
        raise ValueError("ward needs all pairs and absent=None, the others a distance of absent pairs")
    known = pairs.where("a <> b and d is not null")
    known = known.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("d").cast("double").alias("d"))
    near = known if absent is None else known.where(F.col("d") < absent)
    table = materialize(near, "linkage-pairs")
    names = table.select("x").union(table.select("y")).distinct()
    given = names.sparkSession.createDataFrame([], f"x {pairs.schema['a'].dataType.simpleString()}, n bigint") if weights is None else weights.select(F.col("name").alias("x"), F.col("n").cast("bigint").alias("n"))
    clusters = materialize(names.join(given, "x", "left").select("x", F.coalesce("n", F.lit(1)).alias("n")), "linkage-clusters")
    if method == "single":
        return _singly(table, clusters)
    if absent is None:
        many = clusters.count()
        if table.count() != many * (many - 1) // 2:
            raise ValueError("ward needs the distance of every pair of sets")
    merges = []
    while not table.isEmpty():
        mirrored = table.unionByName(table.select(F.col("y").alias("x"), F.col("x").alias("y"), "d"))
        # One order of all pairs, the same from both ends, so that the first pair of all is always merged.
        first = F.struct("d", F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high"))
        nearest = materialize(mirrored.groupBy("x").agg(F.min_by("y", first).alias("y"), F.min("d").alias("d")), "linkage-nearest")
        back = nearest.where("x > y").select(F.col("x").alias("y"), F.col("y").alias("x"))
        met = nearest.where("x < y").join(back, ["x", "y"])
        one, two = (clusters.withColumnsRenamed({"x": side, "n": f"n_{side}"}) for side in "xy")
        merged = met.join(one, "x").join(two, "y").select(F.col("x").alias("left"), F.col("y").alias("right"), F.col("d").alias("height"), (F.col("n_x") + F.col("n_y")).alias("size"))
        merged = materialize(merged, "linkage-merges")
        merges.append(merged)
        named = F.array(F.col("left"), F.col("right"))
        moves = merged.select(F.explode(named).alias("x"), F.col("left").alias("into"), F.col("size").alias("total"), "height", F.lit(2).alias("parts"))
        state = clusters.join(moves, "x", "left").select(
            "x", "n", F.coalesce("into", "x").alias("into"), F.coalesce("total", "n").alias("total"), "height", F.coalesce("parts", F.lit(1)).alias("parts")
        )
        state = materialize(state, "linkage-state")
        targets = state.select(F.col("x").alias("y"), F.col("n").alias("ny"))
        inner = state.select("x", "into"), state.select(F.col("x").alias("y"), F.col("into").alias("other"))
        between = mirrored.join(inner[0], "x").join(inner[1], "y").where("into <> other").select("x", "y", "d")
        half = _folded(between, state, targets, method, absent).select(F.col("y").alias("x"), F.col("x").alias("y"), "d")
        after = state.groupBy(F.col("into").alias("x")).agg(F.first("total").alias("n"))
        whole = _folded(half, state, after.select(F.col("x").alias("y"), F.col("n").alias("ny")), method, absent)
        kept = whole.where("x < y") if absent is None else whole.where((F.col("x") < F.col("y")) & (F.col("d") < absent))
        following, left_over = materialize(kept, "linkage-pairs"), materialize(after, "linkage-clusters")
        discard(table, clusters, nearest, state)
        table, clusters = following, left_over
    spark = pairs.sparkSession
    kind = pairs.schema["a"].dataType.simpleString()
    empty = spark.createDataFrame([], f"left {kind}, right {kind}, height double, size bigint")
    if not merges:
        return empty
    paths = [m.stored_at for m in merges]
    return spark.read.schema(empty.schema).parquet(*paths)


def cut(nodes: DataFrame, merges: DataFrame, height: float) -> DataFrame:
    """Clusters ``(name, cluster)`` of ``nodes(name)`` below a height, labelled by their least member."""
    links = merges.where(F.col("height") <= height).select(F.col("left").alias("src"), F.col("right").alias("dst"))
    return components(nodes, links)


def sketch_linkage(entries: DataFrame, n: int, threshold: float, method: str = "average") -> tuple[DataFrame, DataFrame]:
    """The merges of sketches, and ``(name, representative)``: copies are grouped first and count as often as they occur.

    The distance is one less the larger Jaccard index of both directions; pairs below ``threshold`` count as absent. A copy belongs
    to its representative at height 0, without a row.
    """
    groups = materialize(distinct_sketches(entries), "copies")
    pairs = similar_pairs(entries, n, threshold)
    similarity = F.greatest(F.col("common_ij") / F.col("size_i"), F.col("common_ji") / F.col("size_j"))
    weights = groups.groupBy(F.col("representative").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    distances = pairs.select(F.col("name_i").alias("a"), F.col("name_j").alias("b"), (1 - similarity).alias("d"))
    return linkage(distances, method, 1.0, weights), groups
