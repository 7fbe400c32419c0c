"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (built-ins only).

The ring has ``cells`` equal cells. Every shard owns ``replicas`` points of it; a key belongs to the
first point at or after its cell. Keys arrive in ring order, and a key whose shard is full goes on
clockwise to the next point whose shard is not. A shard's bound is its part of all rows rounded up
or down, so the counts differ by one at most; the more room the bound leaves (``slack``), the fewer
keys move when a shard is added.

Only the number of rows in each cell comes to the driver: ``cells`` numbers, whatever the input.
They give a table of segments (a cell's rows from one rank to another go to a shard), at most
``cells + shards`` rows, and a row finds its segment by its rank in its cell.

Defined cases: a null id or text hashes as the empty string; equal rows get slots one after the
other in any order; an empty table gives an empty result; further columns travel inside a struct.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.session import materialize

CELLS = 1 << 14
REPLICAS = 64


def ring(shards: int, replicas: int = REPLICAS, cells: int = CELLS) -> list[tuple[int, int]]:
    """The points ``(cell, shard)`` in clockwise order; equal cells are taken in order of the shard."""
    points = []
    for shard in range(shards):
        for replica in range(replicas):
            digest = hashlib.md5(f"shard-{shard}-{replica}".encode()).hexdigest()
            points.append((int(digest[:8], 16) % cells, shard))
    return sorted(points)


def bounds(rows: int, shards: int, slack: float = 0.0) -> list[int]:
    """Most rows of each shard. Without slack they sum up to ``rows`` and differ by one at most."""
    if slack:
        return [-(-int(rows * (1 + slack)) // shards) + 1] * shards
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def sweep(counts: dict[int, int], points: list[tuple[int, int]], limits: list[int], cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """Segments ``(cell, shard, first rank, one past the last, first slot)``.

    Cells are visited in ring order. ``following[i]`` leads from a point to the next one whose shard
    has room; links over full shards are shortened as they are found.
    """
    room, used = list(limits), [0] * len(limits)
    following = list(range(len(points)))
    segments = []

    def open_point(i: int) -> int:
        path = []
        while True:
            i %= len(points)
            if room[points[i][1]] > 0:
                break
            path.append(i)
            i = following[i] if following[i] != i else i + 1
        for j in path:
            following[j] = i
        return i

    at = 0
    for cell in sorted(counts):
        while at < len(points) and points[at][0] < cell:
            at += 1
        rank, left = 0, counts[cell]
        while left:
            shard = points[open_point(at)][1]
            some = min(left, room[shard])
            segments.append((cell, shard, rank, rank + some, used[shard]))
            room[shard] -= some
            used[shard] += some
            rank, left = rank + some, left - some
    return segments


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, keep: bool = True) -> DataFrame:
    """``cell, draw`` of every document by its id, its ``size`` and ``text_crc32``, and the document as the struct ``row``."""
    draw = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.struct(F.col(id_col))
    return docs.select(
        row.alias("row"),
        (F.conv(F.substring(draw, 1, 8), 16, 10).cast("bigint") % cells).cast("int").alias("cell"),
        draw.alias("draw"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def _table(spark, segments) -> DataFrame:
    """The segments as a table written by the JVM; their number is bounded by the ring."""
    schema = "array<struct<c:int,shard:int,low:bigint,high:bigint,base:bigint>>"
    names = ("c", "shard", "low", "high", "base")
    text = json.dumps([dict(zip(names, s, strict=True)) for s in segments])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), schema)))


def _rank(*order: Column) -> Column:
    return F.row_number().over(Window.partitionBy("cell").orderBy(*order)) - 1


def assign(documents: DataFrame, shards: int, replicas: int = REPLICAS, cells: int = CELLS, slack: float = 0.0) -> DataFrame:
    """``documents`` of :func:`keyed` with ``shard`` and ``slot``, gapless from 0 in each shard.

    ``documents`` is read twice, so give a written table where making it is costly. The window
    orders one cell at a time, the sixteen-thousandth part of the rows.
    """
    counts = {r["cell"]: r["n"] for r in documents.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    segments = sweep(counts, ring(shards, replicas, cells), bounds(sum(counts.values()), shards, slack), cells)
    table = _table(documents.sparkSession, segments)
    ranked = documents.withColumn("rank", _rank(F.col("draw"), F.col("text_crc32"), F.col("size")))
    # At most `cells + shards` rows of 32 bytes: half a megabyte for the default ring.
    joined = ranked.join(F.broadcast(table), (F.col("cell") == F.col("c")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return joined.withColumn("slot", F.col("base") + F.col("rank") - F.col("low")).drop("c", "low", "high", "base", "rank", "cell", "draw")


def sharded(docs: DataFrame, shards: int = 16, written: bool = False, **options) -> DataFrame:
    """The documents with ``shard`` and ``slot``; a column of one of these names gives way to the new one.

    ``docs`` is read twice and must be the same both times: it is copied first, unless it is ``written``
    already.
    """
    rows = keyed(docs)
    if not written:
        rows = materialize(rows, "shard-rows")
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return assign(rows, shards, **options).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "shard", F.col("slot").cast("bigint").alias("slot"))
