"""Mixing sources to target weights by capped water-filling and seeded repetition (built-ins only).

Every source has a weight and a size. It may be repeated ``max_epochs`` times at most. The budget is
shared by weight; a source whose share exceeds its cap is clamped there and the excess goes to the
others by weight, until no share exceeds a cap. A source then takes every document ``floor(rate)``
times, and once more those documents whose seeded hash comes first, up to the fractional part.

Defined cases: a null text has size 0; a null source is a source; rows equal in id and text share
one decision; an empty table gives an empty result; a source of size 0 or without a positive weight
gets target 0. Documents may have any further columns, also ones named like those made here: they
travel inside one struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """``sources(source, size, weight)`` with ``target``.

    Each round clamps every source whose share is above its cap and shares the rest anew; only
    three totals come to the driver. The number of clamped sources rises in every round but the last.
    """
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    cap = F.when(weight > 0, F.col("size") * F.lit(float(max_epochs))).otherwise(F.lit(0.0))
    table = sources.withColumns({"w": weight, "cap": cap})
    rate, clamped = None, -1
    while True:
        # At a common rate a source gets rate * weight; one above its cap stays at the cap.
        full = F.lit(False) if rate is None else F.col("cap") < F.col("w") * F.lit(rate)
        row = table.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("open"),
        ).first()
        if row["n"] == clamped or not row["open"]:
            break
        clamped, rate = row["n"], (budget - row["taken"]) / row["open"]
    share = F.lit(0.0) if rate is None else F.least(F.col("w") * F.lit(rate), F.col("cap"))
    return table.withColumn("target", share).drop("w", "cap")


def by_code_point(weights: tuple[float, ...]) -> Callable[[DataFrame], DataFrame]:
    """Weights dealt out in turn along the sources' code-point order, null last.

    One row per source, so the one ordered partition holds no more than the list of sources.
    """

    def deal(sizes: DataFrame) -> DataFrame:
        turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
        return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))

    return deal


def sized(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = True) -> DataFrame:
    """``source, size, draw, tie`` of every document, and the document itself as the struct ``row``.

    ``draw`` is the seeded hash that orders a source's documents, ``tie`` separates equal ids.
    """
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.struct(F.col(id_col))
    return docs.select(
        row.alias("row"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), draw.alias("draw"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).alias("tie")
    )


def targets(documents: DataFrame, weights: Callable[[DataFrame], DataFrame], share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row per source: ``source, source_size, target, whole, last``.

    A document is taken ``whole`` times, and once more if ``(draw, tie)`` is at most ``last``. Sizes
    are first summed over 4096 ranges of the hash (map-side, so a hot source is no hot task); only
    the documents of the one range in which a source reaches its target are put in order.
    ``share`` is the budget as a multiple of all sizes.
    """
    place = F.conv(F.substring("draw", 1, 3), 16, 10).cast("int")
    ranges = materialize(documents.groupBy("source", place.alias("place")).agg(F.sum("size").alias("size")), "mix-ranges")
    sizes = ranges.groupBy("source").agg(F.sum("size").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    filled = water_fill(materialize(weights(sizes), "mix-weights"), share * total, max_epochs)
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    plan = filled.withColumn("whole", F.floor(rate)).select(
        F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "whole", (F.col("target") - F.col("whole") * F.col("size")).alias("need")
    )
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = (
        plan.join(ranges.withColumn("before", before), F.col("source").eqNullSafe(F.col("s")))
        .groupBy("s", "source_size", "target", "whole", "need")
        .agg(F.max(F.when(F.col("before") < F.col("need"), F.struct("place", "before"))).alias("edge"))
    )
    edges = materialize(edges, "mix-edges")
    # Inside the edge range: documents in order, as long as their middle lies below the need.
    inside = (
        documents.select("source", "size", "draw", "tie")
        .join(edges, F.col("source").eqNullSafe(F.col("s")) & (place == F.col("edge.place")))
        .groupBy("s", "need", F.col("edge.before").alias("before"), "draw", "tie")
        .agg(F.sum("size").alias("size"))
    )
    running = F.coalesce(F.sum("size").over(Window.partitionBy("s").orderBy("draw", "tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = inside.withColumn("at", F.col("before") + running + F.col("size") / 2).filter("at < need").groupBy(F.col("s").alias("l")).agg(F.max(F.struct("draw", "tie")).alias("reached"))
    joined = edges.join(last, F.col("s").eqNullSafe(F.col("l")), "left")
    # Nothing of the edge range is taken: then everything below its first hash is.
    start = F.struct(F.lpad(F.lower(F.conv(F.col("edge.place"), 10, 16)), 3, "0").alias("draw"), F.lit(-1).cast("bigint").alias("tie"))
    return materialize(
        joined.select(F.col("s").alias("source"), "source_size", "target", "whole", F.when(F.col("edge").isNotNull(), F.coalesce("reached", start)).alias("last")), "mix-targets"
    )


def mix(documents: DataFrame, plan: DataFrame) -> DataFrame:
    """``row, size, source_size, target, copies`` of every document of :func:`sized`.

    The plan has one row per source; it is broadcast only when its written size allows.
    """
    joined = documents.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
    extra = F.coalesce(F.struct("draw", "tie") <= F.col("last"), F.lit(False)).cast("bigint")
    return joined.select("row", "size", "source_size", "target", (F.coalesce("whole", F.lit(0)) + extra).alias("copies"))


def repeated(docs: DataFrame, weights: Callable[[DataFrame], DataFrame], share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The mixed documents: every row as often as the mix takes it, with its own columns."""
    plan = targets(materialize(sized(docs, seed, keep=False).drop("row"), "mix-sizes"), weights, share, max_epochs)
    return mix(sized(docs, seed), plan).filter("copies > 0").select("row", F.explode(F.expr("sequence(1, cast(copies as int))")).alias("nth")).select("row.*")
