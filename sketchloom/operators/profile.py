"""Arithmetic on hierarchical abundance profiles.

A profile is ``(tax_id, rank, tax_path array<string>, tax_path_sn array<string>, abundance)``, one
row per taxon, paths from the root down to the taxon itself. The root is not a row; it is named
``-1`` where it appears as an ancestor. Paths are taken to be consistent: a taxon's ancestors are
those on its own path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The root's name, and the abundance below which a row is not written.
ROOT = "-1"
EPSILON = 1e-16


def combine_rows(rows: DataFrame) -> DataFrame:
    """Add up repeated taxa; the other columns are those of the greatest path among the repeats."""
    last = F.max_by(F.struct("rank", "tax_path", "tax_path_sn"), F.concat_ws("|", "tax_path"))
    grouped = rows.groupBy("tax_id").agg(last.alias("row"), F.sum("abundance").alias("abundance"))
    return grouped.select("tax_id", "row.rank", "row.tax_path", "row.tax_path_sn", "abundance")


def blank_missing(profile: DataFrame) -> DataFrame:
    """Blank path elements that are no taxon of the profile, and place every taxon under its ancestor.

    Adds ``ancestor`` (nearest filled element above, other than the taxon itself, else the root) and
    ``branch_length`` (one more for every level skipped).
    """
    known = profile.select(F.col("tax_id").alias("element")).withColumn("known", F.lit(True))
    elements = profile.select("tax_id", F.posexplode("tax_path").alias("pos", "element"))
    checked = (
        elements.join(known, "element", "left")
        .select("tax_id", "pos", F.when(F.col("known"), F.col("element")).otherwise("").alias("element"))
        # A path has one element per rank, so this collects a handful of values per taxon.
        .groupBy("tax_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "element"))).alias("path"))
        .select("tax_id", F.col("path.element").alias("tax_path"))
    )
    return place(profile.drop("tax_path").join(checked, "tax_id"))


def place(profile: DataFrame) -> DataFrame:
    depth = F.size("tax_path")
    above = F.slice("tax_path", F.lit(1), F.greatest(depth - 1, F.lit(0)))
    usable = F.transform(
        above, lambda x, i: F.when((x != "") & (x != F.col("tax_id")), i + 1).otherwise(0)
    )
    at = F.coalesce(F.array_max(usable), F.lit(0))
    return profile.withColumn("at", at).select(
        "tax_id",
        "rank",
        "tax_path",
        "tax_path_sn",
        "abundance",
        F.when(F.col("at") > 0, F.try_element_at("tax_path", F.col("at"))).otherwise(ROOT).alias("ancestor"),
        F.greatest(depth - F.col("at"), F.lit(1)).alias("branch_length"),
    )


def threshold(profile: DataFrame, least: float) -> DataFrame:
    """Set abundances below ``least`` to zero."""
    return profile.withColumn("abundance", F.when(F.col("abundance") < least, 0.0).otherwise(F.col("abundance")))


def subtract_down(placed: DataFrame) -> DataFrame:
    """Take the children's abundances off every taxon, leaving what is its own."""
    children = (
        placed.where(F.size("tax_path") > 1)
        .groupBy(F.col("ancestor").alias("tax_id"))
        .agg(F.sum("abundance").alias("below"))
    )
    own = F.col("abundance") - F.coalesce("below", F.lit(0.0))
    return placed.join(children, "tax_id", "left").withColumn("abundance", own).drop("below")


def add_up(placed: DataFrame) -> DataFrame:
    """Give every taxon the sum of its own and all its descendants' abundances.

    Each row sends its abundance to all the filled elements of its path at once; the sum combines on
    the map side, so a taxon near the root is no hot spot.
    """
    line = F.array_union(
        F.array("tax_id"), F.filter(F.slice("tax_path", 1, F.greatest(F.size("tax_path") - 1, F.lit(0))), lambda x: x != "")
    )
    sums = placed.select(F.explode(line).alias("tax_id"), "abundance").groupBy("tax_id").agg(
        F.sum("abundance").alias("total")
    )
    return placed.join(sums, "tax_id").withColumn("abundance", F.col("total")).drop("total")


def scale(placed: DataFrame, to: float) -> DataFrame:
    """Scale so that the abundances sum to ``to``; an all-zero profile is left alone."""
    total = F.broadcast(placed.agg(F.sum("abundance").alias("total")).withColumn("one", F.lit(1)))
    scaled = F.when(F.col("total") > 0, F.col("abundance") / F.col("total") * to).otherwise(F.col("abundance"))
    return placed.withColumn("one", F.lit(1)).join(total, "one").withColumn("abundance", scaled).drop("one", "total")


def normalize(placed: DataFrame) -> DataFrame:
    """Own abundances as percentages of their sum, added up along the tree again."""
    return add_up(scale(subtract_down(placed), 100.0))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Sum two profiles by taxon; where both have a taxon the first one describes it."""
    both = first.withColumn("side", F.lit(1)).unionByName(second.withColumn("side", F.lit(2)))
    rest = [c for c in first.columns if c not in ("tax_id", "abundance")]
    grouped = both.groupBy("tax_id").agg(
        F.min_by(F.struct(*rest), "side").alias("row"), F.sum("abundance").alias("abundance")
    )
    return grouped.select(*[F.col(c) if c in ("tax_id", "abundance") else F.col(f"row.{c}").alias(c) for c in first.columns])


def unifrac_input(first: DataFrame, second: DataFrame) -> DataFrame:
    """Tree and distributions of two placed profiles for a UniFrac computation.

    ``(node, tax_id, ancestor_node, branch_length, p, q)`` with nodes numbered from the deepest level
    up and the root last; within a level the order is that of a hash. The numbering ranks small
    buckets and adds the bucket offsets, so no task sorts a whole level.
    """
    nodes = (
        first.withColumn("side", F.lit(1))
        .unionByName(second.withColumn("side", F.lit(2)))
        .groupBy("tax_id")
        .agg(F.min_by(F.struct(F.size("tax_path").alias("depth"), "ancestor", "branch_length"), "side").alias("row"))
        .select("tax_id", "row.depth", "row.ancestor", "row.branch_length", F.md5("tax_id").alias("mark"))
        .withColumn("bucket", F.substring("mark", 1, 3))
    )
    sizes = nodes.groupBy("depth", "bucket").agg(F.count("*").alias("size"))
    # At most 4096 buckets per level of the tree.
    offset = F.sum("size").over(Window.orderBy(F.desc("depth"), "bucket")) - F.col("size")
    offsets = sizes.select("depth", "bucket", offset.alias("offset"))
    within = F.row_number().over(Window.partitionBy("depth", "bucket").orderBy("mark", "tax_id"))
    numbered = (
        nodes.withColumn("within", within)
        .join(offsets, ["depth", "bucket"])
        .select("tax_id", "ancestor", "branch_length", (F.col("offset") + F.col("within") - 1).alias("node"))
    )

    def share(placed: DataFrame, name: str) -> DataFrame:
        return scale(subtract_down(placed), 1.0).select("tax_id", F.col("abundance").alias(name))

    root = numbered.agg(F.count("*").alias("node")).select(
        F.lit(ROOT).alias("tax_id"),
        F.lit(None).cast("string").alias("ancestor"),
        F.lit(None).cast("int").alias("branch_length"),
        "node",
    )
    every = numbered.unionByName(root)
    ids = every.select(F.col("tax_id").alias("ancestor"), F.col("node").alias("ancestor_node"))
    return (
        every.join(ids, "ancestor", "left")
        .join(share(first, "p"), "tax_id", "left")
        .join(share(second, "q"), "tax_id", "left")
        .select(
            "node",
            "tax_id",
            "ancestor_node",
            "branch_length",
            F.coalesce("p", F.lit(0.0)).alias("p"),
            F.coalesce("q", F.lit(0.0)).alias("q"),
        )
    )
