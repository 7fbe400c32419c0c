"""Hit matrices in compressed sparse column form: a sketch is a column, its matched slots are the row indices.

A row of the table is a block of columns of one length ``k``: ``names`` in order, ``pointers`` (one more than
columns) into ``rows``, as scipy's ``csc_matrix((ones, rows, pointers))`` takes them. Every sketch is a column,
also without hits. A name's block follows from its hash, so :func:`read_columns` reads the blocks of its names
only. A block holds about ``COLUMNS`` columns of at most a sketch's size each, whatever the number of sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = 256
SCHEMA = "k int, names array<string>, pointers array<int>, rows array<int>"


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("block")


def write_hit_matrix(matches: DataFrame, names: DataFrame, ks: list[int], path: str, columns: int = COLUMNS) -> None:
    """Blocks of the distinct ``matches(name, k, slot)``; ``names(name)`` are all the sketches. Fails if ``path`` exists."""
    blocks = max(1, -(-names.count() // columns))
    hits = matches.groupBy("name", F.col("k").cast("int").alias("k")).agg(F.array_sort(F.collect_set("slot")).alias("slots"))
    every = names.select("name", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    one = every.join(hits, ["name", "k"], "left").select("name", "k", F.coalesce("slots", F.array().cast("array<int>")).alias("slots"), _block(blocks))
    held = one.groupBy("k", "block").agg(F.array_sort(F.collect_list(F.struct("name", "slots"))).alias("held"))
    grown = F.aggregate("held.slots", F.array(F.lit(0)), lambda sums, slots: F.concat(sums, F.array(F.element_at(sums, -1) + F.size(slots))))
    csc = held.select("k", F.col("held.name").alias("names"), grown.alias("pointers"), F.flatten("held.slots").alias("rows"), "block")
    csc.repartition("block").write.partitionBy("block").parquet(f"{path}/blocks")
    names.sparkSession.createDataFrame([(blocks,)], "blocks int").coalesce(1).write.json(f"{path}/layout")


def _opened(blocks: DataFrame) -> DataFrame:
    """The hits ``(name, k, slot)`` of blocks."""
    column = blocks.select("k", "pointers", "rows", F.posexplode("names").alias("at", "name"))
    low, high = F.col("pointers")[F.col("at")], F.col("pointers")[F.col("at") + 1]
    return column.select("name", "k", F.explode(F.slice("rows", low + 1, high - low)).alias("slot"))


def read_hit_matrix(spark: SparkSession, path: str) -> DataFrame:
    """All hits ``(name, k, slot)``."""
    return _opened(spark.read.schema(f"{SCHEMA}, block int").parquet(f"{path}/blocks"))


def read_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The hits of some sketches, from their blocks alone; names without a column have none."""
    blocks = spark.read.schema("blocks int").json(f"{path}/layout").first()["blocks"]
    wanted = spark.createDataFrame([(n,) for n in names], "name string").select(_block(blocks)).distinct()
    places = sorted(r["block"] for r in wanted.collect())
    table = spark.read.schema(f"{SCHEMA}, block int").parquet(f"{path}/blocks")
    return _opened(table.where(F.col("block").isin(places))).where(F.col("name").isin(names))
