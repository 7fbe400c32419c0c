"""Session construction, shared scratch storage and size-checked broadcasting."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A build side above this many rows is never broadcast.
BROADCAST_ROWS = 1_000_000


def get_spark(app: str = "sketchloom", master: str | None = None, **confs: str) -> SparkSession:
    """Build (or reuse) a session; on a cluster the submitter's settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Hash the smaller side of a shuffled join wherever all its partitions turn out to be small.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        # Register sketches of this many sets per task are held before the aggregation turns to sorting all shingles.
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **confs}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for materialised intermediates.

    The cluster names it in ``spark.checkpoint.dir``; a session that names none uses its warehouse
    folder, which all executors share as well. A folder of one machine is refused on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    folder = spark.conf.get("spark.sql.warehouse.dir")
    if folder.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share; the warehouse is a local folder")
    return os.path.join(folder, "scratch")


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts lineage so that a lost executor costs a re-read and not a re-computation, and gives later
    joins the real size of the data.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` wrote, once nothing lazy reads them any more; others are left alone.

    For loops that replace a table in every round: a lost executor re-reads the current ones only.
    """
    for table in tables:
        place = getattr(table, "stored_at", None)
        if place:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def deal_out(df: DataFrame) -> DataFrame:
    """Deal an input that is read by fewer tasks than the session has over all of them.

    A compressed file or a single row group is read by one task, whatever its size, which would
    then do all the work on it. An input with a task for every core is left where it is read.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def small_or_shuffled(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when it holds at most ``max_rows`` rows, else leave it alone.

    Without the mark the join shuffles both sides on its key and adaptive execution splits skewed
    partitions. The check reads at most ``max_rows + 1`` rows; give it a materialised table, not a
    long plan.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
