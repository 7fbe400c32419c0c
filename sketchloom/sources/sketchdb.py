"""Sketch databases in Parquet: ``<path>/meta`` and ``<path>/entries``, and what was added and deleted later.

``append_to`` and ``mark_deleted`` write a folder ``<path>/later/<number>-<unique>`` each and touch nothing that is
there: added sketches as ``meta`` and ``entries``, or the deleted ``names``. An operation counts once its row is in
``<path>/log``, which is written last, so a failed one leaves the database as it was. Rows carry the number of the
operation that added them; a deletion hides what older operations added, and a name may come back later. One writer
at a time. ``compact`` writes the present state as a new database.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.seq import basename
from sketchloom.operators import maintenance
from sketchloom.operators.maintenance import Database
from sketchloom.operators.sketch import SketchSpec

META = "name string, path string, ksize int, prime bigint, n int, true_num_kmers bigint, hash string, both_strands boolean"
ENTRIES = "name string, slot int, h bigint, cnt bigint, kmer string"
LOG = "number bigint, kind string, folder string"
ADDED, DELETED = "added", "deleted"


class Later(NamedTuple):
    """One operation on a written database."""

    number: int
    kind: str
    folder: str


def later(spark: SparkSession, path: str) -> list[Later]:
    """The operations since the database was written, oldest first: one short row each."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return []
    return [Later(**row.asDict()) for row in spark.read.schema(LOG).json(f"{path}/log").orderBy("number").collect()]


def _log(spark: SparkSession, path: str, done: Later) -> None:
    spark.createDataFrame([done], LOG).coalesce(1).write.mode("append").json(f"{path}/log")


def _next(spark: SparkSession, path: str, kind: str) -> Later:
    number = max((o.number for o in later(spark, path)), default=0) + 1
    return Later(number, kind, f"later/{number:06d}-{uuid.uuid4().hex}")


def _stored(spark: SparkSession, paths: list[str]) -> Database:
    """All parts of the databases in one scan each, without what was deleted after it was added.

    Numbers are compared inside one database: rows and deletions of several carry the place of theirs in ``paths``.
    """
    made = []
    for schema, part in ((META, "meta"), (ENTRIES, "entries")):
        columns, sides = [c.split()[0] for c in schema.split(", ")], []
        plain = []
        for path in paths:
            operations = later(spark, path)
            places = [f"{path}/{part}", *(f"{path}/{o.folder}/{part}" for o in operations if o.kind == ADDED)]
            gone = [f"{path}/{o.folder}/names" for o in operations if o.kind == DELETED]
            if not gone:
                plain += places
                continue
            rows = spark.read.schema(f"{schema}, added bigint").parquet(*places)
            # The names are a table of deletions, broadcast by its size when small.
            names = spark.read.schema("name string, deleted bigint").parquet(*gone).groupBy("name").agg(F.max("deleted").alias("deleted"))
            after = (rows["name"] == names["name"]) & (F.coalesce(rows["added"], F.lit(0)) < names["deleted"])
            sides.append(rows.join(names, after, "left_anti").select(*columns))
        if plain:
            sides.insert(0, spark.read.schema(schema).parquet(*plain))
        whole = sides[0]
        for side in sides[1:]:
            whole = whole.unionByName(side)
        made.append(whole)
    return Database(*made)


def export_database(db: Database, path: str) -> None:
    """Write a new database; a name may occur once. Fails if ``path`` exists."""
    if not db.made:  # names are grouped where a database is built
        maintenance.require_unique_names(db.meta)
    db.meta.write.parquet(f"{path}/meta")
    _clustered(db).write.option("compression", "zstd").parquet(f"{path}/entries")


def _clustered(db: Database) -> DataFrame:
    """Entries sorted by name, so that reading a few sketches skips most row groups.

    Stored sketches are dealt by ranges of names. Those just made lie together by name, and are not shuffled, nor made
    twice, for ranges.
    """
    return (db.entries if db.made else db.entries.repartitionByRange("name")).sortWithinPartitions("name", "slot")


def import_database(spark: SparkSession, path: str | list[str], names: list[str] | DataFrame | None = None) -> Database:
    """Read one database or several as one; ``names`` picks sketches and must all be present."""
    paths = [path] if isinstance(path, str) else list(path)
    db = _stored(spark, paths)
    if names is None:
        return db
    if isinstance(names, list):
        names = spark.createDataFrame([(name,) for name in names], "name string")
    return maintenance.pick(db, names)


def export_sketch(db: Database, name: str, path: str) -> None:
    """A single sketch as a database of its own."""
    export_database(Database(db.meta.where(F.col("name") == name), db.entries.where(F.col("name") == name)), path)


def export_each(db: Database, folder: str) -> None:
    """One sub-folder per sketch (``meta/name=...`` and ``entries/name=...``), clustered before writing."""
    if not db.meta.where("name is null or name = ''").isEmpty():
        raise ValueError("a sketch without a name cannot be written to a file of its own")
    maintenance.require_unique_names(db.meta)
    for part, rows in (("meta", db.meta), ("entries", db.entries)):
        rows.repartition("name").write.partitionBy("name").parquet(f"{folder}/{part}")


def import_each(spark: SparkSession, folder: str) -> Database:
    """Read back what ``export_each`` wrote."""
    return Database(
        spark.read.schema(META).parquet(f"{folder}/meta").select(*[c.split()[0] for c in META.split(", ")]),
        spark.read.schema(ENTRIES).parquet(f"{folder}/entries").select(*[c.split()[0] for c in ENTRIES.split(", ")]),
    )


def database_info(spark: SparkSession, path: str) -> DataFrame:
    """Parameters of a database, reading its metadata only."""
    return maintenance.info(import_database(spark, path).meta)


def delete_from(spark: SparkSession, path: str, names: list[str], out: str) -> None:
    """Write the database without the named sketches to ``out`` (never over what is being read)."""
    unwanted = spark.createDataFrame([(name,) for name in names], "name string")
    export_database(maintenance.delete(import_database(spark, path), unwanted), out)


def insert_into(spark: SparkSession, path: str, sequences: DataFrame, out: str, spec: SketchSpec = SketchSpec()) -> None:
    export_database(maintenance.insert(import_database(spark, path), sequences, spec), out)


def append_to(spark: SparkSession, path: str, sequences: DataFrame, spec: SketchSpec = SketchSpec()) -> None:
    """Add the sets whose names the database does not have, in place: only their own sketches are written."""
    added = maintenance.additions(import_database(spark, path), sequences, spec)
    own = _next(spark, path, ADDED)
    number = F.lit(own.number).cast("bigint").alias("added")
    added.meta.select("*", number).write.parquet(f"{path}/{own.folder}/meta")
    _clustered(added).select("*", number).write.option("compression", "zstd").parquet(f"{path}/{own.folder}/entries")
    _log(spark, path, own)


def mark_deleted(spark: SparkSession, path: str, names: DataFrame) -> None:
    """Delete sketches in place by writing down their names; names that are not there are ignored."""
    own = _next(spark, path, DELETED)
    unwanted = names.select(basename("name").alias("name")).distinct()
    unwanted.select("name", F.lit(own.number).cast("bigint").alias("deleted")).write.parquet(f"{path}/{own.folder}/names")
    _log(spark, path, own)


def compact(spark: SparkSession, path: str, out: str) -> None:
    """The present state as a new database without additions and deletions of its own."""
    export_database(import_database(spark, path), out)


def union_of(spark: SparkSession, first: str, second: str, out: str) -> None:
    export_database(maintenance.union(import_database(spark, first), import_database(spark, second)), out)
