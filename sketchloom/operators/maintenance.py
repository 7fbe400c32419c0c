"""Pure-DataFrame database maintenance on ``(meta, entries)`` pairs; storage is in ``sources.sketchdb``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.functions.seq import basename
from sketchloom.operators.similarity import require_same
from sketchloom.operators.sketch import SketchSpec, bottom_n, describe, kmv_cardinality
from sketchloom.session import BROADCAST_ROWS, materialize


class Database(NamedTuple):
    """``made`` is there while a database is only a plan on texts: the sketches of those sets that a join by name keeps."""

    meta: DataFrame
    entries: DataFrame
    made: Callable[[Callable[[DataFrame], DataFrame]], DataFrame] | None = None

    def kept(self, names: DataFrame, how: str) -> DataFrame:
        """The entries that ``how`` (a semi or anti join by name) keeps.

        Up to a checked number of names goes to the sketches. More of them would move every sketch, several times as large
        as its texts: sketches not made yet are then left out by their texts, which lie together by name.
        """
        if names.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            return self.entries.join(F.broadcast(names), "name", how)
        join = lambda rows: rows.join(names, "name", how)
        return self.made(join) if self.made else join(self.entries)


def build(sequences: DataFrame, spec: SketchSpec = SketchSpec(), exact: bool = False) -> Database:
    return Database(describe(sequences, spec, exact), bottom_n(sequences, spec), lambda kept: bottom_n(sequences, spec, kept=kept))


def build_once(sequences: DataFrame, spec: SketchSpec = SketchSpec()) -> Database:
    """The same database from one pass over the texts: the numbers of shingles are estimated from the written sketches."""
    entries = materialize(bottom_n(sequences, spec), "entries")
    return Database(describe(sequences, spec, counts=kmv_cardinality(entries, spec)), entries)


def require_unique_names(meta: DataFrame) -> None:
    twice = meta.groupBy("name").count().where("count > 1").select("name").limit(5).collect()
    if twice:
        raise ValueError(f"names must be unique, found twice: {', '.join(r['name'] for r in twice)}")


def require_present(meta: DataFrame, names: DataFrame) -> None:
    missing = names.join(meta, "name", "left_anti").limit(5).collect()
    if missing:
        raise KeyError(f"not in the database: {', '.join(r['name'] for r in missing)}")


def pick(db: Database, names: DataFrame, check: bool = True) -> Database:
    """The sketches named in ``names`` (paths are reduced to their last part); unknown names are an error."""
    wanted = names.select(basename("name").alias("name")).distinct()
    if check:
        require_present(db.meta, wanted)
    return Database(db.meta.join(wanted, "name", "left_semi"), db.kept(wanted, "left_semi"))


def info(meta: DataFrame) -> DataFrame:
    """One row: the number of sketches and the parameters of the first sketch by name."""
    return meta.agg(
        F.count("*").alias("sketches"),
        F.min("name").alias("first_name"),
        F.min_by("ksize", "name").alias("ksize"),
        F.min_by("prime", "name").alias("prime"),
        F.min_by("n", "name").alias("sketch_size"),
        F.min_by("hash", "name").alias("hash"),
        F.min_by("both_strands", "name").alias("both_strands"),
    )


def delete(db: Database, names: DataFrame) -> Database:
    """Drop the named sketches; names that are not there are ignored."""
    unwanted = names.select(basename("name").alias("name")).distinct()
    return Database(db.meta.join(unwanted, "name", "left_anti"), db.kept(unwanted, "left_anti"))


def additions(db: Database, sequences: DataFrame, spec: SketchSpec) -> Database:
    """The sketches of the sets that are not in the database yet.

    Size, shingle length and modulus come from the database's first sketch; its hash must be the one
    given. As in the original tool
    inserted text is taken as it is: neither upper-cased nor split at other letters; the number of
    distinct shingles is exact.
    """
    # A minimum and distinct names ask for no counts of shingles, so none are made for them.
    first = db.meta.where("name is not null").agg(F.min(F.struct("name", "ksize", "prime", "n", "hash", "both_strands")).alias("first")).select("first.*").first()
    if (first["hash"], first["both_strands"]) != (spec.hasher.__name__, spec.both_strands):
        raise ValueError(f"the database was made with {first['hash']} (both strands: {first['both_strands']}), not with {spec.hasher.__name__}")
    own = replace(spec, n=first["n"], ksize=first["ksize"], prime=first["prime"], alphabet=None, uppercase=False)
    fresh = sequences.join(db.meta.select("name").distinct(), "name", "left_anti")
    return build(fresh, own, exact=True)


def insert(db: Database, sequences: DataFrame, spec: SketchSpec) -> Database:
    """The database with the :func:`additions` of ``sequences``."""
    added = additions(db, sequences, spec)
    return Database(db.meta.unionByName(added.meta), db.entries.unionByName(added.entries))


def union(first: Database, second: Database) -> Database:
    """Both databases together, one sketch per path; where a path is in both, the first one's stays.

    The two must agree in shingle length, modulus, hash and strands.
    """
    both = first.meta.withColumn("side", F.lit(1)).unionByName(second.meta.withColumn("side", F.lit(2)))
    require_same(both, "ksize", "prime", "hash", "both_strands")
    order = Window.partitionBy("path").orderBy("side", "name")
    meta = both.withColumn("pick", F.row_number().over(order)).where("pick = 1").drop("pick", "side")
    # The sketches need the names alone, which take no counts of shingles; each side is kept where its texts lie.
    names = [db.meta.select("name", "path").distinct().withColumn("side", F.lit(side)) for side, db in enumerate((first, second), 1)]
    kept = names[0].unionByName(names[1]).withColumn("pick", F.row_number().over(order)).where("pick = 1")
    rows = [db.kept(kept.where(F.col("side") == side).select("name"), "left_semi") for side, db in enumerate((first, second), 1)]
    return Database(meta, rows[0].unionByName(rows[1]))
