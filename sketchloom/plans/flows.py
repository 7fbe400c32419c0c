"""The end-to-end jobs behind the command line: train, index, sample, query, truth, profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.numbers import cap_k_range, clamp_location, expected_threshold
from sketchloom.functions.seq import HASHERS
from sketchloom.operators import maintenance, membership, multik, postprocess, superkmers, taxonomy, truth, wholesets
from sketchloom.operators.sketch import SketchSpec
from sketchloom.session import materialize
from sketchloom.sources import results as sink
from sketchloom.sources.profiles import read_taxonomy, write_profile
from sketchloom.sources.sequences import read_file_list, read_sequences
from sketchloom.sources.sketchdb import export_database, import_database


def _training(spark: SparkSession, file_list: str) -> DataFrame:
    return read_sequences(spark, read_file_list(spark, file_list))


def _spec_of(db: maintenance.Database) -> SketchSpec:
    first = maintenance.info(db.meta).first()
    hasher = HASHERS[first["hash"]]
    return SketchSpec(n=first["sketch_size"], ksize=first["ksize"], prime=first["prime"], hasher=hasher, both_strands=first["both_strands"])


def train(spark: SparkSession, file_list: str, out: str, spec: SketchSpec, grams: bool = False, ks: list[int] | None = None) -> None:
    """Sketch the listed files into a database.

    ``grams`` also writes the distinct training shingles (``<out>.grams``), for queries restricted to
    them. ``ks`` also writes the prefix index and lookup table for those lengths (``<out>.index``).
    """
    sequences = _training(spark, file_list)
    export_database(maintenance.build(sequences, spec), out)
    if grams:
        sink.write_grams(membership.sample_set(sequences, spec, strand_neutral=True), f"{out}.grams", spec.ksize)
    if ks:
        index_database(spark, out, ks)


def index_database(spark: SparkSession, database: str, ks: list[int]) -> None:
    """Write the prefix index and the lookup table of a database for the given lengths."""
    db = import_database(spark, database)
    spec = _spec_of(db)
    ks = cap_k_range(ks, spec.ksize)
    sink.write_index(multik.prefix_index(db.entries, ks), f"{database}.index/keys")
    lookup = multik.lookup_table(sink.read_index(spark, f"{database}.index/keys"), min(ks), spec.ksize)
    lookup.repartitionByRange("k", "query").write.partitionBy("k").parquet(f"{database}.index/lookup")


def sample(spark: SparkSession, query: str, out: str, ksize: int, restrict: str | None = None) -> None:
    """Write the distinct (strand-neutral) shingles of a sample, optionally only those in a training set."""
    spec = SketchSpec(ksize=ksize)
    grams = membership.sample_set(read_sequences(spark, query), spec, strand_neutral=True)
    if restrict:
        grams = membership.restrict_to_training(grams, sink.read_grams(spark, restrict, ksize))
    sink.write_grams(grams, out, ksize)


def query_one(
    spark: SparkSession,
    query: str,
    database: str,
    out: str,
    coverage: float = 0.02,
    confidence: float = 0.95,
    fp_rate: float = 1e-4,
    grams: str | None = None,
    restrict: bool = False,
    full_names: bool = False,
) -> None:
    """Containment and Jaccard of every sketch at the database's own length.

    ``grams`` is a sample already written by ``sample``. ``fp_rate`` only enters the threshold: the
    sample set is exact.
    """
    db = import_database(spark, database)
    spec = _spec_of(db)
    if grams:
        shingles = sink.read_grams(spark, grams, spec.ksize)
    else:
        shingles = membership.sample_set(read_sequences(spark, query), spec, strand_neutral=True)
        if restrict:
            shingles = membership.restrict_to_training(shingles, sink.read_grams(spark, f"{database}.grams", spec.ksize))
        shingles = materialize(shingles, "sample")
    hits = membership.sketch_hits(db.entries, shingles, spec, strand_neutral=True)
    table = membership.membership(db.meta, db.entries, hits, shingles.count(), strand_neutral=True)
    if full_names:
        table = table.join(db.meta.select("name", "path"), "name").withColumn("name", F.col("path")).drop("path")
    sink.write_results(membership.above(table, expected_threshold(spec.n, coverage, fp_rate, confidence)), out)


def query_many(
    spark: SparkSession,
    query: str,
    database: str,
    out: str,
    ks: list[int],
    coverage: float = 0.1,
    location: int = -1,
    sensitive: bool = False,
) -> None:
    """Containment at several lengths; unless ``sensitive``, repeated with shingles of one set only.

    A written index is used when it covers the lengths; otherwise the entries are filtered by the query.
    """
    db = import_database(spark, database)
    spec = _spec_of(db)
    ks = cap_k_range(ks, spec.ksize)
    at = clamp_location(location, ks)
    stored = load_index(spark, database, ks)
    sequences = read_sequences(spark, query)
    found = multik.matches(sequences, *stored, ks) if stored else multik.matches_once(sequences, db.entries, ks, spec.ksize)
    found = materialize(found, "matches")
    chosen = multik.select_results(multik.wide(multik.containment(found, db.entries, ks, db.meta), ks), ks, coverage, at)
    if not sensitive:
        names = materialize(chosen.select("name"), "chosen")
        entries = materialize(postprocess.selected_entries(db.entries, names), "selected")
        meta = db.meta.join(names, "name", "left_semi")
        specific = postprocess.specific_containment(multik.hits(found), entries, meta, ks)
        chosen = multik.select_results(multik.wide(specific, ks), ks, coverage, at)
    sink.write_results(chosen, out)


def load_index(spark: SparkSession, database: str, ks: list[int]) -> tuple[DataFrame, DataFrame] | None:
    """The written index cut to ``ks``, or nothing where none was written.

    An index that lacks a length or starts at another shortest one gives other matches: it is refused.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{database}.index/lookup")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    lookup = spark.read.schema("query string, target string, k int").parquet(f"{database}.index/lookup")
    held = sorted(row["k"] for row in lookup.select("k").distinct().collect())
    if not set(ks) <= set(held) or min(ks) != min(held):
        raise ValueError(f"the written index holds the lengths {held}; {sorted(ks)} need one that begins at {min(ks)} and has them all")
    index = sink.read_index(spark, f"{database}.index/keys")
    return index.where(F.col("k").isin(ks)), lookup.where(F.col("k").isin(ks))


def ground_truth(
    spark: SparkSession, query: str, database: str, out: str, ks: list[int], coverage: float = 0.1, location: int = -1
) -> None:
    """Exact canonical containment of the database's own files in the query, same table as ``query_many``."""
    meta = import_database(spark, database).meta
    paths = [row["path"] for row in meta.select("path").toLocalIterator()]
    at = clamp_location(location, ks)
    training, asked = read_sequences(spark, paths), read_sequences(spark, query)
    if max(ks) <= superkmers.LONGEST:
        exact = wholesets.containment(training, asked, ks)
    else:
        exact = truth.true_containment(truth.distinct_shingles(training, ks), truth.distinct_shingles(asked, ks))
    frame = multik.wide(exact, ks)
    sink.write_results(multik.select_results(frame, ks, coverage, at), out)


def profile(spark: SparkSession, results: str, taxonomy_file: str, out: str, least: float = 0.0, key: str | None = None, sample_id: str = "") -> None:
    """Turn a multi-length result table into a profile of all ancestors of the results."""
    frame = sink.read_results(spark, results)
    rows = taxonomy.profile_from_results(frame, read_taxonomy(spark, taxonomy_file), key or frame.columns[-1], least)
    write_profile(rows, out, sample_id)

