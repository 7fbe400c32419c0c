"""Every operator as a named query over the test tables: ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.numbers import expected_threshold
from sketchloom.functions.seq import dna_projection, explode_shingles, reverse_complement
from sketchloom.operators import (
    blocks,
    cluster,
    linkage,
    lookup,
    maintenance,
    membership,
    multik,
    postprocess,
    profile,
    similarity,
    sketch,
    taxonomy,
    truth,
    wholesets,
)
from sketchloom.plans import tables as t
from sketchloom.session import materialize, scratch_dir
from sketchloom.sources import ranges
from sketchloom.sources.profiles import profile_lines, read_profile, read_taxonomy, read_truth, write_profile
from sketchloom.sources.results import (
    read_grams,
    read_index,
    read_matches,
    read_results,
    write_grams,
    write_index,
    write_matches,
    write_results,
)
from sketchloom.sources.sequences import (
    concatenated_reference,
    read_sequences,
    write_cluster_fastas,
    write_fasta,
    write_kmer_fasta,
)
from sketchloom.sources.hitmatrix import read_hit_matrix, write_hit_matrix
from sketchloom.sources.sketchdb import append_to, export_database, import_database, mark_deleted
from sketchloom.streaming import containment as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Containment a result must reach in the thresholded queries, the link strength of clusters, and that of near copies.
LEAST = 0.05
LINK = 0.05
NEAR = 0.5
# Bytes of a range where a scan is to cut records.
RANGE_BYTES = 65_536
THRESHOLDS = [round(at * 0.6 / 49, 9) for at in range(49, -1, -1)]


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def r9(column):
    return F.round(column, 9)


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


# -- shingles ----------------------------------------------------------------------------------


@register
def kmer_extract(spark, folder):
    grams = explode_shingles(t.documents(spark, folder), t.K, alphabet=None)
    return grams.groupBy("name").agg(
        F.count("*").alias("kmers"), F.min("kmer").alias("first_kmer"), F.max("kmer").alias("last_kmer")
    )


@register
def kmer_distinct_count(spark, folder):
    return sketch.cardinality(t.documents(spark, folder), t.TEXT, exact=True)


# Six standard errors of a sketch with 2^14 registers (0.83 / 2^7 each, rounded up), and one for tiny sets.
HLL_BOUND = 0.04


@register
def hll_cardinality(spark, folder):
    """The exact count next to whether the estimate lies within its error bound."""
    docs = t.documents(spark, folder)
    rough = sketch.cardinality(docs, t.TEXT).withColumnRenamed("true_num_kmers", "rough")
    both = sketch.cardinality(docs, t.TEXT, exact=True).join(rough, "name")
    within = F.abs(F.col("rough") - F.col("true_num_kmers")) <= HLL_BOUND * F.col("true_num_kmers") + 1
    return both.select("name", F.col("true_num_kmers").alias("exact"), within.alias("within"))


@register
def kmv_cardinality(spark, folder):
    """Shingles per set by the sketch's own minimum values, next to the exact count and whether five errors hold it."""
    docs = t.documents(spark, folder)
    rough = sketch.kmv_cardinality(sketch.bottom_n(docs, t.TEXT), t.TEXT)
    both = sketch.cardinality(docs, t.TEXT, exact=True).withColumnRenamed("true_num_kmers", "exact").join(rough, "name")
    within = F.abs(F.col("true_num_kmers") - F.col("exact")) <= 5 * F.col("error") * F.col("exact") + 1
    return both.select("name", "exact", F.col("true_num_kmers").alias("estimate"), within.alias("within"))


@register
def built_once(spark, folder):
    """The database from a single pass over the texts."""
    db = maintenance.build_once(t.documents(spark, folder), t.TEXT)
    masses = db.entries.groupBy("name").agg(F.count("*").alias("filled"), F.sum("cnt").alias("mass"))
    return db.meta.join(masses, "name", "left").select("name", F.col("true_num_kmers").alias("estimate"), "filled", "mass")


@register
def revcomp(spark, folder):
    return t.documents(spark, folder, dna=True).select("name", F.md5(reverse_complement("seq")).alias("digest"))


@register
def dna_image(spark, folder):
    return t.table(spark, folder, "pages").select("page_id", F.md5(dna_projection("html")).alias("digest"))


@register
def canonical_kmers(spark, folder):
    return wholesets.canonical_summary(t.documents(spark, folder, dna=True), t.K)


@register
def acgt_split_kmers(spark, folder):
    grams = explode_shingles(t.documents(spark, folder, dna=True), t.K)
    return grams.groupBy("name").agg(
        F.count("*").alias("kmers"), F.min("kmer").alias("first_kmer"), F.max("kmer").alias("last_kmer")
    )


# -- sketches ----------------------------------------------------------------------------------


def _rows(entries: DataFrame) -> DataFrame:
    return entries.select("name", big("slot"), "h", "cnt", "kmer")


@register
def bottom_n_sketch(spark, folder):
    return _rows(sketch.bottom_n(t.documents(spark, folder), t.TEXT))


@register
def down_sample(spark, folder):
    return _rows(sketch.down_sample(sketch.bottom_n(t.documents(spark, folder), t.TEXT), 50))


@register
def hash_list_sketch(spark, folder):
    wanted = materialize(sketch.bottom_n(t.benchmark(spark, folder), t.TEXT_FOCAL), "hash-list")
    return _rows(sketch.bottom_n(t.documents(spark, folder), t.TEXT, hash_list=wanted))


@register
def minhash_strand_sketch(spark, folder):
    return _rows(sketch.bottom_n(t.documents(spark, folder, dna=True), t.DNA_STRANDS))


@register
def merged_sketch(spark, folder):
    """Sketches per source, merged from the sketches of its documents."""
    parts = sketch.bottom_n(t.documents(spark, folder), t.TEXT)
    sources = t.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("name"), "source")
    named = parts.join(sources, "name").select(F.col("source").alias("name"), "h", "cnt", "kmer")
    return _rows(sketch.merge_sketches(named, t.N))


# -- database ----------------------------------------------------------------------------------


def _database(spark, folder, exact: bool = True) -> maintenance.Database:
    return maintenance.build(t.documents(spark, folder), t.TEXT, exact)


def _summary(db: maintenance.Database) -> DataFrame:
    filled = db.entries.groupBy("name").agg(
        F.count("*").alias("filled"), F.sum("cnt").alias("mass"), F.min("h").alias("least"), F.max("h").alias("greatest")
    )
    return db.meta.join(filled, "name", "left").select(
        "name", "path", big("ksize"), "prime", big("n"), "true_num_kmers", "filled", "mass", "least", "greatest"
    )


@register
def sketch_info(spark, folder):
    info = maintenance.info(sketch.describe(t.documents(spark, folder), t.TEXT, exact=True))
    return info.select("sketches", "first_name", big("ksize"), "prime", big("sketch_size"))


@register
def db_build(spark, folder):
    return _summary(_database(spark, folder))


@register
def db_import_subset(spark, folder):
    names = t.table(spark, folder, "labels").select(F.concat(F.lit("some/where/"), F.col("doc_id").cast("string")).alias("name"))
    return _summary(maintenance.pick(_database(spark, folder), names, check=False))


@register
def db_insert(spark, folder):
    db = _database(spark, folder)
    new = t.conversations(spark, folder).unionByName(t.documents(spark, folder))
    return _summary(maintenance.insert(db, new, t.TEXT))


@register
def db_delete(spark, folder):
    toxic = t.table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("name"))
    return _summary(maintenance.delete(_database(spark, folder), toxic))


@register
def db_union(spark, folder):
    first = _database(spark, folder)
    second = maintenance.build(t.pages(spark, folder).unionByName(t.documents(spark, folder)), t.TEXT, exact=True)
    return _summary(maintenance.union(first, second))


# -- similarity to one sketch ------------------------------------------------------------------


def _focal(spark, folder) -> tuple[DataFrame, DataFrame]:
    focal = sketch.bottom_n(t.benchmark(spark, folder), t.TEXT_FOCAL)
    return focal, sketch.bottom_sets(t.documents(spark, folder), t.TEXT_FOCAL)


def _names(spark, folder) -> DataFrame:
    return t.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("name"))


@register
def common(spark, folder):
    return similarity.common(*_focal(spark, folder), t.N_FOCAL, _names(spark, folder))


@register
def common_count(spark, folder):
    return similarity.common_count(*_focal(spark, folder), t.N_FOCAL, _names(spark, folder))


@register
def jaccard(spark, folder):
    """Each document against the benchmark: the walk starts at the document."""
    table = similarity.capped_overlap(*_focal(spark, folder), t.N_FOCAL, focal_first=False, names=_names(spark, folder))
    return table.select("name", r9(similarity.share(F.col("common"), F.col("other_size"))).alias("jaccard"))


@register
def jaccard_vector(spark, folder):
    return similarity.jaccard_vector(*_focal(spark, folder), t.N_FOCAL, _names(spark, folder)).select("name", r9("jaccard").alias("jaccard"))


@register
def jaccard_dist(spark, folder):
    return similarity.jaccard_distance(*_focal(spark, folder), t.N_FOCAL, _names(spark, folder)).select("name", r9("distance").alias("distance"))


@register
def jaccard_count(spark, folder):
    table = similarity.jaccard_count(*_focal(spark, folder), t.N_FOCAL, _names(spark, folder))
    return table.select("name", r9("share_of_other").alias("share_of_other"), r9("share_of_focal").alias("share_of_focal"))


@register
def count_vector(spark, folder):
    return similarity.count_vector(*_focal(spark, folder), t.N_FOCAL, _names(spark, folder)).select("name", r9("share").alias("share"))


@register
def mash_jaccard(spark, folder):
    return similarity.mash_jaccard(*_focal(spark, folder), t.N_FOCAL, _names(spark, folder)).select("name", r9("jaccard").alias("jaccard"))


@register
def capped_overlap(spark, folder):
    table = similarity.capped_overlap(*_focal(spark, folder), t.N_FOCAL, names=_names(spark, folder))
    return table.select("name", "common", "focal_shared", "other_shared", "focal_size", "other_size", "focal_total", "other_total")


@register
def sketch_containment(spark, folder):
    return similarity.sketch_containment(*_focal(spark, folder), _names(spark, folder)).select("name", r9("containment").alias("containment"))


# -- all against all ---------------------------------------------------------------------------


def _sketches(spark, folder) -> DataFrame:
    return materialize(sketch.bottom_sets(t.documents(spark, folder), t.TEXT), "sketches")


@register
def sketch_copies(spark, folder):
    return blocks.distinct_sketches(sketch.bottom_sets(t.documents(spark, folder), t.TEXT))


@register
def jaccard_matrix(spark, folder):
    table = similarity.jaccard_matrix(_sketches(spark, folder), t.N)
    return table.select("name_i", "name_j", r9("jaccard_ij").alias("jaccard_ij"), r9("jaccard_ji").alias("jaccard_ji"))


@register
def jaccard_count_matrix(spark, folder):
    table = similarity.jaccard_count_matrix(_sketches(spark, folder), t.N)
    return table.select("name_i", "name_j", r9("cell_ij").alias("cell_ij"), r9("cell_ji").alias("cell_ji"))


def _clusters(spark, folder) -> DataFrame:
    return cluster.cluster_sketches(_sketches(spark, folder), t.N, LINK, names=_names(spark, folder))


@register
def similar_pairs(spark, folder):
    """The cells of the Jaccard matrix that reach the link strength in a direction, by the prefix-filtered join."""
    table = similarity.jaccard_matrix(_sketches(spark, folder), t.N, LINK)
    return table.select("name_i", "name_j", r9("jaccard_ij").alias("jaccard_ij"), r9("jaccard_ji").alias("jaccard_ji"))


@register
def similar_count_pairs(spark, folder):
    table = similarity.jaccard_count_matrix(_sketches(spark, folder), t.N, NEAR)
    return table.select("name_i", "name_j", r9("cell_ij").alias("cell_ij"), r9("cell_ji").alias("cell_ji"))


@register
def joined_clusters(spark, folder):
    return cluster.cluster_sketches(_sketches(spark, folder), t.N, NEAR, names=_names(spark, folder), joined=True)


@register
def linkage_cut(spark, folder):
    """Single linkage from the weaker links, cut where only the stronger ones hold."""
    merges, groups = linkage.sketch_linkage(_sketches(spark, folder), t.N, LINK, "single")
    heads = groups.where("name = representative").select("name")
    found = linkage.cut(heads, merges, 1 - NEAR).select(F.col("name").alias("representative"), "cluster")
    placed = groups.join(found, "representative").select("name", "cluster")
    alone = _names(spark, folder).select("name").join(groups, "name", "left_anti")
    return placed.unionByName(alone.select("name", F.col("name").alias("cluster")))


@register
def cluster_components(spark, folder):
    return _clusters(spark, folder)


@register
def cluster_lca(spark, folder):
    return cluster.common_ancestors(_clusters(spark, folder), t.lineage(spark, folder))


@register
def cluster_fasta_records(spark, folder):
    clusters = materialize(_clusters(spark, folder), "clusters")
    ancestors = cluster.common_ancestors(clusters, t.lineage(spark, folder))
    rows = cluster.cluster_records(t.documents(spark, folder), clusters, ancestors)
    return rows.select("cluster", "lca", "name", F.md5("seq").alias("digest"))


@register
def kmer_lookup(spark, folder):
    index = lookup.inverted_index(sketch.bottom_n(t.documents(spark, folder), t.TEXT))
    return lookup.find_all(index, explode_shingles(t.benchmark(spark, folder), t.K, alphabet=None))


@register
def kmer_fasta_dump(spark, folder):
    return sketch.bottom_n(t.documents(spark, folder), t.TEXT).select("kmer").distinct()


# -- one shingle length against a sample -------------------------------------------------------


def _membership(spark, folder, training: bool = False) -> DataFrame:
    docs = t.documents(spark, folder)
    db = maintenance.build(docs, t.TEXT, exact=True)
    return membership.query_membership(
        db.meta, db.entries, t.benchmark(spark, folder), t.TEXT, training=docs if training else None
    )


def _membership_columns(frame: DataFrame) -> DataFrame:
    return frame.select(
        "name",
        "intersection",
        r9(F.col("`containment index`")).alias("containment_index"),
        r9(F.col("`jaccard index`")).alias("jaccard_index"),
    )


@register
def membership_containment(spark, folder):
    return _membership_columns(_membership(spark, folder))


@register
def membership_intersect_only(spark, folder):
    return _membership_columns(_membership(spark, folder, training=True))


@register
def membership_strand_neutral(spark, folder):
    docs = t.documents(spark, folder, dna=True)
    db = maintenance.build(docs, t.DNA_SPEC, exact=True)
    sample = t.benchmark(spark, folder, dna=True)
    return _membership_columns(
        membership.query_membership(db.meta, db.entries, sample, t.DNA_SPEC, strand_neutral=True)
    )


@register
def threshold_calc(spark, folder):
    least = expected_threshold(t.N, 0.2, 0.0001, 0.95)
    return _membership_columns(membership.above(_membership(spark, folder), least))


# -- several shingle lengths -------------------------------------------------------------------


def _multi(spark, folder) -> tuple[DataFrame, DataFrame]:
    entries = materialize(_dna_entries(spark, folder), "sketches")
    found = multik.matches_once(t.benchmark(spark, folder, dna=True), entries, t.KS, t.K)
    return entries, materialize(found, "matches")


def _dna_entries(spark, folder) -> DataFrame:
    return sketch.bottom_n(t.documents(spark, folder, dna=True), t.DNA_SPEC)


@register
def prefix_index(spark, folder):
    # Dealt by set while they are sketch entries: the index, eight rows for each, is then summed up where it is made.
    entries = _dna_entries(spark, folder).repartition("name")
    return _index_summary(multik.prefix_index(entries, t.KS))


def _index_summary(index: DataFrame) -> DataFrame:
    return index.groupBy(big("k"), "name").agg(
        F.count("*").alias("entries"),
        F.countDistinct("key").alias("keys"),
        F.min("key").alias("first_key"),
        F.max("key").alias("last_key"),
        F.count_if("is_rc").alias("flipped"),
    )


@register
def prefilter(spark, folder):
    keys = multik.prefilter(multik.prefix_index(_dna_entries(spark, folder), t.KS))
    return keys.groupBy(big("k"), F.substring("prefix", 1, 4).alias("start")).agg(
        F.count("*").alias("keys"), F.min("prefix").alias("first_key"), F.max("prefix").alias("last_key")
    )


@register
def multi_k_matches(spark, folder):
    return _multi(spark, folder)[1].select("name", big("k"), big("slot"), "prefix")


@register
def multi_k_indexed(spark, folder):
    """The same matches through the stored index and lookup table."""
    index, table = multik.prepare(_dna_entries(spark, folder), t.KS, t.K)
    found = multik.matches(t.benchmark(spark, folder, dna=True), index, table, t.KS)
    return found.select("name", big("k"), big("slot"), "prefix")


@register
def multi_k_hits(spark, folder):
    return multik.hits(_multi(spark, folder)[1]).select("name", big("k"), "prefix")


def _containment(spark, folder) -> DataFrame:
    entries, found = _multi(spark, folder)
    return multik.containment(found, entries, t.KS, _names(spark, folder))


@register
def multi_k_containment(spark, folder):
    return _containment(spark, folder).select("name", big("k"), "hits", "denom", r9("ci").alias("ci"))


def _wide(frame: DataFrame) -> DataFrame:
    return frame.select("name", *[r9(F.col(f"`k={k}`")).alias(f"k_{k}") for k in t.KS])


@register
def containment_wide(spark, folder):
    return _wide(multik.wide(_containment(spark, folder), t.KS))


@register
def containment_threshold_at_k(spark, folder):
    frame = multik.wide(_containment(spark, folder), t.KS)
    return _wide(multik.select_results(frame, t.KS, LEAST, location=1))


def _specific(spark, folder):
    entries, found = _multi(spark, folder)
    chosen = multik.select_results(multik.wide(multik.containment(found, entries, t.KS), t.KS), t.KS, LEAST)
    chosen = materialize(chosen.select("name"), "chosen")
    return materialize(postprocess.selected_entries(entries, chosen), "selected"), found


@register
def unique_kmers(spark, folder):
    selected, _ = _specific(spark, folder)
    return postprocess.unique_prefixes(postprocess.multiplicities(selected, t.KS)).select("name", big("k"), "prefix")


@register
def num_unique_kmers(spark, folder):
    selected, _ = _specific(spark, folder)
    return postprocess.unique_tally(selected, t.KS).select("name", big("k"), "num_unique")


@register
def postprocess_containment(spark, folder):
    selected, found = _specific(spark, folder)
    meta = selected.select("name").distinct().withColumn("n", F.lit(t.N))
    result = postprocess.specific_containment(multik.hits(found), selected, meta, t.KS)
    return result.select("name", big("k"), "hits", big("denom"), r9("ci").alias("ci"))


@register
def stream_containment(spark, folder):
    """The same containment, the sample arriving as a stream."""
    entries = materialize(_dna_entries(spark, folder), "sketches")
    index, table = multik.prepare(entries, t.KS, t.K)
    schema = t.table(spark, folder, "benchmark").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "benchmark.parquet").parquet(folder)
    sequences = arriving.select(F.lit("benchmark").alias("name"), dna_projection("text").alias("seq"))
    place = os.path.join(scratch_dir(spark), f"stream-{uuid.uuid4().hex}")
    streaming.start(sequences, index, table, t.KS, f"{place}/hits", f"{place}/state").awaitTermination()
    result = streaming.current(f"{place}/hits", entries, t.KS, _names(spark, folder))
    return result.select("name", big("k"), "hits", "denom", r9("ci").alias("ci"))


# -- exact truth -------------------------------------------------------------------------------


def _truth(spark, folder) -> DataFrame:
    return wholesets.containment(t.documents(spark, folder, dna=True), t.benchmark(spark, folder, dna=True), t.KS)


@register
def shingle_statistics(spark, folder):
    """Occurrences of strand-neutral shingles per set and length, distinct ones, and those that occur once."""
    table = wholesets.statistics(t.documents(spark, folder, dna=True), t.KS)
    return table.select("name", big("k"), "total", "distinct", "single")


@register
def ground_truth(spark, folder):
    return _truth(spark, folder).select("name", big("k"), "hits", "denom", r9("ci").alias("ci"))


@register
def ground_truth_intersection(spark, folder):
    shared = wholesets.intersection(t.documents(spark, folder, dna=True), t.benchmark(spark, folder, dna=True), t.KS)
    return shared.groupBy(big("k")).agg(
        F.count("*").alias("kmers"), F.min("kmer").alias("first_kmer"), F.max("kmer").alias("last_kmer")
    )


@register
def truth_error_stats(spark, folder):
    exact = materialize(_truth(spark, folder), "truth")
    stats = truth.error_statistics(_containment(spark, folder), exact)
    return stats.select(
        big("k"), "pairs", F.round("total", 6).alias("total"), r9("mean").alias("mean"), r9("median").alias("median")
    )


# -- profiles and taxonomies -------------------------------------------------------------------


def _profile_rows(placed: DataFrame) -> DataFrame:
    return placed.select(
        "tax_id",
        "rank",
        F.array_join("tax_path", "|").alias("tax_path"),
        F.array_join("tax_path_sn", "|").alias("tax_path_sn"),
        "ancestor",
        big("branch_length"),
        r9("abundance").alias("abundance"),
    )


@register
def profile_parse(spark, folder):
    return _profile_rows(t.trade_profile(spark, folder, "customer"))


@register
def profile_threshold(spark, folder):
    return _profile_rows(profile.threshold(t.trade_profile(spark, folder, "customer"), 50.0))


@register
def profile_subtract_down(spark, folder):
    return _profile_rows(profile.subtract_down(t.trade_profile(spark, folder, "customer")))


@register
def profile_add_up(spark, folder):
    return _profile_rows(profile.add_up(t.trade_profile(spark, folder, "customer")))


@register
def profile_normalize(spark, folder):
    return _profile_rows(profile.normalize(t.trade_profile(spark, folder, "customer")))


@register
def profile_merge(spark, folder):
    both = [t.trade_profile(spark, folder, who) for who in ("customer", "supplier")]
    return _profile_rows(profile.merge(*both))


@register
def profile_write_lines(spark, folder):
    lines = profile_lines(profile.normalize(t.trade_profile(spark, folder, "supplier")))
    return lines.select(big("depth"), "tax_id", "line").orderBy("depth", "tax_id")


@register
def unifrac_input(spark, folder):
    both = [t.trade_profile(spark, folder, who) for who in ("customer", "supplier")]
    table = profile.unifrac_input(*both)
    return table.select(
        "node", "tax_id", "ancestor_node", big("branch_length"), r9("p").alias("p"), r9("q").alias("q")
    )


@register
def profile_from_result(spark, folder):
    results = multik.wide(_containment(spark, folder), t.KS)
    rows = taxonomy.profile_from_results(results, t.lineage(spark, folder), f"k={t.K}", LEAST, strict=False)
    return rows.select(
        "tax_id", "rank", F.array_join("tax_path", "|").alias("tax_path"), F.array_join("tax_path_sn", "|").alias("tax_path_sn"), "abundance"
    )


@register
def tp_fp_fn(spark, folder):
    """Taxa of documents found in the benchmark, against the taxa of documents of good quality."""
    lineage = t.lineage(spark, folder)
    results = _containment(spark, folder).where(F.col("k") == t.K).select("name", F.col("ci").alias("score"))
    taxa = taxonomy.ancestor_rows(lineage).select("name", F.col("letter").alias("rank"), "tax_id")
    good = t.table(spark, folder, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("name"))
    predicted = taxa.join(results, "name").select("rank", "tax_id", "score")
    real = taxa.join(good, "name", "left_semi").select("rank", "tax_id")
    return taxonomy.score_thresholds(predicted, real, THRESHOLDS)


@register
def taxonomy_repath(spark, folder):
    """Customers' lineages (region, nation, segment) rewritten with ids and rank letters."""
    nation = F.broadcast(t.table(spark, folder, "nation"))
    region = F.broadcast(t.table(spark, folder, "region"))
    rows = (
        t.table(spark, folder, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    names = F.concat_ws("|", "r_name", "n_name", F.concat(F.lit("THE "), "c_mktsegment"), F.lit(""))
    ids = F.concat_ws("|", "r_regionkey", "n_nationkey", F.length("c_mktsegment"), F.lit(""))
    return taxonomy.repath(rows.select(F.col("c_name").alias("name"), names.alias("names"), ids.alias("ids")))


@register
def results_with_taxonomy(spark, folder):
    results = multik.wide(_containment(spark, folder), t.KS)
    joined = taxonomy.with_taxonomy(results, t.lineage(spark, folder))
    return joined.select("name", "organism", "tax_id", "path", r9(F.col(f"`k={t.K}`")).alias("ci"))


@register
def concat_reference(spark, folder):
    turns = t.table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("name"), F.col("turn").alias("at"), F.col("text").alias("seq")
    )
    return concatenated_reference(turns).select("name", big("at"), big("part"), "text")


# -- files written to the shared folder and read back ------------------------------------------


def _place(spark, tag: str) -> str:
    return os.path.join(scratch_dir(spark), f"{tag}-{uuid.uuid4().hex}")


# Line ends and the letters that begin a record are taken out of the texts that become sequences.
MARKS = "\n\r>@+"


def _as_sequences(spark, folder) -> DataFrame:
    docs = t.table(spark, folder, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("record"), F.translate("text", MARKS, "").alias("seq"))


def _digests(records: DataFrame) -> DataFrame:
    return records.select("record", F.length("seq").cast("bigint").alias("letters"), F.md5("seq").alias("digest"))


@register
def fasta_scan(spark, folder):
    place = _place(spark, "fasta")
    write_fasta(_as_sequences(spark, folder), place)
    return _digests(read_sequences(spark, place))


@register
def fasta_range_scan(spark, folder):
    """Few files, read in ranges that are shorter than many records; pieces are put together again."""
    place = _place(spark, "fasta-ranges")
    write_fasta(_as_sequences(spark, folder).coalesce(2), place)
    pieces = ranges.read_ranges(spark, place, overlap=t.K - 1, step=RANGE_BYTES, piece=1000)
    return _digests(ranges.whole_records(pieces))


@register
def gz_scan(spark, folder):
    """Compressed files, which do not split."""
    place = _place(spark, "fasta-gz")
    lines = _as_sequences(spark, folder).select(F.concat(F.lit(">"), "record", F.lit("\n"), "seq").alias("value"))
    lines.write.option("compression", "gzip").text(place)
    return _digests(read_sequences(spark, place))


@register
def fastq_scan(spark, folder):
    """Four-line records; nothing in the files' names says what they are."""
    place = _place(spark, "reads")
    quality = F.regexp_replace("seq", "(?s).", "I")
    rows = _as_sequences(spark, folder).select(F.concat(F.lit("@"), "record", F.lit("\n"), "seq", F.lit("\n+\n"), quality).alias("value"))
    rows.write.text(place)
    return _digests(read_sequences(spark, place))


@register
def db_round_trip(spark, folder):
    """A database written, and the sketches of the labelled documents read back by name."""
    place = _place(spark, "db")
    export_database(_database(spark, folder), place)
    names = t.table(spark, folder, "labels").select(F.concat(F.lit("some/where/"), F.col("doc_id").cast("string")).alias("name"))
    return _summary(import_database(spark, place, names))


@register
def index_round_trip(spark, folder):
    place = _place(spark, "index")
    write_index(multik.prefix_index(_dna_entries(spark, folder), t.KS), place)
    # Dealt by set once; without it the distinct keys are dealt by key and then by set.
    return _index_summary(read_index(spark, place).select("k", "key", "name", "is_rc").repartition("name"))


@register
def match_tsv_round_trip(spark, folder):
    place = _place(spark, "matches")
    write_matches(_multi(spark, folder)[1], place)
    return read_matches(spark, place).select("name", big("k"), big("slot"), "prefix")


@register
def hit_matrix_round_trip(spark, folder):
    place = _place(spark, "hit-matrix")
    write_hit_matrix(_multi(spark, folder)[1], _names(spark, folder), t.KS, place)
    return read_hit_matrix(spark, place).select("name", big("k"), big("slot"))


@register
def db_append_and_mark(spark, folder):
    """A written database with sets added in place, then others deleted in place."""
    place = _place(spark, "database")
    export_database(_database(spark, folder), place)
    append_to(spark, place, t.conversations(spark, folder).unionByName(t.documents(spark, folder)), t.TEXT)
    toxic = t.table(spark, folder, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("name"))
    mark_deleted(spark, place, toxic)
    return _summary(import_database(spark, place))


@register
def result_csv_round_trip(spark, folder):
    place = _place(spark, "results")
    write_results(multik.wide(_containment(spark, folder), t.KS), place)
    return _wide(read_results(spark, place))


@register
def sample_set_round_trip(spark, folder):
    place = _place(spark, "sample")
    write_grams(membership.sample_set(t.benchmark(spark, folder, dna=True), t.DNA_SPEC, strand_neutral=True), place, t.K)
    return read_grams(spark, place, t.K)


@register
def kmer_fasta_round_trip(spark, folder):
    """The distinct shingles of all sketches as FASTA records, read back."""
    place = _place(spark, "kmers")
    kmers = sketch.bottom_n(t.documents(spark, folder, dna=True), t.DNA_SPEC).select("kmer").distinct()
    write_kmer_fasta(kmers, place)
    return read_sequences(spark, place).select(F.col("seq").alias("kmer"))


@register
def cluster_fasta_round_trip(spark, folder):
    """The records of every cluster's file: which number they have, and the digest of the sequence."""
    place = _place(spark, "clusters")
    clusters = materialize(_clusters(spark, folder), "clusters")
    ancestors = cluster.common_ancestors(clusters, t.lineage(spark, folder))
    docs = _as_sequences(spark, folder).select(F.col("record").alias("name"), "seq")
    write_cluster_fastas(cluster.cluster_records(docs, clusters, ancestors), place)
    rows = read_sequences(spark, f"{place}/*")
    label, number = F.regexp_extract("record", r"^(.*)_(\d+)$", 1), F.regexp_extract("record", r"_(\d+)$", 1).cast("bigint")
    folder_name = F.element_at(F.split("path", "/"), -2)
    return rows.groupBy(label.alias("lca"), F.md5(F.url_decode(folder_name)).alias("file")).agg(
        F.count("*").alias("records"), F.max(number).alias("last"), F.countDistinct(number).alias("numbers"), F.min(F.md5("seq")).alias("least")
    ).drop("file")


@register
def profile_text_parse(spark, folder):
    place = _place(spark, "profile")
    write_profile(profile.normalize(t.trade_profile(spark, folder, "supplier")), place)
    return _profile_rows(read_profile(spark, place))


@register
def taxonomy_text_parse(spark, folder):
    place = _place(spark, "taxonomy")
    t.lineage(spark, folder).select(F.concat_ws(" ", "name", "organism", "tax_id", "path").alias("value")).write.text(place)
    return read_taxonomy(spark, place)


@register
def truth_text_parse(spark, folder):
    """Languages and sources of good documents as a truth profile's lines."""
    place = _place(spark, "truth")
    good = t.table(spark, folder, "labels").where("quality = 1").select("doc_id")
    rows = t.table(spark, folder, "documents").join(good, "doc_id", "left_semi")
    line = F.explode(F.array(F.concat(F.col("lang"), F.lit("\tsuperkingdom")), F.concat(F.col("source"), F.lit("\tgenus"))))
    rows.select(line.alias("value")).write.text(place)
    return read_truth(spark, place)
