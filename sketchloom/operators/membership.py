"""Containment of sketched sets in one large sample, at the sketch's own shingle length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.functions.seq import canonical, explode_shingles
from sketchloom.operators.sketch import SketchSpec
from sketchloom.session import BROADCAST_ROWS, materialize


def sample_grams(sequences: DataFrame, spec: SketchSpec, strand_neutral: bool = False) -> DataFrame:
    """One row ``kmer`` per shingle occurrence; strand-neutral shingles are put in canonical form."""
    grams = explode_shingles(sequences, spec.ksize, spec.alphabet, spec.uppercase, spec.piece).select("kmer")
    return grams.select(canonical(F.col("kmer")).alias("kmer")) if strand_neutral else grams


def sample_set(sequences: DataFrame, spec: SketchSpec, strand_neutral: bool = False) -> DataFrame:
    """The distinct shingles of a sample (the exact counterpart of a Bloom filter over it)."""
    return sample_grams(sequences, spec, strand_neutral).distinct()


def restrict_to_training(sample: DataFrame, training: DataFrame) -> DataFrame:
    """Keep the shingles of a sample (distinct) that occur anywhere in the training sets (occurrences or distinct ones).

    A sample of up to ``BROADCAST_ROWS`` shingles filters the training sets where they are scanned; their own shingles are not shuffled.
    """
    return distinct_hits(training, materialize(sample, "asked"), ["kmer"])


def distinct_hits(occurrences: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The distinct keys of ``wanted`` that occur in ``occurrences``, with all columns of ``wanted``.

    ``wanted`` (a written table, so that its rows are counted from the file footers) must be unique on the key. Up to the broadcast bound it filters the occurrences where
    they are scanned. Beyond it, the occurrences are first made distinct (with map-side combining, so
    a frequent key sends one row per task), and the join reuses that partitioning.
    """
    if wanted.count() <= BROADCAST_ROWS:
        return occurrences.select(*on).join(F.broadcast(wanted), on).distinct()
    return occurrences.select(*on).distinct().join(wanted, on)


def sketch_hits(
    entries: DataFrame, sample: DataFrame, spec: SketchSpec, strand_neutral: bool = False
) -> DataFrame:
    """The distinct sketch shingles that occur in the sample (rows of ``sample_grams`` or ``sample_set``).

    Every sketched shingle hashes at or below the largest hash in the database, so other sample
    shingles are dropped in the scan. This needs the sketched orientation, hence not strand-neutral.
    """
    key = canonical(F.col("kmer")) if strand_neutral else F.col("kmer")
    wanted = materialize(entries.select(key.alias("kmer")).distinct(), "wanted")
    if not strand_neutral and not spec.both_strands:
        top = entries.agg(F.max("h")).first()[0]
        if top is not None:
            sample = sample.where(F.pmod(spec.hasher(F.col("kmer")), F.lit(spec.prime)) <= F.lit(top))
    return distinct_hits(sample, wanted, ["kmer"])


def membership(
    meta: DataFrame,
    entries: DataFrame,
    hits: DataFrame,
    sample_size: int | DataFrame,
    fp_rate: float = 0.0,
    strand_neutral: bool = False,
) -> DataFrame:
    """``(name, intersection, containment index, jaccard index)`` for every sketch.

    ``sample_size`` is the number of distinct sample shingles, as a number or a one-row frame
    ``(sample_size)``. ``fp_rate`` takes the expected false hits of a probabilistic sample set off
    the count; with exact sets it is zero.
    """
    key = canonical(F.col("kmer")) if strand_neutral else F.col("kmer")
    member = hits.select(F.col("kmer").alias("key")).withColumn("hit", F.lit(1))
    per_sketch = (
        entries.select("name", key.alias("key"))
        .join(member, "key", "left")
        .groupBy("name")
        .agg(F.count("*").alias("filled"), F.count("hit").alias("found"))
    )
    base = meta.join(per_sketch, "name").select("name", "n", "true_num_kmers", "filled", "found")
    if isinstance(sample_size, DataFrame):
        base = base.withColumn("one", F.lit(1)).join(F.broadcast(sample_size.withColumn("one", F.lit(1))), "one")
    else:
        base = base.withColumn("sample_size", F.lit(sample_size))
    shared = F.col("found") - F.bround(F.lit(fp_rate) * F.col("n")).cast("bigint")
    raw = base.withColumn("shared", shared).withColumn("ratio", F.col("shared") / F.col("filled"))
    in_set = F.col("true_num_kmers") * F.col("ratio")
    jaccard = in_set / (F.col("true_num_kmers") + F.col("sample_size") - in_set)

    def unit(column):
        return F.least(F.greatest(column, F.lit(0.0)), F.lit(1.0))

    return raw.select(
        "name",
        F.col("shared").alias("intersection"),
        unit(F.col("ratio")).alias("containment index"),
        unit(jaccard).alias("jaccard index"),
    )


def above(results: DataFrame, threshold: float) -> DataFrame:
    """Rows strictly above the threshold, best first (ties by name)."""
    index = F.col("`containment index`")
    return results.where(index > threshold).orderBy(index.desc(), "name")


def _letters(sequences: DataFrame) -> int:
    return sequences.agg(F.sum(F.length("seq"))).first()[0] or 0


def query_membership(
    meta: DataFrame,
    entries: DataFrame,
    sequences: DataFrame,
    spec: SketchSpec,
    strand_neutral: bool = False,
    training: DataFrame | None = None,
    exact_size: bool = True,
) -> DataFrame:
    """The whole single-length query over raw sample sequences.

    With ``training`` sequences the sample is first restricted to their shingles. An estimated
    sample size (``exact_size=False``) avoids shuffling the distinct sample: the only pass over it
    is then a filtered scan.

    The distinct shingles of a sample of up to ``BROADCAST_ROWS`` letters, or as many that are left of it, go to the sketches, which are not shuffled then.
    """
    if training is not None:
        sample = restrict_to_training(sample_set(sequences, spec, strand_neutral), sample_grams(training, spec, strand_neutral))
        sample = materialize(sample, "sample")
        if (left := sample.count()) <= BROADCAST_ROWS:
            return membership(meta, entries, F.broadcast(sample), left, strand_neutral=strand_neutral)
        size, entries = sample.agg(F.count("*").alias("sample_size")), materialize(entries, "entries")
        return membership(meta, entries, sketch_hits(entries, sample, spec, strand_neutral), size, strand_neutral=strand_neutral)
    entries = materialize(entries, "entries")
    if exact_size and _letters(sequences) <= BROADCAST_ROWS:
        sample = materialize(sample_set(sequences, spec, strand_neutral), "sample")
        return membership(meta, entries, F.broadcast(sample), sample.count(), strand_neutral=strand_neutral)
    else:
        sample = sample_grams(sequences, spec, strand_neutral)
        size = (
            sample.distinct().agg(F.count("*").alias("sample_size"))
            if exact_size
            else sample.agg(
                F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("kmer"), F.lit(14))).alias("sample_size")
            )
        )
    hits = sketch_hits(entries, sample, spec, strand_neutral)
    return membership(meta, entries, hits, size, strand_neutral=strand_neutral)
