"""The test tables as sets, samples, profiles and taxonomies; shared by the catalogue and the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.functions.seq import dna_projection, portable_hash
from sketchloom.operators.profile import blank_missing, combine_rows
from sketchloom.operators.sketch import SketchSpec
from sketchloom.session import deal_out

# Shingle length and sketch size of the catalogue, and its multi-length range.
K = 21
N = 200
N_FOCAL = 1000
KS = [12, 15, 18, 21]

TEXT = SketchSpec(n=N, ksize=K, alphabet=None, hasher=portable_hash)
TEXT_FOCAL = SketchSpec(n=N_FOCAL, ksize=K, alphabet=None, hasher=portable_hash)
DNA_SPEC = SketchSpec(n=N, ksize=K, hasher=portable_hash)
DNA_STRANDS = SketchSpec(n=N, ksize=K, both_strands=True, hasher=portable_hash)

PARTY_KEY = {"customer": "custkey", "supplier": "suppkey"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, dna: bool = False) -> DataFrame:
    seq = dna_projection("text") if dna else F.col("text")
    rows = deal_out(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select(F.col("doc_id").cast("string").alias("name"), seq.alias("seq"))


def benchmark(spark: SparkSession, folder: str, dna: bool = False) -> DataFrame:
    """All benchmark items as the records of one sample."""
    seq = dna_projection("text") if dna else F.col("text")
    rows = deal_out(table(spark, folder, "benchmark").select("text"))
    return rows.select(F.lit("benchmark").alias("name"), seq.alias("seq"))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Each conversation is a set, its turns are the records."""
    return deal_out(table(spark, folder, "conversations").select("conv_id", "text")).select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("name"), F.col("text").alias("seq")
    )


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return deal_out(table(spark, folder, "pages").select("page_id", "html")).select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("name"), F.col("html").alias("seq")
    )


def lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in a three-level taxonomy: language, source within language, the document itself."""
    rows = table(spark, folder, "documents")
    name = F.col("doc_id").cast("string")
    path = F.concat(
        F.lit("k__"), "lang", F.lit("_"), F.upper("lang"),
        F.lit("|g__"), "lang", F.lit("-"), "source", F.lit("_"), "source",
        F.lit("|s__d"), name, F.lit("_doc_"), name,
    )
    return rows.select(name.alias("name"), F.concat(F.lit("doc_"), name).alias("organism"), F.concat(F.lit("d"), name).alias("tax_id"), path.alias("path"))


def trade_profile(spark: SparkSession, folder: str, who: str) -> DataFrame:
    """A profile counting customers or suppliers along region, (unlisted) zone, nation and half.

    The zone is on the paths but is no taxon of the profile; the halves of a nation are even and odd
    keys. Inner taxa have a count of their own besides those of their children. Rows repeat (one per
    party), as they may in a profile file.
    """
    short = who[0]
    party = table(spark, folder, who)
    nation = F.broadcast(table(spark, folder, "nation"))
    rows = party.join(nation, F.col(f"{short}_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("r"), F.col("n_regionkey")).alias("r"),
        F.concat(F.lit("z"), F.col("n_nationkey") % 3).alias("z"),
        F.concat(F.lit("n"), F.col("n_nationkey")).alias("n"),
        F.concat(F.lit("h"), F.col("n_nationkey"), F.lit("-"), F.pmod(F.col(f"{short}_{PARTY_KEY[who]}"), F.lit(2))).alias("h"),
    )
    levels = F.array(
        F.struct(F.lit("region").alias("rank"), F.array("r").alias("path"), F.lit(4.0).alias("weight")),
        F.struct(F.lit("nation").alias("rank"), F.array("r", "z", "n").alias("path"), F.lit(2.0).alias("weight")),
        F.struct(F.lit("half").alias("rank"), F.array("r", "z", "n", "h").alias("path"), F.lit(1.0).alias("weight")),
    )
    raw = rows.select(F.explode(levels).alias("l")).select(
        F.element_at("l.path", -1).alias("tax_id"),
        "l.rank",
        F.col("l.path").alias("tax_path"),
        F.transform("l.path", lambda x: F.upper(x)).alias("tax_path_sn"),
        F.col("l.weight").alias("abundance"),
    )
    return blank_missing(combine_rows(raw))
