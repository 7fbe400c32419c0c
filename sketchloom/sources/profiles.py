"""CAMI profiles, taxonomies and truth profiles as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.operators.profile import EPSILON, blank_missing, combine_rows
from sketchloom.operators.taxonomy import RANKS, require_unique_files

# The column names of the format.
COLUMNS = ("TAXID", "RANK", "TAXPATH", "TAXPATHSN", "PERCENTAGE")


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Parse one profile; repeated taxa are summed, unknown path elements blanked, ancestors placed.

    The ``@@`` line says which column is which; RANK and TAXPATHSN are optional.
    """
    lines = spark.read.text(path).select(F.rtrim("value").alias("value")).where("value <> ''")
    head = lines.where(F.col("value").startswith("@@")).first()
    titles = head["value"].replace("@", "").split() if head else []
    titles = ["TAXPATHSN" if t == "TAXPATH_SN" else t for t in titles]
    if not {"TAXID", "TAXPATH", "PERCENTAGE"} <= set(titles):
        raise ValueError("the header line (@@) must name TAXID, TAXPATH and PERCENTAGE")
    parts = lines.where(~F.substring("value", 1, 1).isin("@", "#")).select(F.split("value", "\t").alias("p"))

    def part(title: str):
        return F.trim(F.get("p", titles.index(title))) if title in titles else F.lit(None).cast("string")

    rows = parts.select(
        part("TAXID").alias("tax_id"),
        part("RANK").alias("rank"),
        F.split(part("TAXPATH"), r"\|").alias("tax_path"),
        F.split(part("TAXPATHSN"), r"\|").alias("tax_path_sn"),
        part("PERCENTAGE").cast("double").alias("abundance"),
    )
    return blank_missing(combine_rows(rows))


def profile_lines(profile: DataFrame) -> DataFrame:
    """The rows worth writing as ``(depth, tax_id, line)``."""
    line = F.concat_ws(
        "\t",
        "tax_id",
        "rank",
        F.array_join("tax_path", "|"),
        F.array_join("tax_path_sn", "|"),
        F.format_string("%f", "abundance"),
    )
    return profile.where(F.col("abundance") > EPSILON).select(F.size("tax_path").alias("depth"), "tax_id", line.alias("line"))


def write_profile(profile: DataFrame, path: str, sample_id: str = "") -> None:
    """Write a profile folder: a header part, then rows by the length of their path."""
    spark = profile.sparkSession
    header = [
        "#CAMI Submission for Taxonomic Profiling",
        "@Version:0.9.1",
        f"@SampleID:{sample_id}",
        "@Ranks:" + "|".join(RANKS.values()),
        "",
        "@@" + "\t".join(COLUMNS),
    ]
    first = spark.createDataFrame([(-1, str(at), line) for at, line in enumerate(header)], "depth int, tax_id string, line string")
    first.unionByName(profile_lines(profile)).orderBy("depth", "tax_id").select("line").write.text(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """``(name, organism, tax_id, path)`` from whitespace-separated lines; file names must be unique."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).where("p[0] <> ''")
    names = ["name", "organism", "tax_id", "path"]
    table = parts.select(*[F.get("p", at).alias(name) for at, name in enumerate(names)])
    require_unique_files(table)
    return table


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``(rank, tax_id)`` of a truth profile, ranks as letters."""
    letters = F.create_map(*[F.lit(x) for letter, rank in RANKS.items() for x in (rank, letter)])
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    rows = parts.where(~F.col("p")[0].startswith("@") & (F.size("p") > 1))
    return rows.select(letters[F.col("p")[1]].alias("rank"), F.col("p")[0].alias("tax_id")).distinct()
