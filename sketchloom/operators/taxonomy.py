"""Joining results with taxonomies, building profiles from them, and scoring them against a truth.

A taxonomy is ``(name, organism, tax_id, path)``; a path is ``k__<id>_<name>|p__<id>_<name>|...``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rank letters from the top down, what they stand for, and the constant abundance.
RANKS = {
    "k": "superkingdom",
    "p": "phylum",
    "c": "class",
    "o": "order",
    "f": "family",
    "g": "genus",
    "s": "species",
    "t": "strain",
}
PROFILE_ABUNDANCE = 0.01


def require_unique_files(taxonomy: DataFrame) -> None:
    twice = taxonomy.groupBy("name").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"file names are not unique: {', '.join(r['name'] for r in twice)}")


def path_levels(path: Column | str) -> Column:
    """Array of ``struct(rank, id, label)`` of a path, top level first."""
    parts = F.transform(F.split(path, r"\|"), lambda level: F.split(level, "_"))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.get(p, 0).alias("rank"),
            F.get(p, 2).alias("id"),
            F.array_join(F.slice(p, F.lit(4), F.greatest(F.size(p), F.lit(1))), " ").alias("label"),
        ),
    )


def with_taxonomy(results: DataFrame, taxonomy: DataFrame, strict: bool = True) -> DataFrame:
    """Attach the taxonomy to results by name; a result without one is an error unless not strict."""
    if strict:
        missing = results.join(taxonomy, "name", "left_anti").select("name").limit(5).collect()
        if missing:
            raise KeyError(f"not in the taxonomy: {', '.join(r['name'] for r in missing)}")
    return results.join(taxonomy, "name")


def ancestor_rows(joined: DataFrame) -> DataFrame:
    """One row per result and level of its path: ``(name, tax_id, rank, tax_path, tax_path_sn)``."""
    levels = joined.select("name", path_levels("path").alias("levels"))
    deep = levels.select("name", "levels", F.posexplode("levels").alias("at", "level"))
    upto = F.slice("levels", F.lit(1), F.col("at") + 1)
    return deep.select(
        "name",
        F.col("level.id").alias("tax_id"),
        F.col("level.rank").alias("letter"),
        F.transform(upto, lambda x: x["id"]).alias("tax_path"),
        F.transform(upto, lambda x: x["label"]).alias("tax_path_sn"),
    )


def profile_from_results(results: DataFrame, taxonomy: DataFrame, at: str, least: float, strict: bool = True) -> DataFrame:
    """Profile rows for every ancestor of every result strictly above the threshold, constant abundance.

    Paths that name a taxon twice are left out. A taxon is written once however many results reach it.
    """
    passed = results.where(F.col(f"`{at}`") > least).select("name")
    rows = ancestor_rows(with_taxonomy(passed, taxonomy, strict))
    names = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    return (
        rows.where(F.size("tax_path") == F.size(F.array_distinct("tax_path")))
        .select(
            "tax_id",
            names[F.col("letter")].alias("rank"),
            "tax_path",
            "tax_path_sn",
            F.lit(PROFILE_ABUNDANCE).alias("abundance"),
        )
        .distinct()
    )


def score_thresholds(predicted: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """``(rank, threshold, tp, fp, fn)`` of taxa predicted with a score strictly above each threshold.

    ``predicted`` is ``(rank, tax_id, score)``, ``truth`` is ``(rank, tax_id)``. Each taxon is reduced to
    its best score once; all thresholds are then counted in the same aggregation.
    """
    best = predicted.groupBy("rank", "tax_id").agg(F.max("score").alias("score"))
    real = truth.select("rank", "tax_id").distinct().withColumn("real", F.lit(True))
    both = best.join(real, ["rank", "tax_id"], "full").withColumn("real", F.coalesce("real", F.lit(False)))
    said = [F.coalesce(F.col("score") > t, F.lit(False)) for t in thresholds]
    sums = []
    for at, yes in enumerate(said):
        sums.append(F.count_if(yes & F.col("real")).alias(f"tp{at}"))
        sums.append(F.count_if(yes & ~F.col("real")).alias(f"fp{at}"))
        sums.append(F.count_if(~yes & F.col("real")).alias(f"fn{at}"))
    counted = both.groupBy("rank").agg(*sums)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.col(f"tp{at}").alias("tp"),
                F.col(f"fp{at}").alias("fp"),
                F.col(f"fn{at}").alias("fn"),
            )
            for at, t in enumerate(thresholds)
        ]
    )
    return counted.select("rank", F.inline(rows))


def repath(lineages: DataFrame) -> DataFrame:
    """Turn ``(name, names, ids)`` lineages (lists separated by ``|``) into the taxonomy format.

    The organism is the deepest level that has both an id and a name. Levels lacking either are left
    empty. The last letter of the path is dropped: it is the separator before an empty strain level.
    """
    ids = F.split("ids", r"\|")
    names = F.transform(F.split("names", r"\|"), lambda x: F.replace(x, F.lit(" "), F.lit("_")))
    letters = F.array(*[F.lit(letter) for letter in RANKS])
    zipped = F.arrays_zip(ids.alias("id"), names.alias("label"), letters.alias("letter"))
    levels = lineages.select("name", F.slice(zipped, F.lit(1), F.size(ids)).alias("z"))
    filled = F.filter("z", lambda x: (x["id"] != "") & (x["label"] != ""))
    text = F.array_join(
        F.transform(
            "z",
            lambda x: F.when(
                (x["id"] != "") & (x["label"] != ""), F.concat(x["letter"], F.lit("__"), x["id"], F.lit("_"), x["label"])
            ).otherwise(""),
        ),
        "|",
    )
    deepest = F.try_element_at(filled, F.lit(-1))
    return levels.select(
        "name",
        F.concat(deepest["id"], F.lit("_"), deepest["label"]).alias("organism"),
        deepest["id"].alias("tax_id"),
        text.alias("text"),
    ).select("name", "organism", "tax_id", F.expr("left(text, greatest(length(text) - 1, 0))").alias("path"))
