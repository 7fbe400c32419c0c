"""Exact shingles where a set's texts lie together, against plain counts."""

from collections import Counter

import pytest
from conftest import dna, flip, grams, sets

from sketchloom.operators import multik, sketch, truth, wholesets


def canon(text, k):
    return [min(g, flip(g)) for g in grams(text.upper(), k) if set(g) <= set("ACGT")]


def random_sets(rng):
    data = {f"s{i}": [dna(rng, rng.randrange(0, 260)) for _ in range(3)] for i in range(8)}
    return data | {
        "none": ["NNNN"], "empty": [""], "short": ["AC"], "odd": ["éACGTACGTTGé" * 9, "acgtn-ACGGTCA"],
        "repeat": ["A" * 400, "ac" * 150], "twice": [data["s2"][0], data["s2"][0]], "mixed": [data["s0"][1] + "n" + flip(data["s3"][1])],
    }


@pytest.mark.parametrize(("whole", "held"), [(1 << 20, 1 << 20), (300, 1 << 20), (1 << 20, 4)])
def test_sums_and_intersection_equal_plain_counts(spark, rng, monkeypatch, whole, held):
    """Short sets, long ones, and a sample that is too large to go to the tasks."""
    monkeypatch.setattr(sketch, "WHOLE", whole)
    monkeypatch.setattr(wholesets, "SAMPLE_BYTES", held)
    monkeypatch.setattr(wholesets.numeric, "SLAB", 500)
    data, ks = random_sets(rng), [1, 9, 21, 32]
    rows = sets(spark, data).unionByName(spark.createDataFrame([(None, "ACGTACGTTT" * 4), ("s0", None)], "name string, seq string"))
    asked = [data["s0"][0], flip(data["s4"][1] or "A"), "A" * 50]
    sample = sets(spark, {"q": asked})
    counts = {(n, k): Counter(g for r in some for g in canon(r, k)) for n, some in data.items() for k in ks}
    wanted = {k: {g for r in asked for g in canon(r, k)} for k in ks}
    exact = {(r["name"], r["k"]): (r["hits"], r["denom"]) for r in wholesets.containment(rows, sample, ks).collect()}
    assert exact == {x: (len(set(c) & wanted[x[1]]), len(c)) for x, c in counts.items() if c}
    tally = {(r["name"], r["k"]): (r["total"], r["distinct"], r["single"]) for r in wholesets.statistics(rows, ks).collect()}
    assert tally == {x: (sum(c.values()), len(c), sum(v == 1 for v in c.values())) for x, c in counts.items() if c}
    both = sorted((r["k"], r["kmer"]) for r in wholesets.intersection(rows, sample, ks).collect())
    assert both == sorted(map(tuple, truth.intersection(truth.distinct_shingles(rows, ks), truth.distinct_shingles(sample, ks)).collect()))
    assert wholesets.containment(rows.where("false"), sample, ks).count() == 0
    assert wholesets.intersection(rows, sample.where("false"), ks).count() == 0
    with pytest.raises(ValueError):
        wholesets.containment(rows, sample, [33])


@pytest.mark.parametrize("whole", [1 << 20, 300])
def test_canonical_summary_equals_plain_counts(spark, rng, monkeypatch, whole):
    monkeypatch.setattr(sketch, "WHOLE", whole)
    data = random_sets(rng)
    rows = sets(spark, data).unionByName(spark.createDataFrame([(None, "ACGTACGTTT" * 4), ("s0", None)], "name string, seq string"))
    own = {n: {g for r in some for g in canon(r, 11)} for n, some in (data | {None: ["ACGTACGTTT" * 4]}).items()}
    got = {r["name"]: tuple(r)[1:] for r in wholesets.canonical_summary(rows, 11).collect()}
    assert got == {n: (len(x), min(x), max(x)) for n, x in own.items() if x}


def test_shingles_of_exact_queries_are_not_shuffled(spark, rng, tmp_path):
    """Texts and marks are exchanged, shingles are not."""
    from sketchloom.plans.catalog import QUERIES

    texts = [(i, dna(rng, 60), "en", "a") for i in range(6)]
    spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("q", dna(rng, 60))], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name in ("ground_truth_intersection", "canonical_kmers", "ground_truth", "shingle_statistics"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "Intersect" not in plan and "super-k-mers" not in plan, name


def test_only_strands_that_begin_like_the_sample_are_cut(spark):
    entries = spark.createDataFrame([("a", 0, "ACGTT"), ("b", 0, "CCCCC")], "name string, slot int, kmer string")
    starts = spark.createDataFrame([("ACG",), ("GGG",)], "gate string")
    every = multik.prefix_index(entries, [3, 5]).collect()
    got = multik.prefix_index(entries, [3, 5], starts).collect()
    assert sorted(got) == sorted(r for r in every if r["key"][:3] in ("ACG", "GGG")) and len(got) == 4 < len(every)


def test_a_stored_index_is_dealt_once_to_be_summed_up(spark, tmp_path):
    from sketchloom.plans.catalog import QUERIES

    rows = [(i, "some words of text number " + str(i) * 9) for i in range(5)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    frame = QUERIES["index_round_trip"](spark, str(tmp_path))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and {r["name"] for r in frame.collect()} == {str(i) for i in range(5)}
