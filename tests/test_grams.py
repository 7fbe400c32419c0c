import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import numpy as np

from conftest import dna, grams, sets
from sketchloom.functions.seq import HASHERS, portable_hash
from sketchloom.operators import grams as numeric
from sketchloom.operators import similarity, sketch
from sketchloom.operators.sketch import SketchSpec


def texts_of(rng, letters, many=30, longest=90):
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(longest))) for _ in range(many)]


@pytest.mark.parametrize("k", [1, 6, 8, 13, 21, 60])
def test_hashes_equal_the_column_expressions(spark, rng, k):
    kmers = sorted({g for t in texts_of(rng, "abcXYZ éß漢😀", 20, 150) for g in grams(t, k)})
    raw = [g.encode() for g in kmers]
    sizes = np.array([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    frame = spark.createDataFrame([(g,) for g in kmers], "kmer string")
    for name, hasher in HASHERS.items():
        want = {r["kmer"]: r["h"] for r in frame.select("kmer", hasher(F.col("kmer")).alias("h")).collect()}
        got = numeric.hashed(data, np.cumsum(sizes) - sizes, sizes, numeric.NUMBERS[name])
        assert got.tolist() == [want[g] for g in kmers]


def test_colliding_hashes_are_told_apart(rng):
    texts = texts_of(rng, "acgté", 12, 60)
    found = numeric.shingles_of(pa.array([t.encode() for t in texts]), np.arange(len(texts)), 4, None, False)
    own = lambda g: int(hashlib.md5(g.encode()).hexdigest()[:15], 16) % 7
    small = numeric.smallest(found, 5, 7, numeric.md5_numbers)
    got = list(zip(small.owner.tolist(), small.slot.tolist(), small.h.tolist(), small.cnt.tolist(), small.kmer.to_pylist(), strict=True))
    want = []
    for i, t in enumerate(texts):
        by_hash = {}
        for g in grams(t, 4):
            by_hash.setdefault(own(g), []).append(g)
        want += [(i, s, h, len(by_hash[h]), min(by_hash[h])) for s, h in enumerate(sorted(by_hash)[:5])]
    assert got == want


def test_distinct_survives_equal_keys(rng, monkeypatch):
    texts = texts_of(rng, "acgt", 6, 40)
    found = numeric.shingles_of(pa.array([t.encode() for t in texts]), np.arange(len(texts)), 3, None, False)
    monkeypatch.setattr(numeric, "xxhash_numbers", lambda data, words, starts, size: (data[starts] % 2).astype(np.uint64))
    monkeypatch.setattr(numeric, "P2", np.uint64(0))
    assert numeric.distinct(found, len(texts)).tolist() == [len(set(grams(t, 3))) for t in texts]


@pytest.mark.parametrize("hasher", HASHERS.values())
def test_long_sets_are_sketched_as_short_ones(spark, rng, monkeypatch, hasher):
    data = {f"s{i}": [dna(rng, rng.randrange(120)) + "N" + dna(rng, 30) for _ in range(3)] for i in range(6)} | {"none": "", "huge": dna(rng, 900)}
    spec = SketchSpec(n=12, ksize=5, prime=211, hasher=hasher, both_strands=True, piece=64)
    rows = sets(spark, data).unionByName(spark.createDataFrame([(None, "ACGTACGTTT"), ("s0", None)], "name string, seq string"))
    every = [sketch.bottom_n, lambda r, s: sketch.cardinality(r, s, exact=True), lambda r, s: sketch.bottom_sets(r, s)]
    key = lambda r: (str(r[0]), r[1:])
    whole = [sorted(map(tuple, f(rows, spec).collect()), key=key) for f in every]
    monkeypatch.setattr(sketch, "WHOLE", 200)
    assert whole == [sorted(map(tuple, f(rows, spec).collect()), key=key) for f in every]
    # The way of hashes without a numpy form.
    monkeypatch.setattr(numeric, "NUMBERS", {})
    assert whole[0] == sorted(map(tuple, sketch.bottom_n(rows, spec).collect()), key=key)


def test_shingles_of_short_sets_are_not_shuffled(spark, rng):
    rows, spec = sets(spark, {"a": dna(rng, 50)}), SketchSpec(hasher=portable_hash)
    for frame in (sketch.cardinality(rows, spec, exact=True), sketch.bottom_n(rows, spec)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        branch = plan[plan.index("MapInArrow") : plan.index("MapInArrow") + 1500]
        assert "collect_list(seq" in branch and "kmer" not in branch.split("collect_list(seq")[1].split("Generate")[0]


def test_whole_sketches_compare_as_entries(spark, rng):
    data = {f"s{i}": dna(rng, rng.randrange(4, 60)) for i in range(9)} | {"none": "AC"}
    spec = SketchSpec(n=20, ksize=3)
    rows, names = sets(spark, data), sets(spark, data).select("name")
    focal = sketch.bottom_n(sets(spark, {"q": dna(rng, 40)}), spec)
    for compare in (similarity.capped_overlap, similarity.union_overlap, lambda f, o, n, names: similarity.plain_overlap(f, o, names)):
        got = [sorted(map(tuple, compare(focal, o, 9, names=names).collect())) for o in (sketch.bottom_n(rows, spec), sketch.bottom_sets(rows, spec))]
        assert got[0] == got[1] and len(got[0]) == len(data)


def test_the_index_is_summed_up_where_it_is_made(spark, tmp_path):
    from sketchloom.plans.catalog import QUERIES

    rows = [(i, "some words of text number " + str(i) * 9, "en", "a", 30) for i in range(5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    frame = QUERIES["prefix_index"](spark, str(tmp_path))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    # Above the explosion into index rows nothing is shuffled.
    assert "Exchange" not in plan[: plan.index("Generate explode(filter") if "Generate explode(filter" in plan else plan.index("Generate")]
    assert {r["name"] for r in frame.collect()} == {str(i) for i in range(5)}
