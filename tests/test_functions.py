import argparse

import pytest
from pyspark.sql import functions as F

from sketchloom.functions import numbers as nb
from sketchloom.functions import seq as sq
from tests.conftest import flip, grams, sets


def test_shingles_equal_brute_force_whatever_the_piece(spark, rng):
    letters = "abC \nü\U0001f600é"
    texts = {f"t{i}": "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for i in range(30)}
    texts["empty"] = ""
    for step in (3, 8, 1000):
        rows = sq.explode_shingles(sets(spark, texts), 4, alphabet=None, uppercase=False, step=step).collect()
        got = sorted((r["name"], r["kmer"]) for r in rows)
        assert got == sorted((n, g) for n, s in texts.items() for g in grams(s, 4))


def test_alphabet_splits_and_case_folds(spark):
    rows = sq.explode_shingles(sets(spark, {"a": "acgtNACGTTxAC"}), 4).collect()
    assert sorted(r["kmer"] for r in rows) == ["ACGT", "ACGT", "CGTT"]


def test_windows_shrink_at_the_end(spark):
    row = spark.createDataFrame([("ABCDE",)], "s string").select(sq.windows("s", 2, 3).alias("w")).first()
    assert row["w"] == ["ABC", "BCD", "CDE", "DE"]


def test_strands_and_case(spark, rng):
    kmers = ["".join(rng.choice("ACGT") for _ in range(9)) for _ in range(20)]
    frame = spark.createDataFrame([(k,) for k in kmers], "kmer string")
    once = sq.reverse_complement("kmer")
    for row in frame.select("kmer", once.alias("rc"), sq.reverse_complement(once).alias("twice"), sq.canonical(F.col("kmer")).alias("c")).collect():
        assert row["rc"] == flip(row["kmer"])
        assert row["twice"] == row["kmer"]
        assert row["c"] == min(row["kmer"], row["rc"])
    text = spark.createDataFrame([("straße İx",), ("plain Text",)], "s string").select(sq.ascii_upper("s").alias("u")).collect()
    assert [r["u"] for r in text] == ["STRAßE İX", "PLAIN TEXT"]
    both = spark.createDataFrame([("abz AbZ9ü",)], "s string").select(sq.dna_projection("s").alias("d")).first()["d"]
    assert both == "ACCGACC9ü"


def test_number_helpers():
    assert nb.parse_k_range("10-21-2") == [10, 12, 14, 16, 18, 20]
    assert nb.parse_k_range("3-5") == [3, 4, 5]
    assert nb.parse_k_range("7") == [7]
    for bad in ("x", "5-3", "1-2-0"):
        with pytest.raises(argparse.ArgumentTypeError):
            nb.parse_k_range(bad)
    assert nb.cap_k_range([10, 30, 20], 21) == [10, 20]
    with pytest.raises(ValueError):
        nb.cap_k_range([30], 21)
    assert [n for n in range(20) if nb.is_prime(n)] == [2, 3, 5, 7, 11, 13, 17, 19]
    assert nb.prime_at_most(20) == 19 and nb.prime_at_most(1) == 1 and nb.prime_at_most(2) == 2
    assert nb.prime_at_most(9_999_999_999_971) == 9_999_999_999_971
    assert nb.clamp_location(9, [1, 2]) == 1 and nb.clamp_location(-1, [1, 2]) == -1
    assert nb.restricted_float("0.5") == 0.5
    with pytest.raises(argparse.ArgumentTypeError):
        nb.restricted_float("1.0")
    assert nb.expected_threshold(500, 0, 1e-4, 0.95) == 0
    assert nb.expected_threshold(1, 0.01, 1e-4, 0.95) == 0
    assert nb.expected_threshold(500, 0.5, 1e-4, 0.95) == pytest.approx(0.4226, abs=1e-3)
    assert list(nb.chunks([1, 2, 3, 4, 5], 2)) == [[1, 2], [3, 4], [5]]
