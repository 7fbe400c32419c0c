"""What databases do without moving or making sketches a second time."""

import hashlib

import numpy as np
import pytest
from conftest import sets

from sketchloom.functions.seq import portable_hash
from sketchloom.operators import blocks, grams, maintenance, sketch
from sketchloom.operators.sketch import SketchSpec
from sketchloom.sources import sketchdb

SPEC = SketchSpec(n=4, ksize=3, alphabet=None, hasher=portable_hash)
TEXTS = {"a": "abcdefgh", "b": ["abcd", "xyzxyz"], "c": "", "d": "hgfedcba", "e": "abcdefgh"}


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(params=[0, 1_000_000])
def most(request, monkeypatch):
    """Names that are broadcast: none or all."""
    monkeypatch.setattr(maintenance, "BROADCAST_ROWS", request.param)
    return request.param


def test_names_are_kept_and_dropped(spark, most):
    db = maintenance.build(sets(spark, TEXTS), SPEC, exact=True)
    stored = maintenance.Database(*db[:2])
    names = spark.createDataFrame([("x/a",), ("c",), ("b",), ("nope",)], "name string")
    whole = rows(db.entries.select("name", "slot", "h", "cnt", "kmer"))
    for some in (db, stored):
        picked, left = maintenance.pick(some, names, check=False), maintenance.delete(some, names)
        assert rows(picked.entries.select("name", "slot", "h", "cnt", "kmer")) == [r for r in whole if r[0] in "abc"]
        assert rows(left.entries.select("name", "slot", "h", "cnt", "kmer")) == [r for r in whole if r[0] in "de"]
        assert [r[0] for r in rows(picked.meta.select("name"))] == ["a", "b", "c"]
        assert [r[0] for r in rows(left.meta.select("name"))] == ["d", "e"]


def test_a_set_without_a_name_is_not_deleted(spark, most):
    texts = spark.createDataFrame([(None, "abcdef"), ("a", "abcdef")], "name string, seq string")
    left = maintenance.delete(maintenance.build(texts, SPEC), spark.createDataFrame([("a",), (None,)], "name string"))
    assert {r["name"] for r in left.entries.collect()} == {None}


def test_union_keeps_the_first_of_a_path(spark, most):
    first = maintenance.build(sets(spark, {"a": "abcdefgh", "b": "aaaaaa"}), SPEC, exact=True)
    second = maintenance.build(sets(spark, {"b": "zzzyyyxxx", "c": "hgfedcba"}), SPEC, exact=True)
    both = maintenance.union(first, second)
    expected = rows(first.entries.select("name", "h", "cnt")) + rows(second.entries.where("name = 'c'").select("name", "h", "cnt"))
    assert rows(both.entries.select("name", "h", "cnt")) == sorted(expected)
    assert rows(both.meta.select("name", "true_num_kmers")) == [("a", 6), ("b", 1), ("c", 6)]


def test_sketches_are_not_moved_for_names(spark, monkeypatch):
    db = maintenance.build(sets(spark, TEXTS), SPEC)
    names = spark.createDataFrame([("a",)], "name string")
    assert "BroadcastHashJoin [name" in plan(maintenance.delete(db, names).entries)
    monkeypatch.setattr(maintenance, "BROADCAST_ROWS", 0)
    text = plan(maintenance.pick(db, names, check=False).entries)
    assert text.index("MapInArrow") < text.index("LeftSemi"), "the join is below the sketching"


def test_export_does_not_shuffle_fresh_sketches(spark, tmp_path):
    db = maintenance.build(sets(spark, TEXTS), SPEC)
    assert "rangepartitioning" not in plan(sketchdb._clustered(db))
    assert "rangepartitioning" in plan(sketchdb._clustered(maintenance.Database(*db[:2])))
    sketchdb.export_database(db, str(tmp_path / "db"))
    assert rows(sketchdb.import_database(spark, str(tmp_path / "db")).entries) == rows(db.entries)


def test_what_is_added_asks_for_no_counts(spark, monkeypatch):
    counted = []
    build = maintenance.describe
    db = maintenance.build(sets(spark, {"a": "abcdefgh"}), SPEC, exact=True)
    bad = maintenance.Database(db.meta.drop("true_num_kmers").join(_failing(spark), "name", "left"), db.entries)
    monkeypatch.setattr(maintenance, "describe", lambda *a, **k: counted.append(1) or build(*a, **k))
    assert rows(maintenance.additions(bad, sets(spark, TEXTS), SPEC).meta.select("name")) == [("b",), ("c",), ("d",), ("e",)]
    assert counted == [1]


def _failing(spark):
    """Counts that cannot be made."""
    from pyspark.sql import functions as F

    many = F.udf(lambda x: 1 // 0, "bigint")
    return spark.createDataFrame([("a",)], "name string").select("name", many("name").alias("true_num_kmers"))


def test_copies_of_sets_and_of_entries_are_the_same(spark):
    texts = sets(spark, TEXTS)
    expected = [("a", "a"), ("b", "b"), ("d", "d"), ("e", "a")]
    assert rows(blocks.distinct_sketches(sketch.bottom_n(texts, SPEC))) == expected
    found = blocks.distinct_sketches(sketch.bottom_sets(texts, SPEC))
    assert rows(found) == expected
    assert "MapInArrow" not in plan(found), "signatures are written"


@pytest.mark.parametrize("size", [1, 3, 4, 20, 21, 32, 52, 55, 56])
def test_md5_numbers(size):
    data = np.random.default_rng(size).integers(0, 256, 200).astype(np.uint8)
    starts = np.arange(len(data) - size)
    got = grams.hashed(data, starts, np.full(len(starts), size), grams.md5_numbers)
    expected = [int(hashlib.md5(data[s : s + size].tobytes()).hexdigest()[:15], 16) for s in starts]
    assert got.tolist() == expected
