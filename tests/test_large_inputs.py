import pytest
from conftest import dna, sets

from sketchloom.operators import membership, sketch
from sketchloom.operators.sketch import SketchSpec
from sketchloom.sources import ranges


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_training_shingles_are_filtered_where_they_are_scanned(spark, rng, monkeypatch):
    spec = SketchSpec(n=12, ksize=7)
    training, sample = sets(spark, {f"t{i}": dna(rng, 300) for i in range(6)}), sets(spark, {"s": [dna(rng, 400), "acgtacgtac"]})
    ask = lambda: membership.restrict_to_training(membership.sample_set(sample, spec), membership.sample_grams(training, spec))
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ask()
        assert "BroadcastHashJoin" in plan_of(found) and "SortMergeJoin" not in plan_of(found)
        kept = sorted(found.collect())
        monkeypatch.setattr(membership, "BROADCAST_ROWS", 1)
        assert sorted(ask().collect()) == kept
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


@pytest.mark.parametrize("whole", [1 << 20, 100])
def test_sketches_of_a_hash_list_are_made_where_the_texts_lie(spark, rng, monkeypatch, whole):
    monkeypatch.setattr(sketch, "WHOLE", whole)
    spec = SketchSpec(n=9, ksize=3, piece=50)
    text = sets(spark, {f"s{i}": [dna(rng, 200), "acNgt" * i] for i in range(4)} | {"none": "NN"})
    listed = sketch.bottom_n(text, SketchSpec(n=40, ksize=3)).where("slot % 3 = 0").select("h").localCheckpoint()
    near = sketch.bottom_n(text, spec, hash_list=listed)
    assert "MapInArrow" in plan_of(near)
    rows = sorted(map(tuple, near.collect()))
    assert rows == sorted(map(tuple, sketch.bottom_n(text, spec, hash_list=[r["h"] for r in listed.collect()]).collect()))
    nulls = sketch.bottom_n(text, spec, hash_list=spark.createDataFrame([(None,)], "h bigint"))
    assert nulls.count() == 0
    monkeypatch.setattr(sketch, "BROADCAST_ROWS", 1)
    far = sketch.bottom_n(text, spec, hash_list=listed)
    assert "MapInArrow" not in plan_of(far) and sorted(map(tuple, far.collect())) == rows and len(rows) > 20


def test_short_ranges_share_a_task(spark, rng, tmp_path):
    records = [(f"r{i}", dna(rng, 900)) for i in range(30)]
    (tmp_path / "a.fa").write_text("".join(f">{h}\n{s}\n" for h, s in records))
    rows = ranges.read_ranges(spark, str(tmp_path / "a.fa"), 4, 64, 20)
    assert rows.rdd.getNumPartitions() < 40
    assert rows.select("start").distinct().count() > 350
    assert {(r["record"], r["seq"]) for r in ranges.whole_records(rows).collect()} == set(records)
