import statistics

import pytest
from pyspark.sql import functions as F

from sketchloom.functions.seq import fast_hash
from sketchloom.operators import membership, maintenance, multik, postprocess, sketch, truth
from sketchloom.operators.sketch import SketchSpec
from sketchloom.session import materialize
from sketchloom.streaming import containment as streaming
from tests.conftest import dna, flip, grams, sets

KS = [3, 5, 7]


def make(spark, rng, n=12):
    parent = dna(rng, 60)
    data = {f"g{i}": parent[i * 5 : i * 5 + 30] + dna(rng, 15) for i in range(5)}
    data["tiny"] = "ACGTACG"
    reads = [parent[10:35], flip(parent[20:60]), dna(rng, 40), "ACNGT" + parent[:12].lower()]
    entries = materialize(sketch.bottom_n(sets(spark, data), SketchSpec(n=n, ksize=7)), "t")
    return data, reads, entries, sets(spark, {"q": reads})


def restated_matches(entries, reads, ks):
    """(name, k, slot) by the letter of the rule: forward if any, else the other strand, behind the gate."""
    rows = [(r["name"], r["slot"], r["kmer"]) for r in entries.collect()]
    keys = [(t, n, s) for n, s, kmer in rows for t in (kmer, flip(kmer))]
    first = ks[0]
    gate = {x for t, _, _ in keys for x in (t[:first], flip(t[:first]))}
    out = set()
    for read in (r.upper() for r in reads):
        for i in range(len(read) - first + 1):
            if read[i : i + first] not in gate:
                continue
            for k in ks:
                q = read[i : i + k]
                if len(q) == k:
                    found = [(n, k, s) for t, n, s in keys if t[:k] == q] or [(n, k, s) for t, n, s in keys if t[:k] == flip(q)]
                    out.update(found)
    return out


def test_multi_k_matches_and_containment(spark, rng):
    data, reads, entries, sample = make(spark, rng)
    expected = restated_matches(entries, reads, KS)
    index, lookup = multik.prepare(entries, KS, 7)
    assert lookup.groupBy("k", "query").count().where("count > 1").isEmpty()
    found = materialize(multik.matches(sample, index, lookup, KS), "m")
    got = {(r["name"], r["k"], r["slot"]) for r in found.collect()}
    assert got == expected
    once = multik.matches_once(sample, entries, KS).collect()
    assert {(r["name"], r["k"], r["slot"]) for r in once} == expected
    kmers = {}
    for r in entries.collect():
        kmers.setdefault(r["name"], {})[r["slot"]] = r["kmer"]
    results = multik.containment(found, entries, KS)
    for r in results.collect():
        matched = {kmers[n][s][: r["k"]] for n, k, s in expected if (n, k) == (r["name"], r["k"])}
        every = {x[: r["k"]] for x in kmers[r["name"]].values()}
        assert (r["hits"], r["denom"]) == (len(matched), len(every)) and 0 <= r["ci"] <= 1
    upper = multik.matches(sets(spark, {"q": [x.upper() for x in reads]}), index, lookup, KS)
    assert sorted(upper.collect()) == sorted(found.collect())
    # Every indexed prefix and its other strand are in the prefilter.
    pre = {(r["k"], r["prefix"]) for r in multik.prefilter(index).collect()}
    assert all((k, x) in pre for some in kmers.values() for m in some.values() for k in KS for x in (m[:k], flip(m[:k])))
    frame = multik.select_results(multik.wide(results, KS), KS, 0.2, location=0)
    assert frame.columns == ["name", "k=3", "k=5", "k=7"]
    rows = frame.collect()
    assert all(r["k=3"] >= 0.2 for r in rows)
    assert rows == sorted(rows, key=lambda r: (-r["k=7"], r["name"]))


def test_specific_mode(spark, rng):
    data, reads, entries, sample = make(spark, rng)
    found = materialize(multik.matches_once(sample, entries, KS), "m")
    chosen = spark.createDataFrame([("g0",), ("g1",), ("tiny",)], "name string")
    some = postprocess.selected_entries(entries, chosen)
    kmers = {}
    for r in some.collect():
        kmers.setdefault(r["name"], []).append(r["kmer"])
    counts = {}
    for own in kmers.values():
        for m in own:
            for k in KS:
                counts[m[:k]] = counts.get(m[:k], 0) + 1
    hits = {(r["name"], r["k"], r["prefix"]) for r in multik.hits(found).collect()}
    meta = some.select("name").distinct().withColumn("n", F.lit(12))
    got = {(r["name"], r["k"]): (r["hits"], r["denom"]) for r in postprocess.specific_containment(multik.hits(found), some, meta, KS).collect()}
    tally = {(r["name"], r["k"]): r["num_unique"] for r in postprocess.unique_tally(some, KS).collect()}
    for name, own in kmers.items():
        for k in KS:
            prefixes = {m[:k] for m in own}
            unique = {x for x in prefixes if counts[x] == 1}
            assert tally[name, k] == len(unique)
            assert got[name, k] == (len([x for x in unique if (name, k, x) in hits]), len(prefixes) + (len(own) < 12))


def test_stream_equals_batch(spark, rng, tmp_path):
    data, reads, entries, sample = make(spark, rng)
    index, lookup = multik.prepare(entries, KS, 7)
    arriving = str(tmp_path / "in")
    for part in (reads[:2], reads[1:], reads):  # overlapping micro-batches
        sets(spark, {"q": part}).coalesce(1).write.mode("append").parquet(arriving)
    stream = spark.readStream.schema("name string, seq string").option("maxFilesPerTrigger", 1).parquet(arriving)
    out = str(tmp_path / "out")
    streaming.start(stream, index, lookup, KS, out, str(tmp_path / "state")).awaitTermination()
    batch = multik.containment(multik.matches(sample, index, lookup, KS), entries, KS)
    assert sorted(streaming.current(out, entries, KS).collect()) == sorted(batch.collect())


@pytest.mark.parametrize("neutral", [False, True])
def test_membership(spark, rng, neutral):
    data, reads, _, sample = make(spark, rng)
    spec = SketchSpec(n=12, ksize=7)
    db = maintenance.build(sets(spark, data), spec, exact=True)
    key = (lambda x: min(x, flip(x))) if neutral else (lambda x: x)
    inside = {key(g) for r in reads for g in grams(r.upper(), 7) if set(g) <= set("ACGT")}
    mine = {}
    for r in db.entries.collect():
        mine.setdefault(r["name"], []).append(key(r["kmer"]))
    for training in (None, sets(spark, data)):
        kept = inside
        if training is not None:
            kept = inside & {key(g) for s in data.values() for g in grams(s, 7)}
        got = membership.query_membership(db.meta, db.entries, sample, spec, neutral, training).collect()
        assert len(got) == len(data)
        for r in got:
            own = mine[r["name"]]
            count = sum(x in kept for x in own)
            size = len(set(grams(data[r["name"]], 7)))
            ratio = count / len(own)
            assert r["intersection"] == count and r["containment index"] == pytest.approx(ratio)
            assert r["jaccard index"] == pytest.approx(min(max(size * ratio / (size + len(kept) - size * ratio), 0), 1))
    table = membership.above(spark.createDataFrame(got), 0.1).collect()
    assert [r["name"] for r in table] == [
        r["name"] for r in sorted(got, key=lambda r: (-r["containment index"], r["name"])) if r["containment index"] > 0.1
    ]


def test_membership_beyond_the_broadcast_bound(spark, rng, monkeypatch):
    data, reads, entries, sample = make(spark, rng)
    spec = SketchSpec(n=12, ksize=7)
    grams_of = membership.sample_grams(sample, spec)
    near = sorted(membership.sketch_hits(entries, grams_of, spec).collect())
    found = sorted(multik.matches_once(sample, entries, KS).collect())
    monkeypatch.setattr(membership, "BROADCAST_ROWS", 1)
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(membership.sketch_hits(entries, grams_of, spec).collect()) == near
        assert sorted(multik.matches_once(sample, entries, KS).collect()) == found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def test_all_lengths_follow_from_the_neighbour(spark, rng):
    """Queries of several lengths inside each other, windows that end early, letters that are no base."""
    ks = [2, 3, 5]
    texts = {dna(rng, k) for k in ks for _ in range(14)} | {"AC", "ACG", "ACGTA", "ACGTT", "NNACG", "TT"}
    lookup = multik._chained(spark.createDataFrame([(len(x), x, x + "!") for x in texts], "k int, query string, target string"))
    spans = {dna(rng, n) for n in (2, 3, 4, 5) for _ in range(30)} | {"ACGTN", "ACG", "NNACG", "AC", "ZZ", "TTTTT"}
    table = spark.createDataFrame([(x[:2], x) for x in spans], "gate string, span string")
    for some in (ks, [2, 5]):
        got = {(r["k"], r["key"]) for r in multik.targets_of(table, lookup, some).collect()}
        assert got == {(k, x[:k] + "!") for x in spans for k in some if len(x) >= k and x[:k] in texts}


def test_false_hits_are_taken_off(spark):
    meta = spark.createDataFrame([("a", 10, 100)], "name string, n int, true_num_kmers bigint")
    entries = spark.createDataFrame([("a", f"k{i}") for i in range(8)], "name string, kmer string")
    hits = spark.createDataFrame([("k0",), ("k1",), ("k2",)], "kmer string")
    row = membership.membership(meta, entries, hits, 50, fp_rate=0.2).first()
    assert row["intersection"] == 1 and row["containment index"] == pytest.approx(1 / 8)


def test_truth_and_errors(spark, rng):
    data, reads, _, sample = make(spark, rng)

    def canon(text, k):
        return {min(g, flip(g)) for g in grams(text.upper(), k) if set(g) <= set("ACGT")}

    training = truth.distinct_shingles(sets(spark, data), KS, piece=11)
    query = truth.distinct_shingles(sample, KS)
    exact = truth.true_containment(training, query)
    got = {(r["name"], r["k"]): (r["hits"], r["denom"]) for r in exact.collect()}
    asked = {k: set().union(*(canon(r, k) for r in reads)) for k in KS}
    assert got == {(n, k): (len(canon(s, k) & asked[k]), len(canon(s, k))) for n, s in data.items() for k in KS}
    assert truth.intersection(training, query).where("k = 5").count() == len(asked[5] & set().union(*(canon(s, 5) for s in data.values())))


@pytest.mark.parametrize("size", [1, 2, 7, 400, 1001])
def test_exact_median(spark, rng, size):
    values = [rng.choice([0.0, 0.0, rng.random()]) for _ in range(size)]
    other = [rng.random() for _ in range(size)]
    frame = spark.createDataFrame([(1, v) for v in values] + [(2, v) for v in other], "k int, v double")
    got = {r["k"]: r["median"] for r in truth.exact_median(frame, "k", "v").collect()}
    assert got == {1: pytest.approx(statistics.median(values)), 2: pytest.approx(statistics.median(other))}


def test_error_statistics(spark):
    est = spark.createDataFrame([("a", 3, 0.5), ("b", 3, 0.2)], "name string, k int, ci double")
    ref = spark.createDataFrame([("a", 3, 0.25), ("b", 3, 0.3)], "name string, k int, ci double")
    row = truth.error_statistics(est, ref).first()
    assert (row["total"], row["mean"], row["median"]) == (pytest.approx(0.35), pytest.approx(0.175), pytest.approx(0.175))


def test_no_cartesian_products(spark, rng):
    data, reads, entries, sample = make(spark, rng)
    index, lookup = multik.prepare(entries, KS, 7)
    frames = [multik.matches(sample, index, lookup, KS), membership.sketch_hits(entries, membership.sample_grams(sample, SketchSpec(ksize=7, hasher=fast_hash)), SketchSpec(ksize=7))]
    for frame in frames:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan


def left_side(plan):
    """The plan's lines under the left input of its sort-merge join."""
    lines = plan.split("\n")
    top = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    depth = lines[top + 1].index(":-")
    end = next(i for i in range(top + 2, len(lines)) if lines[i][depth : depth + 2] == "+-")
    return lines[top + 1 : end]


def test_stored_index_is_joined_in_its_buckets(spark, rng, tmp_path):
    data, reads, entries, sample = make(spark, rng)
    index, lookup = multik.prepare(entries, KS, 7)
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        targets = materialize(multik.targets_of(multik.sample_windows(sample, KS), lookup, KS), "t")
        found = multik.entries_at(index, targets)
        side = left_side(found._jdf.queryExecution().executedPlan().toString())
        assert any("Bucketed: true" in line for line in side)
        assert not any("Exchange" in line for line in side)
        assert sorted(found.drop("salt").collect()) == sorted(multik.entries_at(index.drop("salt"), targets).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
