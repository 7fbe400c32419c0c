import pytest
from pyspark.sql import functions as F

from sketchloom.operators import blocks, cluster, lookup, maintenance, membership, similarity, simjoin, sketch
from sketchloom.operators.sketch import SketchSpec
from tests.conftest import dna, entries_of, flip, grams, sets

SEQ1 = "tacgactgatgcatgatcgaactgatgcactcgtgatgc"
SEQ3 = "ttgatactcaatccgcatgcatgcatgacgatgcatgatgtacgactgatgcatgatcgaactgatgcactcgtgatgczxerqwewdfhg"


def by_name(frame, *columns):
    return {r["name"]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in frame.collect()}


def table(entries):
    return sorted((r["name"], r["slot"], r["h"], r["cnt"], r["kmer"]) for r in entries.collect())


def split(entries, name):
    return entries.where(F.col("name") == name), entries


def test_bottom_n_is_the_smallest_distinct_hashes(spark, rng):
    data = {f"s{i}": [dna(rng, rng.randrange(1, 80)) + "N" + "AC" * 20 for _ in range(3)] for i in range(6)}
    spec = SketchSpec(n=9, ksize=4, prime=101, piece=13)
    got = table(sketch.bottom_n(sets(spark, data), spec))
    every = sorted({g for parts in data.values() for p in parts for g in grams(p, 4) if set(g) <= set("ACGT")})
    frame = spark.createDataFrame([(g,) for g in every], "kmer string")
    hashed = {r["kmer"]: r["h"] for r in frame.select("kmer", spec.hashed(F.col("kmer"))["h"].alias("h")).collect()}
    expected = []
    for name, parts in data.items():
        found = {}
        for g in (g for p in parts for g in grams(p, 4) if g in hashed):
            found.setdefault(hashed[g], []).append(g)
        for slot, h in enumerate(sorted(found)[:9]):
            expected.append((name, slot, h, len(found[h]), min(found[h])))
    assert got == sorted(expected)
    assert got == table(sketch.bottom_n(sets(spark, data), SketchSpec(n=9, ksize=4, prime=101)))
    lower = {n: [p.lower() for p in parts] for n, parts in data.items()}
    assert got == table(sketch.bottom_n(sets(spark, lower), spec))
    parts = sketch.bottom_n(sets(spark, {f"{n}/{i}": p for n, ps in data.items() for i, p in enumerate(ps)}), spec)
    merged = sketch.merge_sketches(parts.withColumn("name", F.split("name", "/")[0]), 9)
    assert got == table(merged)
    assert table(sketch.down_sample(sketch.bottom_n(sets(spark, data), spec), 4)) == [r for r in got if r[1] < 4]


def test_strand_choice(spark, rng):
    text = dna(rng, 200)
    spec = SketchSpec(n=500, ksize=7, both_strands=True)
    forward = table(sketch.bottom_n(sets(spark, {"a": text}), spec))
    assert forward == table(sketch.bottom_n(sets(spark, {"a": flip(text)}), spec))


def test_hash_list(spark):
    text = sets(spark, {"a": "acgtagtctagtctacgtagtcgttgtattataaaatcgtcgtagctagtgctat"})
    spec = SketchSpec(n=5, ksize=3)
    full = sketch.bottom_n(text, spec)
    keep = [r["h"] for r in full.where("slot < 2").collect()]
    as_list = sketch.bottom_n(text, spec, hash_list=keep)
    as_frame = sketch.bottom_n(text, spec, hash_list=full.where("slot < 2").select("h"))
    assert table(as_list) == table(as_frame) == table(full.where("slot < 2"))
    assert by_name(similarity.jaccard(full, as_list, 5), "jaccard") == {"a": 0.4}
    assert by_name(similarity.jaccard_count(full, as_list, 5), "share_of_other") == {"a": 1.0}
    assert table(sketch.bottom_n(text, spec, hash_list=[])) == table(full)
    assert table(sketch.bottom_n(text, spec, hash_list=full.where("false").select("h"))) == table(full)


def test_hand_values(spark):
    pairs = entries_of(spark, {"a": [1, 2, 3, 4, 5], "b": [1, 2, 3, 4, 6], "c": [1, 2, 3, 4]})
    assert by_name(similarity.jaccard(*split(pairs, "a"), 5), "jaccard") == {"a": 1.0, "b": 0.8, "c": 0.8}
    assert by_name(similarity.jaccard(*split(pairs, "c"), 4), "jaccard") == {"a": 1.0, "b": 1.0, "c": 1.0}
    for left, right, count in (([1, 3, 5], [2, 4, 6], 0), ([1, 3, 5], [1, 2, 4, 6], 1), ([1, 3, 6], [1, 2, 6], 2)):
        both = entries_of(spark, {"l": left, "r": right})
        for focal, other in (("l", "r"), ("r", "l")):
            got = by_name(similarity.common(*split(both, focal), min(len(left), len(right))), "common")
            assert got[other] == count
    spec = SketchSpec(n=5, ksize=1, prime=9_999_999_967)
    few = sketch.bottom_n(sets(spark, {"one": "AAAAAAAA", "two": "AAAACCCCCCCC"}), spec)
    shares = ("share_of_other", "share_of_focal")
    assert by_name(similarity.jaccard_count(*split(few, "one"), 5), *shares)["two"] == (4 / 12, 1.0)
    assert by_name(similarity.jaccard_count(*split(few, "two"), 5), *shares)["one"] == (1.0, 4 / 12)
    assert by_name(similarity.jaccard(*split(few, "one"), 5), "jaccard")["two"] == 1.0
    assert by_name(similarity.jaccard(*split(few, "two"), 5), "jaccard")["one"] == 0.5
    vector = sketch.bottom_n(sets(spark, {"1": SEQ1, "2": SEQ1, "3": SEQ3}), SketchSpec(n=5, ksize=3))
    got = by_name(similarity.jaccard_vector(*split(vector, "1"), 5), "jaccard")
    assert got["1"] == got["2"] == 1.0 and 0 <= got["3"] <= 1
    assert by_name(similarity.count_vector(*split(vector, "1"), 5), "share")["2"] == 1.0
    assert by_name(similarity.jaccard_distance(*split(vector, "1"), 5), "distance")["2"] == 0.0


def two_pointer(x, y, limit):
    """The capped walk, restated over two sorted lists; yields positions of shared hashes in x."""
    i = j = passed = 0
    out = []
    while passed <= limit and i < len(x) and j < len(y):
        while i < len(x) and x[i] < y[j]:
            i, passed = i + 1, passed + 1
        if i == len(x):
            break
        while j < len(y) and x[i] > y[j]:
            j, passed = j + 1, passed + 1
        if j == len(y):
            break
        if x[i] == y[j]:
            out.append(i)
            i, j, passed = i + 1, j + 1, passed + 1
    return out


def random_sketches(rng, names=9, n=6, top=25):
    return {f"n{i}": {h: rng.randrange(1, 5) for h in rng.sample(range(top), rng.randrange(1, n + 1))} for i in range(names)}


def test_walks_and_matrix_against_a_restatement(spark, rng):
    data = random_sketches(rng)
    data["n9"] = data["n0"]
    entries = entries_of(spark, data).cache()
    hs = {n: sorted(c) for n, c in data.items()}
    for limit in (3, 6):
        for first in (True, False):
            got = by_name(similarity.capped_overlap(*split(entries, "n4"), limit, focal_first=first), "common")
            walk = (lambda o: two_pointer(hs["n4"], hs[o], limit)) if first else (lambda o: two_pointer(hs[o], hs["n4"], limit))
            assert got == {o: len(walk(o)) for o in hs}
    got = by_name(similarity.mash_jaccard(*split(entries, "n4"), 6), "jaccard")
    for other, value in got.items():
        union = sorted(set(hs["n4"]) | set(hs[other]))[:6]
        assert value == pytest.approx(len(set(union) & set(hs["n4"]) & set(hs[other])) / len(union))
    got = by_name(similarity.sketch_containment(*split(entries, "n4")), "containment")
    assert got == {o: pytest.approx(len(set(hs[o]) & set(hs["n4"])) / len(hs[o])) for o in hs}

    copies = by_name(blocks.distinct_sketches(entries), "representative")
    assert copies == {n: ("n0" if n == "n9" else n) for n in data}
    expected = {}
    for a in sorted(hs):
        for b in sorted(hs):
            if a <= b and "n9" not in (a, b):
                ij, ji = len(two_pointer(hs[a], hs[b], 6)), len(two_pointer(hs[b], hs[a], 6))
                if ij or ji:
                    expected[a, b] = (ij / len(hs[a]), ji / len(hs[b]))
    got = {(r["name_i"], r["name_j"]): (r["jaccard_ij"], r["jaccard_ji"]) for r in similarity.jaccard_matrix(entries, 6).collect()}
    assert got == expected
    rows = entries.where("name <> 'n9'")
    for block in (1, 2, 4):
        again = blocks.pair_table(rows, 9, 6, block=block).collect()
        assert {(r["name_i"], r["name_j"]): (r["common_ij"] / r["size_i"], r["common_ji"] / r["size_j"]) for r in again} == expected
    cells = similarity.jaccard_count_matrix(entries, 6).collect()
    assert cells
    for r in cells:
        a, b = r["name_i"], r["name_j"]
        met = [hs[b][at] for at in two_pointer(hs[b], hs[a], 6)]
        assert r["cell_ij"] == pytest.approx(sum(data[b][h] for h in met) / sum(data[b].values()))
        assert r["cell_ji"] == pytest.approx(sum(data[a][h] for h in met) / sum(data[a].values()))


def test_clusters(spark, rng):
    data = random_sketches(rng, names=14, n=6, top=60)
    data["z"] = dict(data["n3"])
    entries = entries_of(spark, data).cache()
    hs = {n: sorted(c) for n, c in data.items()}
    root = {n: n for n in data}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in hs:
        for b in hs:
            if len(two_pointer(hs[a], hs[b], 6)) / len(hs[a]) >= 0.3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    expected = {n: min(m for m in data if find(m) == find(n)) for n in data}
    for block in (2, 256):
        assert by_name(cluster.cluster_sketches(entries, 6, 0.3, block=block), "cluster") == expected
    pairs = similarity.jaccard_matrix(entries.where("name <> 'z'"), 6)
    heads = entries.where("name <> 'z'").select("name").distinct()
    expected.pop("z")
    assert by_name(cluster.cluster_pairs(heads, pairs, 0.3), "cluster") == expected


def test_components_of_a_long_chain_and_a_hub(spark):
    names = [f"{i:03d}" for i in range(70)]
    links = [(names[i], names[i + 1]) for i in range(40)] + [("050", n) for n in names[51:]]
    nodes = spark.createDataFrame([(n,) for n in names], "name string")
    got = by_name(cluster.components(nodes, spark.createDataFrame(links, "src string, dst string")), "cluster")
    assert got == {n: "000" if n <= "040" else ("050" if n >= "050" else n) for n in names}


def test_common_ancestors(spark):
    clusters = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "b"), ("d", "d"), ("e", "d")], "name string, cluster string")
    paths = {"a": "k|p|c", "b": "k|p|x", "c": "k|p|y", "d": "k|p", "e": "z|p"}
    taxonomy = spark.createDataFrame(list(paths.items()), "name string, path string")
    got = {r["cluster"]: (r["size"], r["lca"]) for r in cluster.common_ancestors(clusters, taxonomy).collect()}
    # d and e agree on the second level only; the deepest shared level counts.
    assert got == {"a": (1, "c"), "b": (2, "p"), "d": (2, "p")}
    apart = spark.createDataFrame([("d", "d"), ("f", "d")], "name string, cluster string")
    taxonomy = spark.createDataFrame([("d", "k|p"), ("f", "z")], "name string, path string")
    assert cluster.common_ancestors(apart, taxonomy).first()["lca"] == "sk__-1_microorganism"


def test_lookup(spark):
    entries = sketch.bottom_n(sets(spark, {"x": "ACGTACGA", "y": "ACGTT"}), SketchSpec(n=20, ksize=4))
    index = lookup.inverted_index(entries)
    assert sorted(r["name"] for r in lookup.find(index, "ACGT").collect()) == ["x", "y"]
    assert [r["name"] for r in lookup.find(index, "CGTT").collect()] == ["y"]
    with pytest.raises(ValueError):
        lookup.find(index, "ACG")
    with pytest.raises(ValueError):
        lookup.find(index.where("false"), "ACGT")
    asked = spark.createDataFrame([("ACGT",), ("ACGT",), ("GGGG",)], "kmer string")
    assert lookup.find_all(index, asked).count() == 2


def test_comparing_unlike_sketches_is_refused(spark):
    meta = spark.createDataFrame([("a", 3, 7), ("b", 4, 7)], "name string, ksize int, prime bigint")
    similarity.require_same(meta, "prime")
    with pytest.raises(ValueError, match="ksize"):
        similarity.require_same(meta, "ksize", "prime")


def test_maintenance(spark, tmp_path):
    from sketchloom.sources import sketchdb as store

    genomes = {"g1.fa": SEQ1.upper(), "g2.fa": SEQ3.upper(), "g3.fa": "ACGT" * 9}
    spec = SketchSpec(n=5, ksize=3)
    every = sets(spark, genomes)
    db = maintenance.build(every, spec, exact=True)
    path = str(tmp_path / "db")
    store.export_database(db, path)
    back = store.import_database(spark, path)
    assert table(back.entries) == table(db.entries)
    assert sorted(back.meta.collect()) == sorted(db.meta.collect())
    info = store.database_info(spark, path).first()
    assert (info["sketches"], info["ksize"], info["sketch_size"], info["prime"]) == (3, 3, 5, 9_999_999_999_971)
    picked = store.import_database(spark, path, ["/some/where/g2.fa"])
    assert by_name(picked.meta, "ksize") == {"g2.fa": 3}
    with pytest.raises(KeyError):
        store.import_database(spark, path, ["nope"])
    with pytest.raises(ValueError):
        store.export_database(maintenance.Database(db.meta.union(db.meta), db.entries), str(tmp_path / "twice"))

    store.delete_from(spark, path, ["x/g1.fa", "unknown"], str(tmp_path / "less"))
    less = store.import_database(spark, str(tmp_path / "less"))
    assert set(by_name(less.meta, "n")) == {"g2.fa", "g3.fa"}
    store.insert_into(spark, str(tmp_path / "less"), every, str(tmp_path / "more"), spec)
    more = store.import_database(spark, str(tmp_path / "more"))
    assert table(more.entries.where("name = 'g1.fa'")) == table(db.entries.where("name = 'g1.fa'"))
    assert more.meta.count() == 3
    store.union_of(spark, path, str(tmp_path / "less"), str(tmp_path / "all"))
    assert table(store.import_database(spark, str(tmp_path / "all")).entries) == table(db.entries)
    other = maintenance.build(every, SketchSpec(n=5, ksize=4))
    with pytest.raises(ValueError):
        maintenance.union(db, other)
    store.export_each(db, str(tmp_path / "each"))
    assert table(store.import_each(spark, str(tmp_path / "each")).entries) == table(db.entries)
    store.export_sketch(db, "g2.fa", str(tmp_path / "one"))
    assert table(store.import_database(spark, str(tmp_path / "one")).entries) == [r for r in table(db.entries) if r[0] == "g2.fa"]


def test_cardinality(spark, rng):
    data = {"a": dna(rng, 3000), "b": "ACGT" * 50, "c": "AC"}
    exact = by_name(sketch.describe(sets(spark, data), SketchSpec(ksize=11), exact=True), "true_num_kmers")
    assert exact == {n: len(set(grams(s, 11))) for n, s in data.items()}
    rough = by_name(sketch.describe(sets(spark, data), SketchSpec(ksize=11)), "true_num_kmers")
    assert all(abs(rough[n] - exact[n]) <= 0.03 * exact[n] for n in data)


def test_sketch_plan_limits_before_the_shuffle(spark, rng):
    plan = sketch.bottom_n(sets(spark, {"a": dna(rng, 50)}), SketchSpec())._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SortAggregate" not in plan.split("WindowGroupLimit")[-1]


def test_similarity_join_equals_the_matrix(spark, rng, monkeypatch):
    monkeypatch.setattr(simjoin, "LIST", 3)
    data = random_sketches(rng, names=40, n=8, top=70)
    data |= {f"hot{i}": {**{h: 1 for h in rng.sample(range(100, 130), 5)}, 7: 2} for i in range(12)} | {"copy": dict(data["n3"])}
    entries = entries_of(spark, data).cache()
    for limit in (4, 8):
        full = {(r["name_i"], r["name_j"]): r for r in blocks.pair_table(entries.where("name <> 'copy'"), 52, limit).collect()}
        for threshold in (0.05, 0.3, 0.5, 1.0):
            got = simjoin.similar_pairs(entries.where("name <> 'copy'"), limit, threshold).collect()
            wanted = {k: r for k, r in full.items() if max(r["common_ij"] / r["size_i"], r["common_ji"] / r["size_j"]) >= threshold}
            assert {(r["name_i"], r["name_j"]): r for r in got} == wanted and len(got) == len(wanted)
    for eps in (0.3, 0.6):
        expected = by_name(cluster.cluster_sketches(entries, 8, eps), "cluster")
        assert by_name(cluster.cluster_sketches(entries, 8, eps, joined=True), "cluster") == expected
    assert simjoin.similar_pairs(entries.where("false"), 8, 0.5).count() == 0
    with pytest.raises(ValueError):
        simjoin.similar_pairs(entries, 8, 0.0)


def test_pairs_that_meet_too_seldom_are_no_candidates(spark):
    data = {"a": [0, *range(100, 112), *range(1000, 1007)], "b": [0, *range(200, 212), *range(1010, 1017)]}
    data |= {f"f{i}": [100 + i, 200 + i, *range(2000 + 20 * i, 2018 + 20 * i)] for i in range(12)}
    data |= {"c": [*range(5000, 5012), *range(6000, 6008)], "d": [*range(5000, 5012), *range(7000, 7008)]}
    found = simjoin.candidate_pairs(simjoin.ranked(entries_of(spark, data)), 0.5).collect()
    assert [(r["small"], r["large"]) for r in found] == [("c", "d")]


def test_pairs_in_many_cells(spark, rng, monkeypatch):
    for name, value in (("HOME", 5), ("PAIRS", 7), ("SLAB", 40)):
        monkeypatch.setattr(simjoin, name, value)
    data = {f"s{i}": {1: 2} | {h: 1 + h % 3 for h in rng.sample(range(2, 40), 7)} for i in range(20)}
    entries = entries_of(spark, data)
    sets = similarity.as_sets(entries)
    ids = [r["id"] for r in simjoin.homes(sets).collect()]
    assert len(set(ids)) == 20 and len({i >> 32 for i in ids}) > 1
    full = {(r["name_i"], r["name_j"]): r for r in blocks.pair_table(entries, 20, 8).collect()}
    got = simjoin.similar_pairs(entries, 8, 0.3).collect()
    assert {(r["name_i"], r["name_j"]): r for r in got} == {k: r for k, r in full.items() if max(r["common_ij"], r["common_ji"]) >= 0.3 * 8} and len(got) > 30


@pytest.mark.parametrize("neutral", [False, True])
def test_a_small_sample_goes_to_the_sketches(spark, rng, monkeypatch, neutral):
    data = {f"s{i}": dna(rng, 60) for i in range(4)} | {"none": "NN"}
    sample = sets(spark, {"x": [data["s0"][:40] + "N" + flip(data["s1"]), dna(rng, 30), "ac"]})
    spec = SketchSpec(n=20, ksize=7)
    db = maintenance.build(sets(spark, data), spec, exact=True)
    tags, write = [], membership.materialize
    monkeypatch.setattr(membership, "materialize", lambda df, tag: tags.append(tag) or write(df, tag))
    ask = lambda: sorted(map(tuple, membership.query_membership(db.meta, db.entries, sample, spec, strand_neutral=neutral).collect()))
    small = ask()
    assert tags == ["entries", "sample"]
    monkeypatch.setattr(membership, "BROADCAST_ROWS", 5)
    assert ask() == small and "wanted" in tags


def test_cardinality_from_the_sketch_itself(spark, rng):
    data = {"big": dna(rng, 30_000), "small": dna(rng, 90), "none": "NNN"}
    spec = sketch.SketchSpec(n=400, ksize=15)
    db = maintenance.build_once(sets(spark, data), spec)
    counts = {r["name"]: r["true_num_kmers"] for r in db.meta.collect()}
    exact = {n: len(set(grams(s, 15))) if "N" not in s else 0 for n, s in data.items()}
    assert counts["small"] == exact["small"] and counts["none"] == 0
    assert abs(counts["big"] - exact["big"]) <= 5 * exact["big"] / 398**0.5
    # The sketch of two halves, merged, counts their union.
    cut = {"h": [data["big"][:16_000], data["big"][15_986:]]}
    halves = [sketch.bottom_n(sets(spark, {"h": x}), spec) for x in cut["h"]]
    merged = sketch.kmv_cardinality(sketch.merge_sketches(halves[0].unionByName(halves[1]), 400), spec).first()
    assert merged["true_num_kmers"] == counts["big"] and merged["error"] == pytest.approx(398**-0.5)


def test_additions_and_deletions_in_place(spark, tmp_path):
    import os

    from sketchloom.sources import sketchdb as store

    def listed(folder):
        found = {}
        for base, _, names in os.walk(folder):
            found.update({os.path.join(base, n): os.stat(os.path.join(base, n)).st_mtime_ns for n in names if n[0] not in "_."})  # markers aside
        return found

    spec, path = SketchSpec(n=5, ksize=3), str(tmp_path / "db")
    genomes = {"g1.fa": SEQ1.upper(), "g2.fa": SEQ3.upper()}
    more = {**genomes, "g3.fa": "ACGT" * 9, "g4.fa": "TTGACA" * 5}
    store.export_database(maintenance.build(sets(spark, genomes), spec, exact=True), path)
    before = listed(path)
    store.append_to(spark, path, sets(spark, more), spec)
    after = listed(path)
    # No old file changed, and what is new holds the new sketches alone.
    assert all(after[f] == at for f, at in before.items())
    fresh = sorted({f for f in after if f.endswith(".parquet") and "/entries/" in f} - set(before))
    assert {r["name"] for r in spark.read.parquet(*fresh).select("name").distinct().collect()} == {"g3.fa", "g4.fa"}
    whole = maintenance.build(sets(spark, more), spec, exact=True)
    assert table(store.import_database(spark, path).entries) == table(whole.entries)
    assert sorted(store.import_database(spark, path).meta.collect()) == sorted(whole.meta.collect())

    store.mark_deleted(spark, path, spark.createDataFrame([("x/g1.fa",), ("g3.fa",), ("unknown",), (None,)], "name string"))
    assert all(listed(path)[f] == at for f, at in after.items())
    left = store.import_database(spark, path)
    assert set(by_name(left.meta, "n")) == {"g2.fa", "g4.fa"} == {r["name"] for r in left.entries.select("name").distinct().collect()}
    store.append_to(spark, path, sets(spark, {"g1.fa": SEQ1.upper()}), spec)  # a deleted name comes back
    back = store.import_database(spark, path)
    assert table(back.entries.where("name = 'g1.fa'")) == table(whole.entries.where("name = 'g1.fa'"))
    with pytest.raises(KeyError):
        store.import_database(spark, path, ["g3.fa"])
    store.compact(spark, path, str(tmp_path / "compact"))
    assert table(store.import_database(spark, str(tmp_path / "compact")).entries) == table(back.entries)
    # An operation that is not in the log has not happened.
    added = maintenance.build(sets(spark, {"g9.fa": "ACGGT" * 4}), spec, exact=True)
    added.meta.write.parquet(f"{path}/later/000009-broken/meta")
    assert store.import_database(spark, path).meta.count() == 3
    # Several databases as one: deletions of one do not reach the other.
    other = str(tmp_path / "other")
    store.export_database(maintenance.build(sets(spark, {"g3.fa": "ACGT" * 9}), spec, exact=True), other)
    assert set(by_name(store.import_database(spark, [path, other]).meta, "n")) == {"g1.fa", "g2.fa", "g3.fa", "g4.fa"}


def test_hit_matrix_columns(spark, tmp_path):
    import random

    from sketchloom.sources import hitmatrix

    rng = random.Random(5)
    names = [f"s{k}" for k in range(40)]
    hits = {(rng.choice(names[:30]), rng.choice([4, 6]), rng.randrange(12)) for _ in range(300)}
    rows = spark.createDataFrame([*hits, *list(hits)[:9]], "name string, k int, slot int")
    every = spark.createDataFrame([(n,) for n in names], "name string")
    path = str(tmp_path / "matrix")
    hitmatrix.write_hit_matrix(rows, every, [4, 6], path, columns=8)
    assert sorted(map(tuple, hitmatrix.read_hit_matrix(spark, path).collect())) == sorted(hits)
    wanted = ["s3", "s39", "nobody"]
    assert sorted(map(tuple, hitmatrix.read_columns(spark, path, wanted).collect())) == sorted(h for h in hits if h[0] in wanted)
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    assert sorted((b.k, n) for b in blocks for n in b.names) == sorted((k, n) for k in (4, 6) for n in names)
    for b in blocks:
        assert len(b.pointers) == len(b.names) + 1 and b.pointers[0] == 0 and b.pointers[-1] == len(b.rows)
        for at, name in enumerate(b.names):
            own = b.rows[b.pointers[at] : b.pointers[at + 1]]
            assert own == sorted(slot for n, k, slot in hits if (n, k) == (name, b.k))
    hitmatrix.write_hit_matrix(rows.limit(0), every.limit(0), [4], str(tmp_path / "none"))
    assert hitmatrix.read_hit_matrix(spark, str(tmp_path / "none")).count() == 0
