import itertools
import math
import random

import pytest

from sketchloom.operators import linkage as L

from conftest import entries_of


def by_brute_force(names, d, method, absent):
    """The nearest pair of all merged, one at a time, from distances of members (Ward: from its update formula)."""
    groups = {n: [n] for n in names}
    table = {pair: d.get(pair, absent) for pair in itertools.combinations(sorted(names), 2)}
    of = lambda a, b: table[min(a, b), max(a, b)]
    merges = []
    while len(groups) > 1:
        pair = min(itertools.combinations(sorted(groups), 2), key=lambda p: (of(*p), p))
        height = of(*pair)
        if absent is not None and height >= absent:
            break
        a, b = pair
        na, nb = len(groups[a]), len(groups[b])
        for k in groups:
            if k in pair:
                continue
            da, db, nk = of(a, k), of(b, k), len(groups[k])
            if method == "single":
                new = min(da, db)
            elif method == "complete":
                new = max(da, db)
            elif method == "average":
                new = (na * da + nb * db) / (na + nb)
            else:
                new = math.sqrt(((na + nk) * da * da + (nb + nk) * db * db - nk * height * height) / (na + nb + nk))
            table[min(a, k), max(a, k)] = new
        groups[a] = groups[a] + groups.pop(b)
        merges.append((a, b, height, len(groups[a])))
    return merges


def same(found, wanted):
    found, wanted = (sorted(rows, key=lambda r: r[1]) for rows in (found, wanted))
    assert [(a, b, n) for a, b, _, n in found] == [(a, b, n) for a, b, _, n in wanted]
    assert [h for _, _, h, _ in found] == pytest.approx([h for _, _, h, _ in wanted], abs=1e-9)


def rows_of(df):
    return [tuple(r) for r in df.select("left", "right", "height", "size").collect()]


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_sparse_linkage_equals_merging_one_pair_at_a_time(spark, method):
    rng = random.Random(11)
    names = [f"s{k:02d}" for k in range(18)]
    d = {pair: rng.random() * 0.9 for pair in itertools.combinations(names, 2) if rng.random() < 0.4}
    rows = [(b, a, v) if rng.random() < 0.5 else (a, b, v) for (a, b), v in d.items()]
    found = L.linkage(spark.createDataFrame(rows, "a string, b string, d double"), method, 1.0)
    same(rows_of(found), by_brute_force(names, d, method, 1.0))


def test_weights_are_copies_at_height_zero(spark):
    d = {("a", "b"): 0.2, ("b", "c"): 0.3, ("a", "c"): 0.8}
    pairs = spark.createDataFrame([(a, b, v) for (a, b), v in d.items()], "a string, b string, d double")
    weights = spark.createDataFrame([("a", 3)], "name string, n bigint")
    found = {r[1]: r for r in rows_of(L.linkage(pairs, "average", 1.0, weights))}
    assert found["b"] == ("a", "b", pytest.approx(0.2), 4) and found["c"] == ("a", "c", pytest.approx((3 * 0.8 + 0.3) / 4), 5)


def test_linkage_of_sketches_with_copies(spark):
    hashes = {"a": [1, 2, 3, 4], "a2": [1, 2, 3, 4], "b": [1, 2, 3, 5], "c": [7, 8, 9, 10], "d": [7, 8, 11, 12]}
    merges, groups = L.sketch_linkage(entries_of(spark, hashes), 4, 0.1)
    found = {(a, b): n for a, b, _, n in rows_of(merges)}
    assert found == {("a", "b"): 3, ("c", "d"): 2}
    assert {r.name: r.representative for r in groups.collect()}["a2"] == "a"


def test_ward_linkage_of_points(spark):
    rng = random.Random(12)
    points = {f"p{k:02d}": (rng.random(), rng.random(), rng.random()) for k in range(14)}
    d = {(a, b): math.dist(points[a], points[b]) for a, b in itertools.combinations(sorted(points), 2)}
    pairs = spark.createDataFrame([(a, b, v) for (a, b), v in d.items()], "a string, b string, d double")
    same(rows_of(L.linkage(pairs, "ward", None)), by_brute_force(list(points), d, "ward", None))
    with pytest.raises(ValueError):
        L.linkage(pairs.limit(20), "ward", None)


def test_ties_repeated_and_useless_pairs(spark):
    rows = [("a", "b", 0.5), ("b", "a", 0.25), ("b", "c", 0.25), ("c", "d", 0.25), ("d", "d", 0.0), ("e", "f", 1.0), ("f", "a", None)]
    pairs = spark.createDataFrame(rows, "a string, b string, d double")
    found = rows_of(L.linkage(pairs, "single"))
    assert sorted(h for _, _, h, _ in found) == [0.25] * 3 and max(n for *_, n in found) == 4
    assert sorted(rows_of(L.linkage(pairs, "single"))) == sorted(found)
    assert L.linkage(pairs.limit(0), "average").count() == 0
    with pytest.raises(ValueError):
        L.linkage(pairs, "median")
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "name string")
    cut = {r.name: r.cluster for r in L.cut(nodes, L.linkage(pairs, "single"), 0.3).collect()}
    assert cut == {"a": "a", "b": "a", "c": "a", "d": "a", "e": "e", "f": "f"}


def test_single_linkage_of_chains_and_ties_takes_no_rounds(spark, monkeypatch):
    rng = random.Random(13)
    names = [f"s{k:02d}" for k in range(26)]
    order = rng.sample(names, len(names))
    d = {(min(a, b), max(a, b)): 0.5 for a, b in zip(order, order[1:])}
    d |= {pair: rng.choice([0.25, 0.5, 0.75]) for pair in itertools.combinations(names, 2) if rng.random() < 0.06}
    pairs = spark.createDataFrame([(a, b, v) for (a, b), v in d.items()], "a string, b string, d double").repartition(5)
    written, write = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, tag: written.append(tag) or write(df, tag))
    same(rows_of(L.linkage(pairs, "single", 1.0)), by_brute_force(names, d, "single", 1.0))
    assert "linkage-nearest" not in written and written.count("linkage-merges") == 1
