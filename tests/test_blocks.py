import math

import numpy as np
import pytest

from sketchloom.operators import blocks, cluster, similarity, sketch

from conftest import entries_of


def walked(one, two, limit):
    """Shared hashes that the walk over both lists reaches, round by round."""
    i = j = passed = 0
    out = []
    while i < len(one) and j < len(two) and passed <= limit:
        while i < len(one) and j < len(two) and one[i] < two[j]:
            i, passed = i + 1, passed + 1
        while i < len(one) and j < len(two) and two[j] < one[i]:
            j, passed = j + 1, passed + 1
        if i < len(one) and j < len(two) and one[i] == two[j]:
            out.append(one[i])
            i, j, passed = i + 1, j + 1, passed + 1
    return out


def sketches(rng, many, scale=1):
    data = {f"n{i:02d}": {h * scale: rng.randrange(1, 4) for h in rng.sample(range(1, 60), rng.randrange(1, 12))} for i in range(many)}
    return data | {f"near{i}": {**{h * scale: 1 for h in range(70, 78)}, (90 + i) * scale: 1} for i in range(6)}


@pytest.mark.parametrize("scale", [1, 1 << 55])
def test_pairs_of_blocks_equal_the_walk(spark, rng, scale, monkeypatch):
    monkeypatch.setattr(blocks, "MEETS", 50)
    data = sketches(rng, 24, scale)
    hs = {n: sorted(c) for n, c in data.items()}
    for threshold in (0.0, 0.4):
        expected = {}
        for a in sorted(hs):
            for b in sorted(hs):
                ij, ji = walked(hs[a], hs[b], 5), walked(hs[b], hs[a], 5)
                near = max(len(ij) / len(hs[a]), len(ji) / len(hs[b])) >= threshold if threshold else ij or ji
                if a <= b and near:
                    mass = lambda who, met: sum(data[who][h] for h in met)
                    expected[a, b] = (len(hs[a]), len(hs[b]), sum(data[a].values()), sum(data[b].values()), len(ij), mass(a, ij), mass(b, ij), len(ji), mass(a, ji), mass(b, ji))
        found = blocks.pair_table(entries_of(spark, data), len(data), 5, block=12, threshold=threshold).collect()
        assert len(found) == len(expected) and {(r[0], r[1]): tuple(r[2:]) for r in found} == expected


def test_sketches_are_not_sent_to_pairs_of_blocks(spark, rng):
    sets = sketch.as_sets(entries_of(spark, sketches(rng, 20))).localCheckpoint()
    for table in (blocks.pair_table(sets, 26, 8, block=4), blocks.link_table(sets, 26, 8, 0.3, block=9)):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()


def test_forests_stay_small_and_connect_all_blocks(spark, rng):
    data = sketches(rng, 30)
    entries = entries_of(spark, data).localCheckpoint()
    pairs = similarity.jaccard_matrix(entries, 8)
    nodes = entries.select("name").distinct()
    expected = sorted(map(tuple, cluster.cluster_pairs(nodes, pairs, 0.4).collect()))
    links = blocks.link_table(entries, len(data), 8, 0.4, block=12)
    assert sorted(map(tuple, cluster.components(nodes, links).collect())) == expected
    assert links.count() < 2 * len(data)


def test_hashes_beyond_the_keys_are_ranked():
    class Some(blocks.Block):
        def __init__(self, rows):
            self.raw = np.concatenate([np.array(r, dtype=np.int64) for r in rows])
            self.sizes = np.array([len(r) for r in rows])
            self.rows, self.hs, self.span, self.top = len(rows), self.raw, 0, int(self.raw.max())
            self.row = np.repeat(np.arange(len(rows)), self.sizes)

    one, two = Some([[1, 5 << 59], [2, 3]]), Some([[3, 5 << 59]])
    blocks.comparable(one, two)
    assert one.hs.tolist() == [0, 3, 1, 2] and two.hs.tolist() == [2, 3] and math.log2(one.span) < 4
