"""Super-k-mers against plain shingles."""

from collections import Counter

import numpy as np
import pytest
from conftest import dna, flip, grams, sets

from sketchloom.operators import superkmers


def canon(text, k):
    return [min(g, flip(g)) for g in grams(text.upper(), k) if set(g) <= set("ACGT")]


def random_sets(rng):
    data = {f"s{i}": [dna(rng, rng.randrange(0, 260)) for _ in range(3)] for i in range(8)}
    data["s1"][0] = data["s0"][1][:90] + "n" + flip(data["s0"][2]) if data["s0"][2] else "ACGT"
    data["repeat"] = ["A" * 400, "ac" * 150, "T" * 33]
    data |= {"none": "NNNN", "empty": "", "odd": ["éACGTACGTTGé" * 9, "acgtn-ACGGTCA"], "short": "AC", "twice": [data["s2"][0], data["s2"][0]]}
    return data


@pytest.mark.parametrize("limit", [1 << 22, 40])
def test_statistics_and_containment_equal_plain_counts(spark, rng, monkeypatch, limit):
    monkeypatch.setattr(superkmers, "BIN", limit)
    data, ks = random_sets(rng), [1, 3, 9, 21, 32]
    records = lambda some: [some] if isinstance(some, str) else some
    sample = {"q": [data["s0"][0], "A" * 50, data["s3"][1]], "r": [flip(data["s4"][2] or "A")]}
    counts = {(n, k): Counter(g for r in records(s) for g in canon(r, k)) for n, s in data.items() for k in ks}
    asked = {k: {g for s in sample.values() for r in s for g in canon(r, k)} for k in ks}
    got = superkmers.statistics(sets(spark, data), ks, piece=50).collect()
    assert {(r["name"], r["k"]): (r["total"], r["distinct"], r["single"]) for r in got} == {
        x: (sum(c.values()), len(c), sum(v == 1 for v in c.values())) for x, c in counts.items() if c
    }
    exact = superkmers.containment(sets(spark, data), sets(spark, sample), ks, piece=64).collect()
    assert {(r["name"], r["k"]): (r["hits"], r["denom"]) for r in exact} == {x: (len(set(c) & asked[x[1]]), len(c)) for x, c in counts.items() if c}
    assert superkmers.statistics(sets(spark, data).where("false"), ks).count() == 0
    with pytest.raises(ValueError):
        superkmers.statistics(sets(spark, data), [33])


def test_runs_hold_every_shingle_once(rng):
    text = dna(rng, 500) + "N" + dna(rng, 5) + "N" + "A" * 80
    bases = superkmers.CODE[np.frombuffer(text.encode(), dtype=np.uint8)]
    for k in (7, 21):
        starts, many, least = superkmers.runs_of(bases, np.ones(len(bases), dtype=bool), k, 7)
        held = [text[a + i : a + i + k] for a, n in zip(starts, many) for i in range(n)]
        assert held == [g for g in grams(text, k) if "N" not in g]
        back = superkmers.CODE[np.frombuffer(flip(text.replace("N", "A")).encode(), dtype=np.uint8)]
        assert k < 21 or len(starts) * 3 < len(held) and len(back) == len(bases)
