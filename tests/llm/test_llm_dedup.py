"""Byte dedup and near dedup against brute force."""

import hashlib
from collections import Counter

import llm_cases as cases
import numpy as np
import pyarrow as pa
import pytest

from sketchloom.llm import neardup, suffix_dedup, textops


def removed_by_brute_force(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, dtype=np.uint8)[~gone])).hexdigest()))
    return out


def test_difference_cover():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
    assert suffix_dedup.TRIPLE <= suffix_dedup.LENGTH - suffix_dedup.PERIOD + 1
    assert suffix_dedup.LONG >= suffix_dedup.LENGTH + suffix_dedup.PERIOD - 1


def test_byte_dedup(spark):
    rng = cases.rng()
    long = cases.prose(rng, 120)
    # Passages of 199, 200 and 201 bytes, of a length between the names' lengths, across ids and inside one text.
    more = [long[:199] + " end", "begin " + long[:199], "p " + long[300:500], long[300:500] + " q", cases.prose(rng, 9) + long[100:380], long[100:380] + "zz" + long[100:380]]
    rows = [(k, t) for k, t in enumerate(cases.texts(rng) + more)] + [(None, long), (7, long[:450])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = suffix_dedup.deduplicated(docs).collect()
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == sorted(removed_by_brute_force([t for _, t in rows]))
    for r in found:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert sum(b - a for a, b in r.spans) == r.n_removed and len(r.spans) == r.n_spans


def test_byte_dedup_of_copies_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1500)
    rng = cases.rng()
    one = cases.prose(rng, 150)
    texts = [one] * 60 + [one[:400] + cases.prose(rng, 30) + one[350:] for _ in range(20)] + [cases.prose(rng, 90) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(docs, texts=False).collect()}
    assert [got[k] for k in range(len(texts))] == removed_by_brute_force(texts)


def shingle_set(text):
    words = cases.SPACED.findall((text or "").translate(cases.LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def components_by_brute_force(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[top(x)] = top(y)
    least = {}
    for k, (i, s) in enumerate(sets):
        least[top(k)] = min(i, least.get(top(k), i))
    return {i: (len(s), least[top(k)]) for k, (i, s) in enumerate(sets)}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup(spark, seed):
    rng = cases.rng()
    rng.seed(seed)
    base = cases.prose(rng, 90).split(" ")
    chain = []
    for _ in range(40):
        base = list(base)
        base[rng.randrange(len(base))] = cases.prose(rng, 1)
        chain.append(" ".join(base))
    rng.shuffle(chain)
    edited = [" ".join(cases.prose(rng, 1) if rng.random() < share else w for w in base) for share in (0.01, 0.02, 0.03, 0.05, 0.08) for _ in range(12)]
    rows = list(enumerate(cases.texts(rng) + chain + edited))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in neardup.components(docs).collect()}
    assert got == components_by_brute_force(rows)


def test_near_dedup_cases(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(5, text), (5, text), (3, text), (None, text), (8, None), (9, ""), (1, "alone here"), (2, "ALONE  here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as node", "'x' as row", "2 as rows")
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in neardup.components(docs).collect()), key=str)
    assert got == sorted([(5, 12, 3), (5, 12, 3), (3, 12, 3), (None, 12, None), (8, 0, 8), (9, 0, 9), (1, 1, 1), (2, 1, 1)], key=str)
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, None, 8, 9, 1], key=str)
    assert neardup.deduplicated(docs.limit(0)).count() == 0 and suffix_dedup.deduplicated(docs.limit(0)).count() == 0


def test_near_dedup_of_ids_with_several_texts(spark):
    first, second, third = (" ".join(f"{c}{k}" for k in range(40)) for c in "abc")
    rows = [(5, first), (5, second), (5, second), (5, second + " end"), (7, first + " end"), (7, third), (3, third + " end"), (9, None), (9, ""), (9, "one two")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as label", "'x' as digest").repartition(3)
    kept = neardup.deduplicated(docs)
    got = sorted((r.doc_id, r.text or "") for r in kept.collect())
    # Both texts of 5 stay, one row of each component; of 7 nothing, as its texts are near 5 and 3.
    assert kept.columns == docs.columns and [i for i, _ in got] == [3, 5, 5, 9, 9]
    assert (5, first) in got and [t for i, t in got if i == 5 and t.startswith("b")] and (9, "one two") in got
    rows = [(1, first), (2, first + " end"), (2, second)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in neardup.deduplicated(docs).collect()) == [(1, first), (2, second)]


def test_elected_entry_does_not_depend_on_arrival():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    rows = []
    for group, block in ((0, 0), (0, 1), (1, 0), (2, 3)):
        names = np.sort(rng.choice(pool, 20, replace=False))
        rows.append({"grp": group, "block": block, "bucket": 7, "names": textops.planes(names), "flags": np.packbits(names % 5 == 0).tobytes() if block else b""})
    schema = pa.schema([("grp", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary()), ("flags", pa.binary())])

    def bits(some):
        return {(r["grp"], r["block"]): (r["bucket"], r["bits"]) for r in suffix_dedup.answered(pa.Table.from_pylist(some, schema)).to_pylist()}

    assert bits(rows) == bits(rows[::-1]) == bits([rows[k] for k in (2, 0, 3, 1)])


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(3)
    for share in (0.3, 0.75, 0.95):
        common = rng.integers(0, 1 << 63, int(4000 * share), dtype=np.uint64)
        own = [rng.integers(0, 1 << 63, (4000 - len(common)) // 2, dtype=np.uint64) for _ in range(2)]
        sets = [np.sort(np.concatenate([common, o])) for o in own]
        _, packed = neardup.signatures(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        row = {f"s{k}": int(packed[0, k].view(np.int64)) for k in range(4)} | {f"h_s{k}": int(packed[1, k].view(np.int64)) for k in range(4)}
        value = spark.createDataFrame([row]).select(neardup.estimate("", "h_").alias("e")).first().e
        assert abs(value - share) < 0.16


def test_planes_round_trip():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (textops.from_planes(textops.planes(values)) == values).all()
    assert len(textops.from_planes(textops.planes(values[:0]))) == 0
