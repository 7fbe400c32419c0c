"""The pipeline stage by stage against brute force, and the robust estimates against plain numpy."""

import zlib
from collections import Counter

import corpus_pipeline
import llm_cases as cases
import numpy as np
from pyspark.sql import functions as F
from test_llm_dedup import components_by_brute_force
from test_llm_rules import decontam_words, good_text, hits_by_brute_force, statistics, windows_of

from sketchloom.llm import mixing, quality


def corpus(rng):
    rows = []
    for k in range(420):
        rows.append((k, good_text(rng, k), ["en", "fr"][k % 2], ["a", "b", None][k % 3]))
    junk = [(500 + k, " ".join(w.upper() + "!!" for w in good_text(rng, k).split(" ")), "en", "a") for k in range(12)]
    words = rows[0][1].split(" ")
    near = [(600 + k, " ".join("other" if i == 5 * k else w for i, w in enumerate(words)), "en", "b") for k in range(9)]
    copies = [(700 + k, rows[1][1], "fr", "a") for k in range(5)]
    odd = [(800, None, None, None), (801, "", "en", "a"), (802, "a b", None, "b")]
    passage = cases.prose(rng, 40)
    leaks = [(900 + k, rows[10 + k][1] + "\n" + passage + ". " + rows[40 + k][1], "en", "a") for k in range(4)] + [(910, passage + " " + cases.prose(rng, 20), "en", "a")]
    return rows + junk + near + copies + odd + leaks, [("x", passage), ("y", cases.prose(rng, 30)), ("z", None)]


def test_stages(spark, tmp_path):
    rng = cases.rng()
    rows, items = corpus(rng)
    folder = str(tmp_path)
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
    now, after = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        place = str(tmp_path / name)
        stage(spark, now, folder).write.parquet(place)
        now = spark.read.parquet(place)
        after[name] = now.collect()
        if name != "sharding":
            assert now.columns == docs.columns

    kept = {r.doc_id for r in after["quality"]}
    base = {i for i, text, *_ in rows if (s := statistics(text))[0] >= 50 and 100 * s[4] <= 50 * s[0]}
    assert kept <= base and not kept & set(range(500, 512)) and len(base & set(range(420)) - kept) <= 2
    assert kept == {r.doc_id for r in quality.accepted(docs.repartition(5)).select("doc_id").collect()}

    parts = components_by_brute_force([(r.doc_id, r.text) for r in after["quality"]])
    assert sorted(r.doc_id for r in after["near_dedup"]) == sorted({c for _, c in parts.values()})

    windows, clean = windows_of(items), {}
    for r in after["near_dedup"]:
        many, hit, _ = hits_by_brute_force(r.text, windows)
        if hit <= 0.5 * many:
            clean[r.doc_id] = many - hit
    assert {r.doc_id: len(decontam_words(r.text)) for r in after["decontamination"]} == clean
    assert all(not hits_by_brute_force(r.text, windows)[1] and r.n_chars == len(r.text) for r in after["decontamination"])
    assert set(range(900, 904)) & kept <= set(clean) and 910 not in clean

    sizes, taken, longest = Counter(), Counter(), 0
    for r in after["decontamination"]:
        n = len(cases.SPACED.findall(r.text))
        sizes[r.source] += n
        longest = max(longest, n)
    for r in after["mixing"]:
        taken[r.source] += len(cases.SPACED.findall(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s))
    table = spark.createDataFrame([(s, sizes[s], float((5, 2, 1)[k % 3])) for k, s in enumerate(order)], "source string, size bigint, weight double")
    for r in mixing.water_fill(table, 1.5 * sum(sizes.values()), 2.0).collect():
        assert abs(taken[r.source] - r.target) <= longest
    assert max(Counter(r.doc_id for r in after["mixing"]).values()) <= 2

    shards = Counter(r.shard for r in after["sharding"])
    assert len(after["sharding"]) == len(after["mixing"]) and max(shards.values()) - min(shards.values()) <= 1
    digest = lambda frame: sorted((r.doc_id, zlib.crc32(r.text.encode()), r.shard) for r in frame)
    assert digest(corpus_pipeline.run(spark, folder).collect()) == digest(after["sharding"])


def plain_estimate(x, h=0.75, steps=4):
    """The estimate restated: four starts, concentration steps on sorted distances, the least determinant, one reweighting."""
    p = quality.P
    floor = np.array(list(quality.FEATURES.values()))

    def raised(scatter):
        values, vectors = np.linalg.eigh(np.diag(1 / floor) @ scatter @ np.diag(1 / floor))
        return np.diag(floor) @ vectors @ np.diag(np.maximum(values, 1)) @ vectors.T @ np.diag(floor)

    def estimate(part, share):
        return part.mean(axis=0), np.cov(part.T, bias=True) * share / quality.chi2_cdf(quality.chi2_quantile(share, p), p + 2)

    def distances(centre, scatter):
        return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(raised(scatter)), x - centre)

    low, middle, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    unit = np.maximum((high - low) / 1.349, floor)
    z = (x - middle) / unit
    starts = [(middle, np.diag(((high - low) / 1.349) ** 2)), (x.mean(axis=0), np.cov(x.T, bias=True))]
    for u in (np.tanh(z), z / np.maximum(np.linalg.norm(z, axis=1), 1e-300)[:, None]):
        cov = np.cov(u.T, bias=True)
        deviation = np.sqrt(np.diag(cov))
        r = np.divide(cov, np.outer(deviation, deviation), out=np.zeros_like(cov), where=np.outer(deviation, deviation) > 1e-18)
        np.fill_diagonal(r, 1)
        starts.append((middle, r * np.outer(unit, unit)))
    ends = []
    for centre, scatter in starts:
        for _ in range(steps):
            centre, scatter = estimate(x[np.argsort(distances(centre, scatter))[: int(np.ceil(h * len(x)))]], h)
        ends.append((np.linalg.slogdet(raised(scatter))[1], centre, scatter))
    _, centre, scatter = min(ends, key=lambda e: e[0])
    within = quality.chi2_quantile(0.975, p)
    centre, scatter = estimate(x[distances(centre, scatter) <= within], quality.chi2_cdf(within, p))
    return centre, scatter, np.sqrt(distances(centre, scatter))


def moderate(rng, k):
    """Good prose with a third of its words in capitals: odd next to its neighbours, yet far from junk."""
    return " ".join(w.upper() if rng.random() < 0.33 else w for w in good_text(rng, k).split(" "))


def graded(spark):
    rng = cases.rng()
    rows = [(k, good_text(rng, k), "en", "a") for k in range(500)]
    rows += [(500 + k, " ".join(w + "###" for w in good_text(rng, k).split(" ")), "en", "a") for k in range(60)]
    rows += [(600 + k, moderate(rng, k), "en", "a") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    return quality.with_statistics(docs, keep=["doc_id", "lang", "source"]).persist()


def test_salted_join_of_many_groups_gives_the_same_estimates(spark):
    stats = graded(spark)
    near, far = ({r.g: r for r in quality.fit(stats, steps=2, few_groups=k).collect()} for k in (quality.FEW, 0))
    assert near.keys() == far.keys() and "all" in near
    for g in near:
        assert near[g].n == far[g].n
        np.testing.assert_allclose(near[g].centre, far[g].centre, atol=1e-9)
        np.testing.assert_allclose(near[g].white, far[g].white, rtol=1e-6, atol=1e-6)


def test_estimates_and_verdicts_equal_plain_concentration_steps(spark):
    stats = graded(spark)
    states = quality.fit(stats)
    state = states.filter(F.col("g") == "all").first()
    rows = stats.filter(~quality.base_failed()).orderBy("doc_id").collect()
    x = np.array([[r.quality[f] for f in quality.FEATURES] for r in rows])
    centre, scatter, distance = plain_estimate(x)
    floor = np.array(list(quality.FEATURES.values()))
    assert state.n == len(x) and (np.abs(np.array(state.centre) - centre) < 0.2 * floor).all()
    verdicts = {r.doc_id: (r.distance, r.kept) for r in quality.judge(stats, states).collect()}
    got = np.array([verdicts[r.doc_id][0] for r in rows])
    assert np.allclose(got, distance, rtol=0.1, atol=0.2)
    limit = np.sqrt(quality.chi2_quantile(0.9999, quality.P))
    clear = np.abs(distance - limit) > 0.1 * limit + 0.2
    assert clear.mean() > 0.95 and all(verdicts[r.doc_id][1] == (d <= limit) for r, d in zip([r for r, c in zip(rows, clear, strict=True) if c], distance[clear], strict=True))
    # What varies among clean documents is measured by the estimate and not by the floor.
    share = np.diag(scatter) / np.square(floor)
    assert share[list(quality.FEATURES).index("word_length")] > 1 and share[list(quality.FEATURES).index("upper")] > 1


def test_moderate_outliers_go_and_clean_documents_stay(spark):
    stats = graded(spark)
    kept = {r.doc_id for r in quality.judge(stats, quality.fit(stats)).filter("kept").collect()}
    assert len(kept & set(range(500))) >= 497 and not kept & set(range(500, 560)) and not kept & set(range(600, 620))


def test_floor_raises_small_eigenvalues_only():
    unit = np.array(list(quality.FEATURES.values()))
    scatter = np.diag(np.square(unit) * np.array([9.0, 0.0, 0.25, 4.0, 1.0, 16.0]))
    assert np.allclose(np.diag(quality.floored(scatter)) / np.square(unit), [9, 1, 1, 4, 1, 16])


def test_chi_square():
    assert abs(quality.chi2_quantile(0.95, 6) - 12.5916) < 1e-3 and abs(quality.chi2_quantile(0.9999, 6) - 27.856) < 1e-2
