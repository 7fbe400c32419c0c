"""Source divergence, phrase collocations and license scans against brute force."""

import re
from collections import Counter, defaultdict

import llm_cases as cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import collocations, divergence, licenses, textops


def low(text):
    return (text or "").translate(cases.LOWER)


def awkward(spark, rng, many=60):
    docs = cases.documents(spark, rng, many)
    more = [(None, "Released under the MIT License. " * 3, None, "a"), (None, None, "en", "only"), (5000, "x" * 3000 + " ÀÉ été " * 40, "fr", "b"), (5000, "x" * 3000 + " ÀÉ été " * 40, "fr", "b")]
    return docs.unionByName(spark.createDataFrame([(*r, 0, "own", 3, 0.5, "l", 9) for r in more], cases.SCHEMA))


def divergence_by_brute_force(rows, min_docs, ranks):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))) for text, lang, source in rows]
    docs, group, whole = Counter(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in terms:
        group[lang, source].update(words)
        whole[lang].update(words)
        docs.update((lang, w) for w in set(words))
    out = set()
    for lang in whole:
        kept = sorted(t for t in whole[lang] if docs[lang, t] >= min_docs)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {g: share(c) for g, c in group.items() if g[0] == lang}, share(whole[lang])
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for g in p:
            pairs = sorted((-sum(gap(p[g][t], p[h][t]) for t in kept), h[1].encode()) for h in p if h != g)
            own = sorted((-gap(p[g][t], q[t]), t.encode()) for t in kept if group[g][t] and p[g][t] > q[t])[:ranks]
            for part, found in (("pair", pairs), ("term", own)):
                out |= {(*g, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)}
    return out


def test_divergence_equals_brute_force(spark):
    docs = awkward(spark, cases.rng())
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    for min_docs in (2, 5):
        got = {tuple(r) for r in divergence.audit(docs, min_docs=min_docs, ranks=4).collect()}
        assert got == divergence_by_brute_force(rows, min_docs, 4)
    none = {tuple(r) for r in divergence.audit(docs, min_docs=10_000).collect()}
    assert none and none == divergence_by_brute_force(rows, 10_000, 10) and {r[4] for r in none} == {0}
    assert divergence.audit(cases.empty(spark)).count() == 0


def test_radix_order_is_stable_order():
    random = np.random.default_rng(3)
    keys = (random.integers(0, 3, 500).astype(np.uint64) << np.uint64(50), random.integers(0, 1 << 40, 500).astype(np.uint64), random.integers(0, 70_000, 500).astype(np.uint32))
    assert (divergence.radix_order(keys) == np.lexsort(keys[::-1])).all()
    assert len(divergence.radix_order((np.zeros(0, dtype=np.uint64),))) == 0


def phrase_counts(rows, longest):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[k : k + n])) for k in range(len(words) - n + 1))
    return counts, total


def collocations_by_brute_force(rows, min_count, longest, most):
    counts, total = phrase_counts(rows, longest)
    found = defaultdict(list)
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= min_count}
    for (lang, words), a in candidates.items():
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        inside = any(x[0] == lang and len(x[1]) > len(words) and b >= a and any(x[1][i : i + len(words)] == words for i in range(len(x[1]))) for x, b in candidates.items())
        if not inside:
            found[lang].append((-score, -a, " ".join(words).encode(), left, right, total[lang]))
    return {(lang, k + 1, p.decode(), -a, left, right, n, -s) for lang, some in found.items() for k, (s, a, p, left, right, n) in enumerate(sorted(some)[:most])}


def chatter(rng, words):
    pool = ["a", "b", "Éa", "c", "the", "of", "xx"]
    return "".join(rng.choice(pool) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(words))


def test_collocations_equal_brute_force(spark):
    rng = cases.rng()
    docs = awkward(spark, rng)
    extra = [(7000 + k, chatter(rng, rng.randint(1, 150)), rng.choice(["en", "fr", None]), "a", 0, "own", 3, 0.5, "l", 9) for k in range(40)]
    docs = docs.unionByName(spark.createDataFrame(extra, cases.SCHEMA))
    rows = [(r.text, r.lang) for r in docs.collect()]
    for min_count, most in ((4, 25), (2, 10_000)):
        got = {tuple(r) for r in collocations.mined(docs, min_count=min_count, most=most).collect()}
        assert got == collocations_by_brute_force(rows, min_count, 5, most) and len(got) > 40
    assert collocations.mined(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        collocations.mined(docs, min_count=1 << 24)


def counts_of_blocks(pieces, longest, bits):
    """Phrases counted as the last pass does, every fingerprint listed."""
    out = Counter()
    for data, langs, sizes, owns in pieces:
        p = collocations.phrases(data, langs, sizes, owns)
        if len(p.starts):
            number, words = collocations.word_numbers(p)
            for n, at, _ in collocations.fingerprints(p, longest):
                out.update((p.langs[p.lang[a]], tuple(words[number[a + k]].as_py() for k in range(n))) for a in at.tolist())
    return out


def test_long_texts_are_cut_without_losing_phrases(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 400)
    rng = cases.rng()
    for text in (chatter(rng, 3000), "a" * 5000 + " b c", " " * 900 + chatter(rng, 90) + " " * 900, "é" * 700 + " x " + "y" * 700):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        pieces = [(d.tobytes(), ["en"], [len(d)], [n]) for d, n in collocations.cut(textops.Block(0, data, np.array([0, len(data)])), 4)]
        assert sum(x[3][0] for x in pieces) == len(data)
        assert counts_of_blocks(pieces, 5, 40) == phrase_counts([(text, "en")], 5)[0]


def test_texts_of_one_fingerprint_are_told_apart(monkeypatch):
    """With word hashes of three bits nearly all words and phrases collide."""
    plain = textops.word_hashes
    monkeypatch.setattr(textops, "word_hashes", lambda *a: plain(*a) & np.uint64(7))
    rows = [("tap tip top tip tap of the tip of the top", "en"), ("Tap tip, tip tap of", "fr"), ("tipp tappt tip", "en")]
    data = "".join(t for t, _ in rows).encode()
    sizes = [len(t.encode()) for t, _ in rows]
    p = collocations.phrases(data, [x for _, x in rows], sizes, sizes)
    number, words = collocations.word_numbers(p)
    assert [words[k].as_py() for k in number] == [low(w) for t, _ in rows for w in re.findall(r"[^\s,]+", t)]


def scan_by_brute_force(text, notices, threshold):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    places, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split(" ")
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        base |= {label} if hits else set()
    labels, best = set(base), 1.0 if places else 0.0
    for notice, label in notices:
        long = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(notice))
        step, own = 8, set(long)
        while step < len(long):
            step *= 2
        for k in range(0, max(len(words) - step, 1), step):
            share = len(own & set(words[k : k + 2 * step])) / len(own)
            if share * len(own) >= threshold * len(own) - 1e-9:
                labels.add(label)
                best = max(best, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base), sorted(labels), best


NOTICES = (("Alpha beta, gamma. DELTA epsilon", "greek"), ("one two three four five six seven eight nine ten eleven", "numbers"), ("été été été", "é"), (licenses.TEMPLATES[7][0], "gpl"))


def test_scan_equals_brute_force(spark):
    rng = cases.rng()
    pool = "alpha beta gamma delta epsilon one two three four five six seven eight nine ten eleven été cc by general public license all rights reserved x y".split(" ")
    made = [(k, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 70))), "en", "a", 0, "own", 3, 0.5, "l", 9) for k in range(120)]
    made += [(500, "Filler. " * 20 + licenses.TEMPLATES[7][0].replace("and or", "or") + " end" * 33, None, None, 0, "own", 3, 0.5, "l", 9), (501, "CC-BY cc by cc\nby", "en", "a", 0, "own", 3, 0.5, "l", 9)]
    docs = awkward(spark, rng, 10).unionByName(spark.createDataFrame(made, cases.SCHEMA))
    for notices, threshold in ((NOTICES, 0.8), (NOTICES, 0.5), (licenses.TEMPLATES, 0.9), ((), 0.9)):
        found = licenses.scan(docs, notices, threshold).select("row.*", *[F.col(c).alias(f"x_{c}") for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]).collect()
        assert len(found) == docs.count()
        for r in found:
            assert (r.x_n_words, r.x_n_base, r.x_first_word, r.x_last_word, r.x_base_labels, r.x_labels, r.x_score) == scan_by_brute_force(r.text, notices, threshold)
    assert licenses.scan(cases.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(docs, (("...", "none"),))
