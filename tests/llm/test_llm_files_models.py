"""Token files, WARC archives, language identification and language-model scores."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import llm_cases as cases
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sketchloom.llm import knlm, langid, textops, token_files, warc

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack(ids, bits)
    assert len(data) == -(-1003 * bits // 8) and (token_files.unpack(data, 1003, bits) == ids).all()


def test_width():
    assert [token_files.width(n) for n in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 500, 0, 3)]
    writer = token_files.Writer(str(tmp_path / "t.bin"), 13)
    for k, ids in enumerate(docs):
        writer.add(None if k == 7 else k, ids)
    writer.close()
    reader = token_files.Reader(str(tmp_path / "t.bin"))
    assert reader.docs == [0, 1, 2, 3, 4, 5, 6, None]
    every = np.concatenate(docs)
    for k, ids in enumerate(docs):
        assert (reader.document(k) == ids).all()
    for low, high in ((0, 0), (5, 6), (60, 130), (64, 128), (0, len(every))):
        assert (reader.ids(low, high) == every[low:high]).all()


def test_token_files(spark):
    from tokenizers import Tokenizer

    rng = cases.rng()
    texts = cases.texts(rng) + ["It's 2 o'clock now\x85 \x1c then", "ﬁne Å Å ΣΑΣ", "<|endoftext|> x", "á b ́c"]
    rows = [(k * 7 % 101 - 50, t) for k, t in enumerate(texts)] + [(None, "last one")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("start", F.lit(1)).repartition(3)
    got = token_files.read(spark, token_files.write(docs, PATH, end_id=1, parts=3)).collect()
    plain = Tokenizer.from_file(PATH)
    start = 0
    by_id = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for (doc_id, text), r in zip(by_id, sorted(got, key=lambda r: r.start), strict=True):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.read(spark, token_files.write(docs.limit(0), PATH, end_id=1)).count() == 0


def test_added_tokens_in_other_casings():
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(PATH), token_files.Encoder(PATH)
    texts = ["<|ENDOFTEXT|>", "<|endoftext|>", "A <|EndOfText|> b", "Up<|ENDOFTEXT|>To, <|STARTOFTEXT|>. x", "Up<|endoftext|>To. <|startoftext|>,", "É<|EndOfText|>É.", "<|EndOf Text|> <|ENDOFTEXT", "plain WORDS, here."]
    ids, starts = encode.ids(next(iter(textops.blocks(pa.array(texts)))), 1)
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == [*plain.encode(text, add_special_tokens=False).ids, 1], text


def test_archives(spark):
    rng = cases.rng()
    big, small = "<p>" + cases.prose(rng, 400) + "</p>", "<p>tiny</p>"
    rows = [(k, f"http://x.example/{k}", "<html>" + cases.prose(rng, 150)) for k in range(60)]
    rows += [(100, "u", big), (101, None, big), (99, "a\r\nb", big), (102, "u", small), (103, "u", small), (104, "u", None), (105, None, ""), (None, "n", big), (101, None, big), (106, "u", "a\r\n\r\nb" * 300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("own")).repartition(2)
    archives = warc.write(warc.with_revisits(pages), archive_bytes=20_000)
    assert archives.count() > 2
    got = sorted(warc.read(archives).collect(), key=str)
    expected = []
    for page_id, url, html in rows:
        payload = (html or "").encode()
        first = html != big or page_id == 101
        expected.append((page_id, url and url.replace("\r", "%0D").replace("\n", "%0A"), "response" if first else "revisit", payload if first else None, len(payload), hashlib.sha1(payload).hexdigest(), None if first else 101))
    assert sorted(((r.page_id, r.url, r.record_type, r.payload and bytes(r.payload), r.payload_bytes, r.payload_digest, r.refers_to) for r in got), key=str) == sorted(((*e[:3], e[3] or (b"" if e[3] == b"" else None), *e[4:]) for e in expected), key=str)
    assert warc.read(warc.write(warc.with_revisits(pages.limit(0)))).count() == 0


def test_archive_layout(tmp_path):
    records = [warc.record(k, f"http://x/{k}", b"<html>" + bytes(str(k) * 50, "ascii"), "d", None, "1970-01-01T00:00:00Z") for k in range(200)]
    warc.write_archive(str(tmp_path / "a.warc.zst"), records, 3)
    data = (tmp_path / "a.warc.zst").read_bytes()
    assert data[:4] == bytes.fromhex("5d2a4d18")
    assert data[8:12] == bytes.fromhex("37a430ec")  # a dictionary of the format
    size = int.from_bytes(data[4:8], "little")
    assert data.count(bytes.fromhex("28b52ffd"), 8 + size) >= len(records)  # a frame per record
    warc.write_archive(str(tmp_path / "b.warc.zst"), records[:2], 3)
    assert [h["warc-record-id"] for h, _ in warc.records_of(str(tmp_path / "b.warc.zst"))] == ["<urn:x-page:0>", "<urn:x-page:1>"]


LANGUAGES = {"aa": ["ta", "ren", "ou", "li"], "bb": ["ße", "gor", "wo", "kha"], "cc": ["ñe", "sul", "mé", "pi"]}


def test_language_id(spark):
    rng = cases.rng()
    rows = []
    for k in range(600):
        lang = rng.choice(list(LANGUAGES))
        text = " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60)))
        rows.append((k, text, lang if k % 10 else None, lang))
    rows += [(1000, None, "aa", ""), (1001, "", "aa", ""), (1002, "12 !!", "bb", ""), (1003, "TA REN OU", "aa", "aa"), (None, "ta ren", "aa", "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, truth string").withColumn("language", F.lit(1)).repartition(3)
    model = langid.fit(langid.learned(docs))
    assert langid.fit(langid.learned(docs)).weights.tobytes() == model.weights.tobytes()
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    held = [(i, truth) for i, _, _, truth in rows if i is not None and i < 600 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].language.lang_pred == truth for i, truth in held) >= 0.98 * len(held)
    for k in (1000, 1001, 1002):
        assert tuple(got[k].language) == ("und", 0.0)
    assert all(0 <= r.language.score <= 1 for r in got.values())
    assert got[1003].language.lang_pred == "aa"
    none = langid.fit(langid.learned(docs.limit(0)))
    assert {r.language.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    single = langid.fit(langid.learned(docs.filter("lang = 'aa'")))
    assert {r.language.lang_pred for r in langid.predict(docs.filter("doc_id = 3"), single).collect()} == {"aa"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_shards_grow_with_the_input(spark, monkeypatch):
    rng = cases.rng()
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(cases.texts(rng))], "doc_id bigint, text string")

    def scores():
        model = knlm.fit(docs)
        return model.bigrams.shards, sorted((r.doc_id, r.score) for r in knlm.scored(docs, model, keep=["doc_id"]).collect())

    few, plain = scores()
    size = sum(len((r.text or "").encode()) for r in docs.collect())
    monkeypatch.setattr(knlm, "SHARD_BYTES", size // 100, raising=False)
    many, same = scores()
    assert few < 100 <= many <= 101 and [s for _, s in same] == pytest.approx([s for _, s in plain])


def test_mix_is_inverted():
    x = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (knlm.unmixed(textops.mixed(x)) == x).all()


def discounts(counts):
    n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    return [0, *(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))]


def test_scores(spark, monkeypatch):
    monkeypatch.setattr(knlm, "BLOCK", 4000)
    monkeypatch.setattr(knlm, "HELD", 500)
    rng = cases.rng()
    vocabulary = [cases.prose(rng, 1) for _ in range(60)]
    texts = cases.texts(rng) + [" ".join(vocabulary[int(60 * rng.random() ** 2)] for _ in range(rng.randint(0, 80))) for _ in range(300)] + ["ou ou ou " * 400]
    docs = spark.createDataFrame([(k, t, 1.5) for k, t in enumerate(texts)], "doc_id bigint, text string, score double").repartition(4)
    docs = docs.withColumn("held_out", knlm.held_out())
    got = {r.doc_id: r for r in knlm.scored(docs, knlm.fit(docs.filter("not held_out")), keep=["doc_id", "held_out"]).collect()}
    words = {k: [*cases.SPACED.findall((t or "").translate(cases.LOWER)), "</s>"] for k, t in enumerate(texts)}
    learned = [k for k in words if zlib.crc32(str(k).encode()) % 7 != 2]
    one, two = Counter(), Counter()
    for k in learned:
        one.update(words[k])
        two.update(zip(["<s>", *words[k]], words[k], strict=False))
    contexts, upper = Counter(w for _, w in two), discounts(two.values())
    lower, total, kinds = discounts(contexts.values()), Counter(), defaultdict(Counter)
    for (h, _), c in two.items():
        total[h] += c
        kinds[h][min(c, 3)] += 1
    free = sum(lower[min(c, 3)] for c in contexts.values()) / len(two)
    n, v = sum(one.values()), len(one)

    def p(w, h):
        q = free / (v + 1) + (contexts[w] - lower[min(contexts[w], 3)]) / len(two)
        c = two[h, w]
        return q if h not in total else (c - upper[min(c, 3)]) / total[h] + sum(upper[k] * m for k, m in kinds[h].items()) / total[h] * q

    for k, own in words.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(w in one for w in own), n, k not in learned)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 1) / (n + v + 1)) for w in own))
        assert r.score == pytest.approx(sum(math.log10(p(w, h)) for w, h in zip(own, ["<s>", *own], strict=False)))
    assert sum(p(w, own[0]) for w in one) + p("\x00", own[0]) == pytest.approx(1)
    none = knlm.scored(docs, knlm.fit(docs.limit(0)), keep=["doc_id"]).collect()
    assert len(none) == len(texts) and all(r.score == 0 and r.n_known == 0 for r in none)
    assert knlm.scored(docs.limit(0), knlm.fit(docs.limit(5)), keep=["doc_id"]).count() == 0
