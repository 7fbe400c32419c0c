import re
from collections import Counter

import pyarrow as pa

from sketchloom.llm import collocations, licenses


def test_counts_of_blocks_are_added_up_in_the_task(spark, monkeypatch):
    """One row for each phrase and task, however many blocks the task has."""
    docs = spark.createDataFrame([("en", "red fox runs. " * 5)] * 40, "lang string, text string").coalesce(1)
    monkeypatch.setattr(collocations, "BLOCK", 200)
    blocks = collocations.packed(docs, 1)
    assert blocks.count() > 10
    runs = collocations.sent(blocks, 2, 30, 2)
    rows = collocations.counted(blocks.coalesce(1), collocations.frequent_files(runs, 100, 30, 2), 2, 30).collect()
    got = {(r["phrase"], r["words"]): r["count"] for r in rows}
    assert got == {("", 0): 600, ("red", 1): 200, ("fox", 1): 200, ("runs", 1): 200, ("red fox", 2): 200, ("fox runs", 2): 200}
    assert len(rows) == len(got)


def test_phrases_become_rows_once_they_are_added_up(spark):
    """Tasks send a row for each part, whatever the number of phrases; every phrase is a row once, however many tasks have it."""
    words = [a + b for a in "abcdefgh" for b in "abcdefgh"]
    docs = spark.createDataFrame([("en", " ".join(words))] * 120, "lang string, text string").repartition(6)
    blocks = collocations.packed(docs, 1)
    lists = collocations.frequent_files(collocations.sent(blocks, 2, 30, 3), 100, 30, 3)
    frame = collocations.counted(blocks.repartition(6), lists, 2, 30, 3)
    rows = frame.collect()
    got = {r["phrase"]: r["count"] for r in rows}
    assert len(rows) == len(got) == 64 + 63 + 1 and got.pop("") == 64 * 120 and set(got.values()) == {120}
    plan = frame._jdf.queryExecution().executedPlan().toString()
    sent = plan[plan.rindex("Exchange") :]
    assert "phrase" not in sent[: sent.index("Scan")]


def test_bundles_hold_a_part_each():
    rows = [(1, "en", "a b", 2, 3), (0, "de", "a b", 2, 1), (1, "en", "é", 1, 4)]
    schema = pa.schema([collocations.BUNDLES.field("part"), *collocations.COUNTED])
    counts = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    bundles = collocations.bundled(counts)
    assert bundles["part"].to_pylist() == [0, 1]
    for part in (0, 1):
        twice = pa.Table.from_batches([bundles.slice(part, 1)] * 2)
        got = sorted(tuple(r.values()) for r in collocations.unbundled(twice).to_pylist())
        assert got == sorted((*r[1:4], 2 * r[4]) for r in rows if r[0] == part)


def test_added_keeps_texts_apart():
    rows = [("en", "a b", 2, 3), ("de", "a b", 2, 1), ("en", "a b", 2, 4), ("en", "", 0, 9)]
    held = [pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(r, collocations.COUNTED, strict=True)], schema=collocations.COUNTED) for r in rows]
    got = sorted(tuple(r.values()) for r in collocations.added(held).to_pylist())
    assert got == [("de", "a b", 2, 1), ("en", "", 0, 9), ("en", "a b", 2, 7)]


def test_template_words_are_counted_from_the_scanned_rows(spark):
    """No second cut of the texts into words: the order comes from what the scan has written."""
    texts = ["Beta beta alpha, x", None, "gamma beta ALPHA y z", ""]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    templates = licenses.templates_of((("alpha beta gamma delta", "greek"),), 0.9)
    rows = licenses.scanned(docs, templates, (), ["text"], "text")
    many = Counter(w for t in texts for w in re.findall(licenses.WORD, (t or "").lower()))
    assert licenses.ranked_words(rows, templates) == sorted(["alpha", "beta", "gamma", "delta"], key=lambda w: (many[w], w))
