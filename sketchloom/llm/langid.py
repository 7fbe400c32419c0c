"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased code points, everything but letters counts as a blank, runs of blanks are cut
to one, and n-grams of one to three characters are hashed into ``1 << DIMENSION_BITS`` features. A feature's
value is its share of the text's n-grams times its inverse document frequency, so a text's class
scores are averages over its n-grams: whole texts of any length cost one look-up per character and
order, without counting n-grams per text.

Document frequencies are counted over all training documents in Spark. The weights are trained by
the follow-the-regularised-leader rule (per-coordinate steps, elastic net: L1 for sparsity, L2) on
at most ``most_rows`` labelled documents in expectation, an equal share for every language, drawn by
a seeded hash. A second part of the draw, never trained on, fits the temperature that calibrates the scores.

Defined cases: a null text or one without a letter is `und` with score 0; rows with a null language
are never learned from; with no labelled rows every text is `und`; with a single language that language is
predicted with score 1. Repeated rows count as often as they occur. Further columns are kept; the
result is the struct ``language``, which replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchloom.llm import textops

DIMENSION_BITS = 17
ORDERS = 3
BLANK = 0x20
_ODD = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D]
_tables: list[np.ndarray] = []


def lowered_letters() -> np.ndarray:
    """For every code point its lower-case letter, or a blank where it is no letter."""
    if not _tables:
        table = np.full(0x110000, BLANK, dtype=np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _tables.append(table)
    return _tables[0]


def grams(block: textops.Block) -> tuple[np.ndarray, np.ndarray]:
    """Features of every n-gram, text by text, and where each text's begin. Texts without a letter have none."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    # Character offsets: code points before each byte offset.
    leading = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    offsets = leading[block.offsets]
    chars = lowered_letters()[points]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    letter = chars != BLANK
    keep = letter.copy()
    # A blank stays where a letter of the same text comes before it.
    keep[1:] |= letter[:-1] & (rows[1:] == rows[:-1])
    chars, rows = chars[keep], rows[keep]
    out, owner = [], []
    h = np.zeros(len(chars), dtype=np.uint64)
    for n in range(ORDERS):
        if len(chars) <= n:
            break
        h = h[: len(chars) - n] * np.uint64(0x100000001B3) + chars[n:].astype(np.uint64) + np.uint64(1)
        same = rows[: len(chars) - n] == rows[n:]
        at = np.flatnonzero(same)
        code = (h[at] * np.uint64(_ODD[n]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - DIMENSION_BITS)
        out.append(code.astype(np.int32))
        owner.append(rows[at])
    if not out:
        return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
    features, owner = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return features[order], np.searchsorted(owner[order], np.arange(len(offsets)))


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # feature x language, times the inverse document frequency
    bias: np.ndarray
    temperature: float


def document_frequency(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all ``rows(text)`` each feature occurs, and the number of rows. One small row a feature and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, many = np.zeros(1 << DIMENSION_BITS, dtype=np.int64), 0
        for batch in batches:
            many += batch.num_rows
            for block in textops.blocks(batch.column("text")):
                features, first = grams(block)
                for a, b in zip(first[:-1], first[1:], strict=True):
                    seen = np.zeros(1 << DIMENSION_BITS, dtype=bool)
                    seen[features[a:b]] = True
                    total += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"f": np.append(used, -1), "n": np.append(total[used], many)}, pa.schema([("f", pa.int64()), ("n", pa.int64())]))

    counts = rows.mapInArrow(run, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n"))
    out, many = np.zeros(1 << DIMENSION_BITS, dtype=np.int64), 0
    for row in counts.toLocalIterator():
        if row["f"] < 0:
            many = row["n"]
        else:
            out[row["f"]] = row["n"]
    return out, many


def sample_vectors(rows: DataFrame) -> pd.DataFrame:
    """``lang, part, features, shares`` of the drawn rows: bounded by the draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("draw", pa.float64()), ("features", pa.list_(pa.int32())), ("shares", pa.list_(pa.float32()))])
        for batch in batches:
            for block in textops.blocks(batch.column("text")):
                features, first = grams(block)
                sets, shares = [], []
                for a, b in zip(first[:-1], first[1:], strict=True):
                    f, n = np.unique(features[a:b], return_counts=True)
                    sets.append(f)
                    shares.append((n / max(1, b - a)).astype(np.float32))
                many = len(sets)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(block.first, many) for c in ("lang", "draw")] + [pa.array(sets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], schema=schema)

    return rows.mapInArrow(run, "lang string, draw double, features array<int>, shares array<float>").toPandas()


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 5):
    """Follow-the-regularised-leader with a multinomial loss: ``z`` and ``n`` per feature and class."""
    size = 1 << DIMENSION_BITS
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def weights(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(samples)):
            features, values, label = samples[k]
            at = np.append(features, size)  # the last coordinate is the bias
            x = np.append(values, 1.0)[:, None]
            w = weights(z[at], n[at])
            scores = (w * x).sum(axis=0)
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[label] -= 1
            g = x * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    return w[:-1], w[-1]


def calibrate(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on rows that were not trained on, by golden section on its logarithm.

    The right class counts as (n + 1) / (n + classes) and the others share the rest, so that rows
    without an error don't make the scores certain.
    """
    if not len(labels):
        return 1.0

    many, classes = scores.shape
    right = (many + 1) / (many + classes)
    aim = np.full(scores.shape, (1 - right) / max(1, classes - 1))
    aim[np.arange(many), labels] = right

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - (aim * s).sum(axis=1)))

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(labelled: DataFrame, most_rows: int = 4000, calibration: float = 0.25, seed: int = 5) -> Model:
    """Learn from ``labelled(text, lang, key)``; ``key`` seeds the draw. ``most_rows`` bounds what the driver trains on."""
    rows = labelled.filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((1 << DIMENSION_BITS, 0), dtype=np.float32), np.zeros(0), 1.0)
    frequency, many = document_frequency(rows.select("text"))
    idf = np.log((1 + many) / (1 + frequency)) + 1
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, most_rows / len(languages) / n))).otherwise(share)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    drawn = rows.withColumn("draw", draw / share).filter("draw < 1").select("text", "lang", "draw")
    vectors = sample_vectors(drawn).sort_values(["draw", "lang"])
    vectors = vectors[vectors["features"].map(len) > 0]
    code = {lang: k for k, lang in enumerate(languages)}
    # The shares of a text sum up to 1; scaled, steps of usual size fit them.
    samples = [(f, v * idf[f] * SCALE, code[lang]) for f, v, lang in zip(vectors["features"], vectors["shares"], vectors["lang"], strict=True)]
    held = (vectors["draw"] < calibration).to_numpy()
    weights, bias = train([s for s, h in zip(samples, held, strict=True) if not h], len(languages), seed=seed)
    checked = [s for s, h in zip(samples, held, strict=True) if h]
    scores = np.array([(weights[f] * v[:, None]).sum(axis=0) + bias for f, v, _ in checked]).reshape(-1, len(languages))
    temperature = calibrate(scores, np.array([c for _, _, c in checked], dtype=int))
    return Model(languages, (weights * idf[:, None] * SCALE).astype(np.float32), bias, temperature)


SCALE = 20.0
LANGUAGE = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def block_predictions(block: textops.Block, model: Model) -> tuple[list[str], np.ndarray]:
    features, first = grams(block)
    counts = np.diff(first)
    if not model.languages:
        return ["und"] * len(counts), np.zeros(len(counts))
    scores = np.empty((len(counts), len(model.languages)))
    for k in range(len(model.languages)):
        scores[:, k] = textops.sums(model.weights[:, k][features].astype(np.float64), first)
    scores = (scores / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    none = counts == 0
    named = [("und" if n else model.languages[b]) for n, b in zip(none.tolist(), best.tolist(), strict=True)]
    return named, np.where(none, 0.0, p[np.arange(len(best)), best])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents (or their columns ``keep``) with ``language``. The model's size is fixed: features x languages."""
    names = [c for c in (docs.columns if keep is None else keep) if c != "language"]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("language", LANGUAGE)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = [], [np.zeros(0)]
            for block in textops.blocks(batch.column(text_col)):
                own, score = block_predictions(block, shared.value)
                labels += own
                scores.append(score)
            made = pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(np.concatenate(scores))], ["lang_pred", "score"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], [*names, "language"])

    return docs.select(*dict.fromkeys([*(f"`{c}`" for c in names), f"`{text_col}`"])).mapInArrow(run, schema)


def learned(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labelled rows outside the held-out third, for :func:`fit`."""
    return docs.filter(F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3, F.lit(1)) != 1).select("text", "lang", F.col(id_col).alias("key"))


