"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Statistics of every whole text become a vector of transformed shares. Each (language, source) group
gets a minimum-covariance-determinant estimate of centre and scatter: from each of four starts,
concentration steps keep the ``h`` documents with the least distances and estimate anew from them,
and the start that ends with the least determinant is taken. The starts are medians with quartile
ranges, plain moments, and the correlations of squashed values and of directions. A document is
rejected when its Mahalanobis distance exceeds a chi-square quantile, or by the base rule (too
short, or mostly repeated words).

A concentration step is one aggregation of all rows: sums of values and products by group and by
the logarithmic bin of the distance. Rows combine map-side into a few hundred bins per group, so a
group that holds a third of the corpus costs no more than another, and only bins reach the step
that picks the ``h`` nearest (and the rest of the last one's bin). Scatter has a floor: in units of
the floor, eigenvalues below one are raised to one and the others stay as estimated. A share that
is 0 in nearly every document would otherwise make any other value an outlier.

Defined cases: null text has no words and fails the base rule; null language or source is a group
of its own; groups with fewer than ``least_rows`` usable documents use the estimate of their
language, and languages with fewer that of all documents; with none at all only the base rule
holds. Repeated rows count as often as they occur. Further columns are kept; the statistics are
in one struct ``quality``, which replaces a column of that name; ``accepted`` returns the documents' own
columns whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchloom.llm import textops
from sketchloom.llm.columns import shielded
from sketchloom.session import materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]

# Feature, and the least standard deviation it can have.
FEATURES = {"word_length": 0.02, "symbols": 0.15, "dup_lines": 0.08, "repeats": 0.06, "upper": 0.01, "marks": 0.05}
P = len(FEATURES)
FLOOR = np.array(list(FEATURES.values()))
STARTS = ("quartiles", "moments", "squashed", "directions")

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[0x41:0x5B] = True
MARKS = np.zeros(256, dtype=bool)
MARKS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) not in ".,"]] = True

SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in FEATURES])


def _distinct_first(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key how often it occurs, and whether this is its first occurrence."""
    _, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    is_first = np.zeros(len(keys), dtype=bool)
    is_first[first] = True
    return counts[inverse], is_first


def block_counts(block: textops.Block) -> dict[str, np.ndarray]:
    data, offsets = block.data, block.offsets
    found = textops.words(block)
    per_row = lambda mask: textops.sums(mask.astype(np.int64), offsets)
    inside = textops.NOT_SPACE[data]
    prefix = textops.prefix_hash(data)
    hashes = textops.span_hash(prefix, found.starts, found.ends)
    # Three-word windows that occur twice or more in their row mark their words.
    n = len(hashes)
    marked = np.zeros(n, dtype=bool)
    if n >= 3:
        odd = np.uint64(0xC2B2AE3D27D4EB4F)
        keys = textops.mixed((hashes[:-2] * odd + hashes[1:-1]) * odd + hashes[2:] + found.rows[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = np.flatnonzero(found.rows[:-2] == found.rows[2:])
        again = at[_distinct_first(keys[at])[0] > 1]
        for k in range(3):
            marked[again + k] = True
    # Lines: cut at "\n" and at row ends; those with a word are compared within their row.
    breaks = np.flatnonzero(data == 0x0A)
    cuts = np.union1d(breaks + 1, offsets)
    lows, highs = cuts[:-1], cuts[1:].copy()
    highs -= (highs > lows) & (data[np.maximum(highs - 1, 0)] == 0x0A) if len(data) else 0
    rows = np.searchsorted(offsets, lows, side="right") - 1
    worded = np.searchsorted(found.starts, highs) > np.searchsorted(found.starts, lows)
    lows, highs, rows = lows[worded], highs[worded], rows[worded]
    line_keys = textops.mixed(textops.span_hash(prefix, lows, highs) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    repeated_line = ~_distinct_first(line_keys)[1] if len(line_keys) else np.zeros(0, dtype=bool)
    many = len(offsets) - 1
    return {
        "n_words": np.diff(found.first),
        "word_chars": per_row(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": per_row(SYMBOLS[data]),
        "n_dup_lines": np.bincount(rows[repeated_line], minlength=many),
        "n_repeat_words": textops.sums(marked.astype(np.int64), found.first),
        "n_lines": np.bincount(rows, minlength=many),
        "n_upper": per_row(UPPER[data]),
        "n_marks": per_row(MARKS[data]),
    }


def features(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    words, chars, lines = (np.maximum(c[k], 1).astype(float) for k in ("n_words", "word_chars", "n_lines"))
    return {
        "word_length": np.log(chars / words),
        "symbols": np.sqrt(c["n_symbols"] / words),
        "dup_lines": c["n_dup_lines"] / lines,
        "repeats": c["n_repeat_words"] / words,
        "upper": np.sqrt(c["n_upper"] / chars),
        "marks": np.sqrt(c["n_marks"] / chars),
    }


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The documents (or their columns ``keep``) with the struct ``quality``."""
    names = [c for c in (docs.columns if keep is None else keep) if c != "quality"]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("quality", SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [block_counts(b) for b in textops.blocks(batch.column(text_col))]
            counts = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for k in COUNTS}
            made = {**{k: v.astype(np.int64) for k, v in counts.items()}, **features(counts)}
            struct = pa.StructArray.from_arrays([pa.array(v) for v in made.values()], list(made))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), struct], [*names, "quality"])

    return docs.select(*dict.fromkeys([*(f"`{c}`" for c in names), f"`{text_col}`"])).mapInArrow(run, schema)


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    q = F.col("quality")
    return (q["n_words"] < least_words) | (100 * q["n_repeat_words"] > most_repeated * q["n_words"])


# -- estimates ---------------------------------------------------------------------------------


def chi2_cdf(x: float, p: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 0.0
    for k in range(p // 2):
        total += term
        term *= x / 2 / (k + 1)
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, p) < q else (low, middle)
    return high


def _levels() -> Column:
    """The groups a row counts for: its language and source, its language, and all documents."""
    both = F.concat(F.lit("s:"), F.to_json(F.struct("lang", "source")))
    return F.array(both, F.concat(F.lit("l:"), F.to_json(F.struct("lang"))), F.lit("all"))


def _whitened() -> list[Column]:
    return [sum((F.col("white")[i * P + j] * (F.col("x")[j] - F.col("centre")[j]) for j in range(i, P)), F.lit(0.0)) for i in range(P)]


def _distance() -> Column:
    """Squared Mahalanobis distance: whitened differences, squared and summed."""
    return sum((z * z for z in _whitened()), F.lit(0.0))


def floored(scatter: np.ndarray) -> np.ndarray:
    """The scatter with eigenvalues, in units of the floor, of one or more; larger ones are as estimated."""
    values, vectors = np.linalg.eigh(scatter / np.outer(FLOOR, FLOOR))
    return (vectors * np.maximum(values, 1.0)) @ vectors.T * np.outer(FLOOR, FLOOR)


def _state(g: str, start: int, n: float, centre: np.ndarray, scatter: np.ndarray) -> pd.DataFrame:
    scatter = floored(scatter)
    white = np.linalg.cholesky(np.linalg.inv(scatter)).T
    size = np.linalg.slogdet(scatter)[1]
    return pd.DataFrame({"g": [g], "start": [int(start)], "n": [int(n)], "centre": [centre.tolist()], "white": [white.ravel().tolist()], "logdet": [size]})


STATE = "g string, start int, n bigint, centre array<double>, white array<double>, logdet double"
WIDTH = 0.005  # of a bin of the first start's histograms
FEW = 5_000  # groups whose states, four of some 400 bytes each, are broadcast
SALTS = 64
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def _moments(column: str) -> list[Column]:
    own = F.col(column)
    sums = [F.sum(own[i]).alias(f"s{i}") for i in range(P)]
    return [F.count(F.lit(1)).alias("n"), *sums, *[F.sum(own[i] * own[j]).alias(f"s{i}_{j}") for i, j in PAIRS]]


def _covariance(sums: dict) -> tuple[np.ndarray, np.ndarray]:
    centre, scatter = np.array([sums[f"s{i}"] for i in range(P)]) / sums["n"], np.zeros((P, P))
    for i, j in PAIRS:
        scatter[i, j] = scatter[j, i] = sums[f"s{i}_{j}"] / sums["n"] - centre[i] * centre[j]
    return centre, scatter


def _quartiles(rows: DataFrame) -> DataFrame:
    """The first start, median and quartile range of every feature, from histograms."""
    cells = rows.select("g", F.posexplode("x").alias("f", "v")).groupBy("g", "f", F.floor(F.col("v") / WIDTH).alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def estimate(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        centre, spread, rows_in = np.zeros(P), np.zeros(P), 0
        for f, own in part.sort_values(["f", "bin"]).groupby("f"):
            below = own["n"].cumsum().to_numpy()
            low, middle, high = (own["bin"].to_numpy()[np.searchsorted(below, q * below[-1])] for q in (0.25, 0.5, 0.75))
            centre[f], spread[f], rows_in = (middle + 0.5) * WIDTH, (high - low) * WIDTH / 1.349, below[-1]
        return _state(key[0], 0, rows_in, centre, np.diag(spread**2))

    return cells.groupBy("g").applyInPandas(estimate, STATE)


def _met(rows: DataFrame, states: DataFrame, few: bool) -> DataFrame:
    """Rows with every state of their group, dealt so that a sum by group combines in many tasks.

    Up to ``FEW`` groups, some megabytes of numbers, states are broadcast and rows stay where they are. Beyond it the
    join is salted by the task that read a row: a join on the group alone would deal all rows of a
    group to one task, and the sum that follows would take that dealing as its own.
    """
    if few:
        return rows.join(F.broadcast(states), "g")
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    every = states.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, ["g", "salt"]).drop("salt")


def _other_starts(rows: DataFrame, first: DataFrame, few: bool) -> DataFrame:
    """The three starts from moments of values in units of the first start: as they are, squashed, and at length one."""
    z = _met(rows, first.select("g", "centre", "white"), few).select("g", F.array(*_whitened()).alias("z"))
    norm = F.sqrt(sum((F.col("z")[i] * F.col("z")[i] for i in range(P)), F.lit(0.0)))
    squashed, direction = F.transform("z", F.tanh), F.transform("z", lambda v: F.when(norm > 0, v / norm).otherwise(0.0))
    forms = F.array(*[F.struct(F.lit(k).alias("start"), u.alias("u")) for k, u in enumerate((F.col("z"), squashed, direction), 1)])
    sums = z.select("g", F.inline(forms)).groupBy("g", "start").agg(*_moments("u"))

    def estimate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                unit = 1 / np.asarray(row["white"]).reshape(P, P).diagonal()
                mean, scatter = _covariance(row)
                if row["start"] > 1:  # correlations, around the medians
                    deviation = np.sqrt(np.maximum(scatter.diagonal(), 0))
                    deviation = np.where(deviation > 1e-9, deviation, np.inf)
                    mean, scatter = np.zeros(P), scatter / np.outer(deviation, deviation)
                    np.fill_diagonal(scatter, 1.0)
                yield _state(row["g"], row["start"], row["n"], np.asarray(row["centre"]) + unit * mean, scatter * np.outer(unit, unit))

    return sums.join(first.select("g", "centre", "white"), "g").mapInPandas(estimate, STATE)


def shrinking(share: float) -> float:
    """What the scatter of the nearest ``share`` of a normal sample is multiplied by to be that of all."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def _step(rows: DataFrame, states: DataFrame, few: bool, h: float | None, within: float | None) -> DataFrame:
    """One estimate per group and start from the nearest part ``h``, or from the rows ``within`` a distance."""
    near = _met(rows, states.drop("n", "logdet"), few).withColumn("d", _distance())
    bins = near.withColumn("bin", F.floor(F.log2(F.col("d") + 1e-6) * 16).cast("int")).groupBy("g", "start", "bin").agg(*_moments("x"))
    last_bin = None if within is None else math.floor(math.log2(within) * 16)
    factor = shrinking(h if h is not None else chi2_cdf(within, P))

    def estimate(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("bin")
        below = part["n"].cumsum().to_numpy()
        all_rows = below[-1]
        many = np.searchsorted(below, h * all_rows) + 1 if h is not None else max(1, int((part["bin"] <= last_bin).sum()))
        centre, scatter = _covariance(part.iloc[:many].sum(numeric_only=True).to_dict())
        return _state(key[0], key[1], all_rows, centre, scatter * factor)

    return bins.groupBy("g", "start").applyInPandas(estimate, STATE)


def _least(states: DataFrame) -> DataFrame:
    """Per group the start with the least determinant; of equal ones the first."""
    own = F.struct(*[c for c in states.columns if c != "g"])
    # Rounded: sums in another order must not choose between starts that have met.
    return states.groupBy("g").agg(F.min_by(own, F.struct(F.round("logdet", 6), "start")).alias("own")).select("g", "own.*")


def fit(stats: DataFrame, h: float = 0.75, steps: int = 4, few_groups: int = FEW) -> DataFrame:
    """``stats(lang, source, quality)`` of all documents to one row of centre and whitening matrix per group."""
    usable = stats.filter(~base_failed())
    vector = F.array(*[F.col("quality")[f] for f in FEATURES])
    rows = usable.select(F.explode(_levels()).alias("g"), vector.alias("x"))
    first = materialize(_quartiles(rows), "mcd-quartiles")
    few = first.limit(few_groups + 1).count() <= few_groups
    states = materialize(first.unionByName(_other_starts(rows, first, few)), "mcd-starts")
    for _ in range(steps):
        states = materialize(_step(rows, states, few, h, None), "mcd-step")
    states = materialize(_least(states), "mcd-least")
    return materialize(_step(rows, states, few, None, chi2_quantile(0.975, P)), "mcd-fit")


def judge(stats: DataFrame, states: DataFrame, quantile: float = 0.9999, least_rows: int = 20 * P) -> DataFrame:
    """``stats`` with ``base_failed``, ``distance`` (null without an estimate) and ``kept``.

    The estimates, a few hundred bytes a group, are joined by group: broadcast by their written
    size when small, else shuffled with hot groups split.
    """
    enough = states.filter(F.col("n") >= least_rows).select("g", F.struct("centre", "white").alias("e"))
    own = stats.withColumn("level", _levels()).withColumn("g", F.col("level")[0])
    keys = stats.select(_levels().alias("level")).distinct()
    for k in range(3):
        keys = keys.join(enough.withColumnsRenamed({"g": f"g{k}", "e": f"e{k}"}), F.col("level")[k] == F.col(f"g{k}"), "left")
    chosen = keys.select(F.col("level")[0].alias("g"), F.coalesce("e0", "e1", "e2").alias("e")).select("g", "e.centre", "e.white")
    chosen = materialize(chosen, "mcd-chosen")
    vector = F.array(*[F.col("quality")[f] for f in FEATURES])
    judged = own.withColumn("x", vector).join(chosen, "g", "left").withColumn("distance", F.sqrt(_distance()))
    limit = math.sqrt(chi2_quantile(quantile, P))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))
    return judged.withColumn("base_failed", base_failed()).withColumn("kept", kept).drop("g", "level", "x", "centre", "white")


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their own columns. Texts stay where they are scanned."""
    stats = materialize(with_statistics(docs, keep=["lang", "source"]), "quality-stats")
    rows, names = shielded(docs, ["text", "lang", "source"])
    judged = judge(with_statistics(rows), fit(stats), **options)
    return judged.filter("kept").select(*[F.col(n).alias(c) for c, n in names.items()])
