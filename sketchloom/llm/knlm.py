"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped arrays.

Tokens are the lower-cased (A-Z) words of a text and one end. Four jobs over the whole input:

1. Words are counted. Each shard of the hash space becomes a file of sorted word hashes and counts;
   a word's number is its rank over all shards.
2. Bigrams are counted. Their keys are the two word numbers run through an invertible 64-bit mix, so keys
   spread evenly over the shards, however frequent a word is, and two bigrams never share one.
   Each shard becomes a file of sorted keys and counts.
3. The shards are read back for what smoothing needs: per context how many bigrams occur once,
   twice, and more often; per word how many contexts it follows. Each vocabulary shard gets a file.
4. Texts are scored: workers map the files they need and look up the sorted distinct keys of a block.

Before each shuffle a task sums up equal keys, and sends sorted keys as byte planes. Only the lists of
files and a few sums come to the driver. Files are named by attempt and listed in written tables.

The model: p(w|h) = max(c(hw) - D(c), 0) / c(h) + g(h) p(w), with g(h) the mass that the discounts
free; p(w) is the same formula on counts of contexts, down to 1 / (V + 1) for each word and the unknown
one. A context that was never seen leaves p(w). Discounts follow the counts of counts of each order; where
these are 0 (tiny corpora) a discount is half its count.

Defined cases: null text is empty and is its end only; without training rows p(w) = 1 / (V + 1) = 1; null ids
are not trained on; repeated rows count as often as they occur; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sketchloom.llm import files, textops
from sketchloom.session import materialize

BLOCK = 2 << 20
HELD = 1 << 20  # keys a task sums up before it sends them
SHARD_BYTES = 32 << 20  # of text a shard: its pieces are summed up in one task
END, BEGIN = np.uint64(0x8A5CD789635D2DFF), np.uint64(0x121FD2155C472F96)
_UNSHIFT = (31, 27, 30)
_UNTIMES = (pow(0x94D049BB133111EB, -1, 1 << 64), pow(0xBF58476D1CE4E5B9, -1, 1 << 64))


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`textops.mixed`."""
    for k, shift in enumerate(_UNSHIFT):
        y = x
        for _ in range(64 // shift):
            y = x ^ (y >> np.uint64(shift))
        x = y * np.uint64(_UNTIMES[k]) if k < 2 else y
    return x


class Tokens(NamedTuple):
    words: np.ndarray  # distinct hashes
    word: np.ndarray  # of every token, an index into `words`
    before: np.ndarray  # index of the token before; BEGIN's at a text's start
    first: np.ndarray  # where each text's tokens begin; one more than texts


def tokens(block: textops.Block) -> Tokens:
    lowered = textops.LOWER[block.data]
    found = textops.words(block)
    hashes = textops.word_hashes(block, found, lowered)
    many = len(block.offsets) - 1
    sequence = np.full(len(hashes) + many, END, dtype=np.uint64)
    sequence[np.arange(len(hashes)) + found.rows] = hashes
    words, word = np.unique(np.append(sequence, BEGIN), return_inverse=True)
    first = found.first + np.arange(many + 1)
    before = np.concatenate([word[-1:], word[:-2]])
    before[first[:-1]] = word[-1]
    return Tokens(words, word[:-1], before, first)


# -- counting ----------------------------------------------------------------------------------


class Tally:
    """Keys and counts summed up in a task; sorted pieces per shard come out when many are held."""

    def __init__(self, shards: int):
        self.edges = np.array([(k << 64) // shards for k in range(shards)], dtype=np.uint64)
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)
        if self.size >= HELD:
            keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [keys], [counts], len(keys)
            if self.size >= HELD // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        keys, counts = summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.size = [], [], 0
        cuts = np.append(np.searchsorted(keys, self.edges), len(keys))
        some = np.flatnonzero(np.diff(cuts))
        parts = [(textops.planes(keys[cuts[k] : cuts[k + 1]]), textops.planes(counts[cuts[k] : cuts[k + 1]].astype(np.uint32))) for k in some]
        yield pa.RecordBatch.from_pydict({"shard": some.tolist(), "keys": [a for a, _ in parts], "counts": [b for _, b in parts]}, PIECES)


PIECES = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def write_arrays(uri: str, *arrays: np.ndarray) -> None:
    """Arrays one after the other behind their lengths in bytes; see :func:`arrays_of`."""
    with files.create(uri) as out:
        out.write(np.array([len(arrays), *(a.nbytes for a in arrays)], dtype="<u8").tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).data if a.nbytes else b"")


@functools.lru_cache(maxsize=1 << 14)
def _mapped(uri: str) -> np.ndarray:
    path = files.local_path(uri)
    if path is not None:
        return np.memmap(path, dtype=np.uint8, mode="r")
    return _fetched(uri)


@functools.lru_cache(maxsize=8)
def _fetched(uri: str) -> np.ndarray:
    with files.open_stream(uri) as stream:
        return np.frombuffer(stream.read(), dtype=np.uint8)


def arrays_of(uri: str, *kinds: str) -> list[np.ndarray]:
    """The file's arrays, memory-mapped where the shared folder is mounted."""
    data = _mapped(uri) if files.local_path(uri) is not None else _fetched(uri)
    many = int(data[:8].view("<u8")[0])
    sizes, at, out = data[8 : 8 + 8 * many].view("<u8").tolist(), 8 + 8 * many, []
    for size, kind in zip(sizes, kinds, strict=True):
        piece = data[at : at + size]
        out.append(np.ndarray(size // np.dtype(kind).itemsize, dtype=kind, buffer=piece) if size else np.zeros(0, dtype=kind))
        at += size
    return out


SHARDS = "shard int, path string, size bigint, total bigint, c1 bigint, c2 bigint, c3 bigint, c4 bigint"
SHARD_SCHEMA = pa.schema([("shard", pa.int32()), ("path", pa.string())] + [(c, pa.int64()) for c in ("size", "total", "c1", "c2", "c3", "c4")])


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(counts == k)) for k in (1, 2, 3, 4)]


def shard_row(shard: int, path: str, size: int, counts: np.ndarray) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(SHARD_SCHEMA.names, [shard, path, size, int(counts.sum()), *counts_of_counts(counts)], strict=True))], SHARD_SCHEMA)


def counted(pieces: DataFrame, folder: str, tag: str) -> DataFrame:
    """Each shard's pieces summed up and written to a file: sorted keys, counts below 255, and the larger ones apart."""

    def run(part: pa.Table) -> pa.Table:
        shard = part["shard"][0].as_py()
        keys = np.concatenate([textops.from_planes(k.as_buffer()) for k in part["keys"]])
        counts = np.concatenate([textops.from_planes(k.as_buffer(), "u4") for k in part["counts"]])
        keys, counts = summed(keys, counts)
        path = f"{folder}/{tag}-{shard:05d}-{uuid.uuid4().hex}.bin"
        large = np.flatnonzero(counts >= 255)
        write_arrays(path, keys, np.minimum(counts, 255).astype(np.uint8), large.astype(np.uint32), counts[large].astype(np.int64))
        return shard_row(shard, path, len(keys), counts)

    return materialize(pieces.groupBy("shard").applyInArrow(run, SHARDS), f"lm-{tag}")


def keys_and_counts(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return tuple(arrays_of(path, "u8", "u1", "u4", "i8"))


class Table:
    """Look-ups in the shard files: where sorted keys are, and their counts."""

    def __init__(self, paths: dict[int, str], sizes: dict[int, int], shards: int):
        self.paths, self.shards = paths, shards
        self.edges = np.array([(k << 64) // shards for k in range(shards)], dtype=np.uint64)
        self.base, total = {}, 0
        for k in range(shards):
            self.base[k] = total
            total += sizes.get(k, 0)
        self.size = total

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For ascending keys: the rank over all shards (-1 if missing) and the count (0)."""
        ranks, counts = np.full(len(keys), -1, dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        cuts = np.append(np.searchsorted(keys, self.edges), len(keys))
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            if shard in self.paths:
                own = slice(cuts[shard], cuts[shard + 1])
                stored, small, large, values = keys_and_counts(self.paths[shard])
                at = np.minimum(np.searchsorted(stored, keys[own]), len(stored) - 1)
                hit = stored[at] == keys[own]
                n = small[at].astype(np.int64)
                many = np.flatnonzero(n == 255)
                n[many] = values[np.minimum(np.searchsorted(large, at[many]), len(large) - 1)] if len(large) else n[many]
                ranks[own] = np.where(hit, at + self.base[shard], -1)
                counts[own] = np.where(hit, n, 0)
        return ranks, counts

    def shard_of(self, ranks: np.ndarray) -> Iterator[tuple[int, slice]]:
        """For ascending ranks: the shards they are in and their places."""
        cuts = np.append(np.searchsorted(ranks, [self.base[k] for k in range(self.shards)]), len(ranks))
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            yield shard, slice(cuts[shard], cuts[shard + 1])


def table_of(written: DataFrame, shards: int) -> tuple[Table, list]:
    """The list of files, one row a shard, and its rows."""
    rows = written.collect()
    return Table({r["shard"]: r["path"] for r in rows}, {r["shard"]: r["size"] for r in rows}, shards), rows


def discounts(c1: int, c2: int, c3: int, c4: int) -> np.ndarray:
    """For counts 0, 1, 2 and more."""
    y = c1 / (c1 + 2 * c2) if c1 and c2 else None
    out = [0.0]
    for k, (low, high) in enumerate(((c1, c2), (c2, c3), (c3, c4)), 1):
        d = k - (k + 1) * y * high / low if y is not None and low and high else k / 2
        out.append(min(max(d, 0.0), float(k)))
    return np.array(out)


class Model(NamedTuple):
    words: Table
    bigrams: Table
    stats: dict[int, str]  # per shard of the words: once, twice, more (of bigrams it begins), contexts it follows
    train_tokens: int
    vocabulary: int
    upper: np.ndarray  # discounts of bigrams
    lower: np.ndarray  # of words by contexts
    contexts: int  # all bigram types
    types: np.ndarray  # words that follow one, two, more contexts


def _text(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("text"))


def shards_of(texts: DataFrame) -> int:
    """Shards grow with the input, so that what one of them holds does not."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(16, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    spark = docs.sparkSession
    folder = files.new_folder(spark, "lm")
    texts = _text(docs, text_col)
    shards = shards_of(texts)

    def word_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(shards)
        for batch in batches:
            for block in textops.blocks(batch.column("text"), BLOCK):
                t = tokens(block)
                counts = np.bincount(t.word, minlength=len(t.words))
                counts[np.searchsorted(t.words, BEGIN)] = len(t.first) - 1
                yield from tally.add(t.words, counts)
        yield from tally.flush()

    kind = "shard int, keys binary, counts binary"
    words, rows = table_of(counted(texts.mapInArrow(word_pieces, kind), folder, "words"), shards)
    _, begins = words.find(np.array([BEGIN]))
    shared_words = spark.sparkContext.broadcast(words)

    def bigram_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(shards)
        for batch in batches:
            for block in textops.blocks(batch.column("text"), BLOCK):
                t = tokens(block)
                ids = shared_words.value.find(t.words)[0].astype(np.uint64)
                keys = textops.mixed((ids[t.before] << np.uint64(32)) | ids[t.word])
                yield from tally.add(*summed(keys, np.ones(len(keys), dtype=np.int64)))
        yield from tally.flush()

    written = counted(texts.mapInArrow(bigram_pieces, kind), folder, "bigrams")
    bigrams, pairs = table_of(written, shards)

    def smoothing_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                keys, small, _, _ = keys_and_counts(path)
                plain = unmixed(np.array(keys))
                context, word = (plain >> np.uint64(32)).astype(np.int64), (plain & np.uint64(0xFFFFFFFF)).astype(np.int64)
                ids = np.union1d(context, word)
                at, n = np.searchsorted(ids, context), np.minimum(small, 3)
                parts = [np.bincount(at[n == k], minlength=len(ids)) for k in (1, 2, 3)] + [np.bincount(np.searchsorted(ids, word), minlength=len(ids))]
                stats = np.stack(parts, axis=1).astype(np.uint32)
                own = list(shared_words.value.shard_of(ids))
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": [s for s, _ in own],
                        "keys": [textops.planes((ids[p] - shared_words.value.base[s]).astype(np.uint32)) for s, p in own],
                        "counts": [textops.planes(np.ascontiguousarray(stats[p].T).ravel()) for s, p in own],
                    },
                    PIECES,
                )

    def smoothed(part: pa.Table) -> pa.Table:
        shard, pieces = part["shard"][0].as_py(), []
        ids = [textops.from_planes(k.as_buffer(), "u4") for k in part["keys"]]
        for own, c in zip(ids, part["counts"], strict=True):
            pieces.append(textops.from_planes(c.as_buffer(), "u4").reshape(4, len(own)))
        size = len(keys_and_counts(shared_words.value.paths[shard])[0])
        every, total = np.concatenate(ids), np.zeros((4, size), dtype=np.int64)
        for k in range(4):
            total[k] = np.bincount(every, weights=np.concatenate([p[k] for p in pieces]), minlength=size)
        path = f"{folder}/smoothing-{shard:05d}-{uuid.uuid4().hex}.bin"
        write_arrays(path, *total)
        # Of the words' contexts: how many there are, and words with one to four of them.
        return shard_row(shard, path, int(np.count_nonzero(total[3])), total[3])

    spread = written.select("path").repartition(shards, "path")
    stats = materialize(spread.mapInArrow(smoothing_pieces, kind).groupBy("shard").applyInArrow(smoothed, SHARDS), "lm-smoothing").collect()
    both = [[sum(r[f"c{k}"] for r in some) for k in (1, 2, 3, 4)] for some in (pairs, stats)]
    c = both[1]
    followers = sum(r["size"] for r in stats)
    return Model(
        words,
        bigrams,
        {r["shard"]: r["path"] for r in stats},
        sum(r["total"] for r in rows) - int(begins[0]),
        max(0, words.size - 1),
        discounts(*both[0]),
        discounts(*c),
        sum(r["size"] for r in pairs),
        np.array([c[0], c[1], followers - c[0] - c[1]]),
    )


# -- scoring -----------------------------------------------------------------------------------


def block_scores(block: textops.Block, m: Model) -> tuple[np.ndarray, ...]:
    """Tokens, known tokens, base score and model score of every text."""
    t = tokens(block)
    ids, counts = m.words.find(t.words)
    base = np.log10((counts + 1) / (m.train_tokens + m.vocabulary + 1))
    # Per distinct word: mass its discounts free as a context, and its probability by contexts.
    free, lower = np.ones(len(ids)), np.full(len(ids), 1.0 / (m.vocabulary + 1))
    if m.contexts:
        lower *= (m.lower[1:] * m.types).sum() / m.contexts
    known = np.flatnonzero(ids >= 0)
    known = known[np.argsort(ids[known], kind="stable")]
    for shard, own in m.words.shard_of(ids[known]):
        at = known[own]
        once, twice, more, contexts = (np.asarray(a[ids[at] - m.words.base[shard]], dtype=float) for a in arrays_of(m.stats[shard], "i8", "i8", "i8", "i8"))
        free[at] = (m.upper[1] * once + m.upper[2] * twice + m.upper[3] * more) / counts[at]
        lower[at] += (contexts - m.lower[np.minimum(contexts, 3).astype(int)]) / m.contexts
    before, word = ids[t.before], ids[t.word]
    pair = np.flatnonzero((before >= 0) & (word >= 0))
    keys = textops.mixed((before[pair].astype(np.uint64) << np.uint64(32)) | word[pair].astype(np.uint64))
    distinct, inverse = np.unique(keys, return_inverse=True)
    n = m.bigrams.find(distinct)[1]
    higher = np.zeros(len(word))
    seen = n[inverse]
    higher[pair] = (seen - m.upper[np.minimum(seen, 3)]) / counts[t.before[pair]]
    score = np.log10(higher + free[t.before] * lower[t.word])
    return np.diff(t.first), textops.sums((counts > 0)[t.word].astype(np.int64), t.first), np.add.reduceat(base[t.word], t.first[:-1]), np.add.reduceat(score, t.first[:-1])


SCORES = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with token counts, the add-one base score and the model's log10 probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    head = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textops.blocks(batch.column("text_"), BLOCK):
                many = len(block.offsets) - 1
                n, known, base, score = block_scores(block, shared.value)
                total = np.full(many, shared.value.train_tokens, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(block.first, many) for c in keep), pa.array(n), pa.array(known), pa.array(total), pa.array(base), pa.array(score)],
                    [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("text_")).mapInArrow(run, f"{head}, {SCORES}")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(True))
