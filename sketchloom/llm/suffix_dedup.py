"""Removal of repeated byte strings: a difference-cover suffix algorithm, bounded to prefixes of 200 bytes.

Every whole text is UTF-8 bytes. A start is repeated if its 200-byte prefix begins at another place
as well, in the same or another document; all bytes of such prefixes are removed.

Positions whose number modulo 91 lies in a difference cover of ten residues are sampled: for any two
positions there is a shift below 91 after which both are sampled, so two equal 200-byte strings
share a sampled 108-byte string. The steps follow the difference-cover construction:

1. Sort sampled triples: a sample's name is that of three consecutive 36-byte strings. Samples of a
   unique name are decided and drop out, which is most of the text.
2. Recurse on names: the rest are sorted by triples of names 91 apart, 290 bytes. Where such a name
   recurs, all 91 starts from it on are repeated.
3. Merge the remaining suffixes: starts near a recurring sample that step 2 left open are sorted by
   their 200-byte prefix, together with those decided starts an open one could equal (one occurrence
   per recurring 290-byte name, and only next to a triple that an open start also has).
4. Compare adjacent prefixes: equal neighbours are repeats.

A name is a 64-bit fingerprint, not a rank: only equality of prefixes is asked for, and sorting by
fingerprints puts equal prefixes side by side without a global order. Texts are packed into blocks
once; a round sends each block's distinct names, byte plane by byte plane, to the bucket of their
high bits, and a bucket answers with bits per name. Answers are written by group of blocks, and
tasks pick up their own; texts are not shuffled. A name that a third of all documents has occurs at
most once a block in its bucket.

Defined cases: null is the empty text; texts shorter than 200 bytes are kept; null or repeated ids
are rows of their own; empty tables give empty results; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm import files, textops
from sketchloom.session import materialize

# A perfect difference set modulo 91.
PERIOD, COVER = 91, (0, 1, 3, 9, 27, 49, 56, 61, 77, 81)

LENGTH = 200
PIECE = 36
TRIPLE = 3 * PIECE  # at most LENGTH - PERIOD + 1
LONG = 2 * PERIOD + TRIPLE  # at least LENGTH + PERIOD - 1
BLOCK = 2 << 20
AGAIN, FIRST, FLAGGED = 1, 2, 4

SAMPLED = np.isin(np.arange(PERIOD), COVER)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def around(positions: np.ndarray, low: int, high: int, size: int) -> np.ndarray:
    """Which of ``size`` places lie from ``low`` up to ``high`` (excluded) of one of ``positions``."""
    steps = np.zeros(size + 1, dtype=np.int32)
    np.add.at(steps, np.clip(positions + low, 0, size), 1)
    np.add.at(steps, np.clip(positions + high, 0, size), -1)
    return np.cumsum(steps)[:size] > 0


class Names:
    """Names at positions of one block, reduced to the distinct ones, and the answers about them."""

    def __init__(self, positions: np.ndarray, names: np.ndarray, flags: np.ndarray | None = None):
        self.positions = positions
        self.distinct, self.first, self.inverse, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
        self.local = counts > 1
        self.flags = np.bincount(self.inverse, flags, len(self.distinct)) > 0 if flags is not None else np.zeros(len(self.distinct), dtype=bool)

    def again(self, bits: np.ndarray) -> np.ndarray:
        return self.positions[(((bits & AGAIN) > 0) | self.local)[self.inverse]]

    def flagged(self, bits: np.ndarray) -> np.ndarray:
        return self.positions[((bits & FLAGGED) > 0)[self.inverse]]

    def elected(self, bits: np.ndarray) -> np.ndarray:
        """The one occurrence that speaks for its name among recurring names."""
        return self.positions[self.first[((bits & FIRST) > 0) & (((bits & AGAIN) > 0) | self.local)]]


class Survey:
    """What is known of one block after the answers ``bits`` so far; ``ask`` holds the next question."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, bits: list[np.ndarray]):
        size = len(data)
        prefix = textops.prefix_hash(data)
        ends = np.repeat(offsets[1:], np.diff(offsets))
        name = lambda p, length: textops.span_hash(prefix, p, p + length)

        def triples(p: np.ndarray) -> np.ndarray:
            parts = [name(p + k * PIECE, PIECE) * _ODD[k] for k in range(3)]
            return textops.mixed(parts[0] + parts[1] + parts[2])

        self.matched = np.zeros(size, dtype=bool)
        p = np.flatnonzero(np.resize(SAMPLED, size))
        p = p[p + TRIPLE <= ends[p]]
        self.ask = one = Names(p, triples(p))
        if not bits:
            return
        again = one.again(bits[0])
        q = again[again + LONG <= ends[again]]
        self.ask = two = Names(q, textops.mixed(triples(q) * _ODD[0] + triples(q + PERIOD) * _ODD[1] + triples(q + 2 * PERIOD) * _ODD[2]))
        if len(bits) == 1:
            return
        self.matched = around(two.again(bits[1]), 0, PERIOD, size)
        opened = around(again, 1 - PERIOD, 1, size) & ~self.matched & (np.arange(size) + LENGTH <= ends)
        before = np.concatenate([[0], np.cumsum(opened)])
        has_open = before[again + 1] > before[np.maximum(again - PERIOD + 1, 0)]
        self.ask = three = Names(again, triples(again), has_open)
        if len(bits) == 2:
            return
        near_open = around(three.flagged(bits[2]), 1 - PERIOD, 1, size)
        sent = np.flatnonzero(opened | (around(two.elected(bits[1]), 0, PERIOD, size) & near_open))
        self.ask = four = Names(sent, name(sent, LENGTH))
        if len(bits) == 3:
            return
        self.matched[four.again(bits[3])] = True

    def removed(self) -> np.ndarray:
        return around(np.flatnonzero(self.matched), 0, LENGTH, len(self.matched))


ROUNDS = 4


def packed_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Whole texts in compressed blocks: ``grp, block, data, ids, sizes``. A group is what one task packed."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, shrink = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for block in textops.blocks(batch.column("text"), BLOCK):
                many = len(block.offsets) - 1
                row = {"grp": [group], "block": [number], "data": [shrink.compress(block.data.tobytes())]}
                row |= {"ids": [batch.column("id").slice(block.first, many).to_pylist()], "sizes": [np.diff(block.offsets).tolist()]}
                number += 1
                yield pa.RecordBatch.from_pydict(row, SCHEMA)

    return materialize(rows.mapInArrow(run, "grp int, block int, data binary, ids array<bigint>, sizes array<bigint>"), "suffix-blocks")


SCHEMA = pa.schema([("grp", pa.int32()), ("block", pa.int32()), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def answers_of(uri: str, group: int) -> dict[int, np.ndarray]:
    """The bits for each block of a group, in the order of the block's distinct names."""
    system, path = files.resolve(f"{uri}/grp={group}")
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    table = dataset.dataset(path, filesystem=system, format="parquet").to_table(["block", "bucket", "bits"]).sort_by([("block", "ascending"), ("bucket", "ascending")])
    found: dict[int, list[bytes]] = {}
    for block, bits in zip(table["block"].to_pylist(), table["bits"].to_pylist(), strict=True):
        found.setdefault(block, []).append(bits)
    return {block: np.frombuffer(b"".join(some), dtype=np.uint8) for block, some in found.items()}


def surveys(batches: Iterator[pa.RecordBatch], uris: list[str]) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray, Survey]]:
    expand, at, known = zstandard.ZstdDecompressor(), None, []
    for batch in batches:
        for group, block, data, ids, sizes in zip(*(batch.column(c) for c in SCHEMA.names), strict=True):
            group, block = group.as_py(), block.as_py()
            if group != at:
                at, known = group, [answers_of(uri, group) for uri in uris]
            data = np.frombuffer(expand.decompress(data.as_py()), dtype=np.uint8)
            offsets = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())]).astype(np.int64)
            none = np.zeros(0, dtype=np.uint8)
            yield group, block, ids.as_py(), data, offsets, Survey(data, offsets, [k.get(block, none) for k in known])


def asked(blocks: DataFrame, uris: list[str], buckets: int) -> DataFrame:
    """Every block's distinct names in sorted order, cut into buckets of their high bits."""
    edges = np.array([(k << 64) // buckets for k in range(buckets)], dtype=np.uint64)
    schema = pa.schema([("grp", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("names", pa.binary()), ("flags", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, block, _, _, _, survey in surveys(batches, uris):
            names, flags = survey.ask.distinct, survey.ask.flags
            cuts = np.append(np.searchsorted(names, edges), len(names))
            some = np.flatnonzero(np.diff(cuts))
            columns = {
                "grp": [group] * len(some),
                "block": [block] * len(some),
                "bucket": some.tolist(),
                "names": [textops.planes(names[cuts[k] : cuts[k + 1]]) for k in some],
                "flags": [np.packbits(flags[cuts[k] : cuts[k + 1]]).tobytes() if flags.any() else b"" for k in some],
            }
            yield pa.RecordBatch.from_pydict(columns, schema)

    return blocks.mapInArrow(run, "grp int, block int, bucket int, names binary, flags binary")


ANSWER = pa.schema([("grp", pa.int32()), ("block", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])


def answered(bucket: pa.Table) -> pa.Table:
    """Sort a bucket's names and compare neighbours: does a name recur, which entry is first, is any flagged?

    The first is that of the least block, in whatever order rows arrive: a task that runs again elects the same entry.
    """
    group, block = bucket["grp"].to_numpy(), bucket["block"].to_numpy()
    turn = np.lexsort((block, group))
    packed, marks = list(bucket["names"]), list(bucket["flags"])
    names = [textops.from_planes(packed[k].as_buffer()) for k in turn]
    sizes = np.array([len(n) for n in names])
    flags = [np.unpackbits(np.frombuffer(f.as_buffer(), dtype=np.uint8), count=k).astype(bool) if len(f.as_buffer()) else np.zeros(k, dtype=bool) for f, k in zip([marks[k] for k in turn], sizes.tolist(), strict=True)]
    every, flag = np.concatenate(names), np.concatenate(flags)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    starts = np.ones(len(ordered), dtype=bool)
    starts[1:] = ordered[1:] != ordered[:-1]
    begins = np.flatnonzero(starts)
    runs = np.diff(np.append(begins, len(ordered)))
    bits = np.repeat((runs > 1) * AGAIN, runs) | starts * FIRST | np.repeat(np.logical_or.reduceat(flag[order], begins) * FLAGGED, runs)
    out = np.empty(len(every), dtype=np.uint8)
    out[order] = bits
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    parts = [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.Table.from_arrays([pa.array(group[turn]), pa.array(block[turn]), bucket["bucket"], pa.array(parts, pa.binary())], schema=ANSWER)


def answer_files(blocks: DataFrame, uris: list[str], buckets: int) -> str:
    """One round: ask, answer in buckets, and write the answers by group. Returns their folder."""
    uri = files.new_folder(blocks.sparkSession, "suffix-answers")
    bits = asked(blocks, uris, buckets).groupBy("bucket").applyInArrow(answered, "grp int, block int, bucket int, bits binary")
    bits.repartition("grp").write.partitionBy("grp").parquet(uri)
    return uri


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Per document: id, counts, digest of the kept bytes, removed ``spans`` and the ``kept`` bytes.

    Kept bytes are binary: a cut may fall inside a letter. Without ``texts`` both are null.
    """
    spark = docs.sparkSession
    blocks = packed_blocks(docs, id_col, text_col)
    groups = blocks.select("grp").distinct().count()
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), groups)
    uris: list[str] = []
    for _ in range(ROUNDS):
        uris.append(answer_files(blocks, uris, buckets))
    schema = pa.schema(
        [(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ids, data, offsets, survey in surveys(batches, uris):
            gone = survey.removed()
            left = ~gone
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offsets[:-1][np.diff(offsets) > 0]
            begins[inner] = gone[inner]
            lost, runs = textops.sums(gone.astype(np.int64), offsets), textops.sums(begins.astype(np.int64), offsets)
            digests, spans, rest = [], [], []
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                kept = (data[a:b][left[a:b]] if lost[row] else data[a:b]).tobytes()
                digests.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    firsts = np.flatnonzero(begins[a:b])
                    ends = np.flatnonzero(gone[a:b] & np.append(left[a + 1 : b], True)) + 1 if b > a else firsts
                    spans.append(np.stack([firsts, ends], axis=1).tolist())
                    rest.append(kept)
            none = [None] * len(digests)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip([ids, np.diff(offsets), lost, runs, digests, spans if texts else none, rest if texts else none], schema, strict=True)], schema=schema
            )

    return blocks.mapInArrow(run, f"{id_col} bigint, {RESULT}, spans array<array<bigint>>, kept binary")
