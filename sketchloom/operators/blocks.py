"""All-against-all sketch comparison, block by block.

The usual self-join on the hash multiplies every frequent hash into all pairs of its sets, and sends them. Here
sketches are written once, as files of bounded size, and packed into blocks; a task reads two blocks from there, so that nothing is sent for a hash,
a pair or a pair of blocks, and memory depends only on the block and n. Inside, sketches meet in the posting lists of the hashes that
both blocks have; with a threshold, only in the rarer ones, as in ``simjoin``. The capped walk of a pair is found from the places of its shared
hashes and their neighbours, without going through both sketches.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchloom.operators.sketch import as_sets
from sketchloom.operators.superkmers import spans
from sketchloom.session import materialize, scratch_dir

BLOCK = 16_384  # sketches of a block, at most
SLOTS = 1 << 22  # and their slots, more or less
MEETS = 1 << 21  # shared hashes of pairs that are looked at together
MET = 3  # shared hashes in which a pair is to meet before it is compared
CELLS = 8  # blocks that one task compares with another
TURNED = (3, 5, 4, 0, 2, 1)  # the six sums of a pair seen from its other side

SCHEMA = (
    "name_i string, name_j string, size_i bigint, size_j bigint, total_i bigint, total_j bigint, "
    "common_ij bigint, mass_i_ij bigint, mass_j_ij bigint, common_ji bigint, mass_i_ji bigint, mass_j_ji bigint"
)


def distinct_sketches(entries: DataFrame) -> DataFrame:
    """Group identical sketches: ``(name, representative)``, the representative being the least name.

    Signatures are written, as they are read twice; sketches are neither written nor, as sets, shuffled.
    """
    sets = as_sets(entries).select("name", F.arrays_zip(F.col("hs").alias("h"), F.col("cs").alias("cnt")).alias("content"))
    signed = materialize(sets.select("name", F.sha2(F.to_json("content"), 256).alias("sig")), "signed")
    representative = signed.groupBy("sig").agg(F.min("name").alias("representative"))
    return signed.join(representative, "sig").select("name", "representative")


class Blocks(NamedTuple):
    """Written sketches: the files of each block, and as many groups of pairs of blocks as there are tasks."""

    files: list[list[str]]

    def groups(self, tasks: int) -> list[tuple[int, list[int]]]:
        """``(right, lefts)`` of all pairs of different blocks."""
        many = len(self.files)
        each = min(CELLS, max(1, many * (many - 1) // 2 // max(1, tasks)))
        return [(j, list(range(at, min(at + each, j)))) for j in range(1, many) for at in range(0, j, each)]


def stored_blocks(entries: DataFrame, block: int = BLOCK) -> Blocks:
    """Write sketches as rows ``(name, hs, cs)`` where they lie and pack the files into blocks."""
    spark = entries.sparkSession
    path = os.path.join(scratch_dir(spark), f"blocks-{uuid.uuid4().hex}")
    sets = as_sets(entries).select("name", "hs", "cs")
    sets.write.option("maxRecordsPerFile", block).parquet(path)
    written = spark.read.schema(sets.schema).parquet(path)
    each = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("sets"), F.sum(F.size("hs")).alias("slots"))
    rows = sorted((r["file"], r["sets"], r["slots"]) for r in each.collect())
    # As many blocks as give each task a few pairs of them, where there are some thousand sketches.
    least = math.ceil(2 * math.sqrt(spark.sparkContext.defaultParallelism))
    some = max(min(block, math.ceil(sum(n for _, n, _ in rows) / least)), min(block, 512))
    files, held = [], [math.inf, 0]
    for file, n, slots in rows:
        if held[0] + n > some or held[1] + slots > SLOTS:
            files.append([])
            held = [0, 0]
        files[-1].append(file)
        held = [held[0] + n, held[1] + slots]
    return Blocks(files)


class Block:
    """Sketches of a block: rows of ``hs`` and ``cs`` one after another, and ``keys``, ascending, of row and hash."""

    def __init__(self, files: list[str]):
        parts = []
        for file in files:
            system, path = fs.FileSystem.from_uri(file if "://" in file else "file://" + file.removeprefix("file:"))
            with system.open_input_file(path) as source:
                parts.append(pq.read_table(source, columns=["name", "hs", "cs"]))
        table = pa.concat_tables(parts)
        self.names = pa.chunked_array(table.column("name").chunks, pa.string()).combine_chunks()
        self.raw, self.cs = (np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in table.column(x).chunks)]) for x in ("hs", "cs"))
        self.sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(c.offsets.to_numpy()) for c in table.column("hs").chunks)]).astype(np.int64)
        self.rows = len(self.sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.row = np.repeat(np.arange(self.rows), self.sizes)
        self.totals = sums(self.cs, np.append(self.starts, len(self.cs)))
        self.hs, self.span = self.raw, 0
        self.top = int(self.raw.max(initial=0))

    def spread(self, hs: np.ndarray, span: int) -> None:
        if self.span != span or self.hs is not hs:
            self.hs, self.span, self.keys = hs, span, self.row * span + hs


class Lists:
    """The posting lists of a block: ``rows`` of the sketches with ``values[k]`` from ``first[k]`` to ``first[k + 1]``."""

    def __init__(self, block: Block, slots: np.ndarray | None = None):
        """Of all slots, or of those given, in order."""
        hs = block.hs if slots is None else block.hs[slots]
        order = np.argsort(hs, kind="stable")
        h = hs[order]
        order = order if slots is None else slots[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)
        self.values, self.first = h[at], np.append(at, len(h))
        self.slots, self.rows = order, block.row[order]
        self.mask = (1 << max(10, (8 * len(h)).bit_length())) - 1
        self.seen = np.zeros(self.mask + 1, dtype=bool)
        self.seen[self.values & self.mask] = True

    def find(self, hs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes have a list, and its number."""
        near = np.flatnonzero(self.seen[hs & self.mask])
        at = np.searchsorted(self.values, hs[near])
        met = self.values[np.minimum(at, len(self.values) - 1)] == hs[near]
        return near[met], at[met]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def comparable(one: Block, two: Block) -> None:
    """Give both blocks keys of one span; hashes too large for that are replaced by their ranks."""
    bits, most = max(one.top, two.top).bit_length(), max(one.rows, two.rows).bit_length()
    if bits + most <= 62:
        one.spread(one.raw, 1 << bits)
        two.spread(two.raw, 1 << bits)
        return
    values = np.unique(np.concatenate([one.raw, two.raw]))
    ranks = {id(x): np.searchsorted(values, x.raw) for x in (one, two)}
    for x in (one, two):
        x.spread(ranks[id(x)], 1 << len(values).bit_length())


def rounds(first: Block, second: Block, mine: np.ndarray, other: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Place in the union at which the round of a shared hash starts, if the walk goes over ``first`` and then ``second``.

    ``mine`` and ``other`` are the slots of the hash, ``place`` its own place in the union of both sketches. A round is a run of first-only hashes, then
    one of second-only ones, then possibly a shared one.
    """
    x, y = first.row[mine], second.row[other]
    before = first.hs[np.maximum(mine - 1, 0)]
    upto = np.searchsorted(second.keys, y * second.span + before, side="right")
    inside = upto > second.starts[y]
    last = np.where(inside, second.hs[np.maximum(upto - 1, 0)], -1)
    alone = mine - np.searchsorted(first.keys, x * first.span + last, side="right")
    run = np.where(last == before, 0, alone)
    return np.where(mine > first.starts[x], place - (other - upto) - run, 0)


def capped_sums(one: Block, two: Block, pair: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The first shared hash of each pair, and shared hashes and multiplicities that each direction's capped walk reaches.

    ``i`` and ``j`` are the slots of shared hashes in either block, in order inside each ``pair``. The limit is looked at only where a round starts.
    """
    new = np.ones(len(pair), dtype=bool)
    new[1:] = pair[1:] != pair[:-1]
    first = np.flatnonzero(new)
    nth = np.arange(len(pair)) - np.repeat(first, np.diff(np.append(first, len(pair))))
    place = (i - one.starts[one.row[i]]) + (j - two.starts[two.row[j]]) - nth
    far, out = np.flatnonzero(place > limit), []
    for ahead, behind, a, b in ((one, two, i, j), (two, one, j, i)):
        met = np.ones(len(pair), dtype=bool)
        met[far] = rounds(ahead, behind, a[far], b[far], place[far]) <= limit
        edges = np.append(first, len(pair))
        out += [sums(x, edges) for x in (met.astype(np.int64), np.where(met, one.cs[i], 0), np.where(met, two.cs[j], 0))]
    return first, out


class Probe:
    """Slots of ``block`` in the lists of another: all, and those that a similar pair cannot miss.

    Sketches that reach the threshold with one of at least their size share ``a = ceil(threshold * size)`` hashes or more; by rising length of the lists the
    first ``l = min(MET, a)`` of them have ``a - l`` others behind them. Without a threshold all slots stay.
    """

    def __init__(self, block: Block, lists: Lists, threshold: float):
        self.slot, self.number = lists.find(block.hs)
        row, many = block.row[self.slot], np.diff(lists.first)[self.number]
        self.held = np.bincount(row, minlength=block.rows)
        self.begin = np.cumsum(self.held) - self.held
        self.times = np.ones(block.rows, dtype=np.int64)
        chosen = np.arange(len(row))
        if threshold:
            least = np.maximum(np.ceil(block.sizes * threshold - 1e-6), 1).astype(np.int64)
            self.times = np.minimum(MET, least)
            upto = np.where(self.held >= least, self.held - least + self.times, 0)
            order = np.lexsort((self.number, many, row))
            chosen = np.sort(order[np.arange(len(row)) - self.begin[row] < upto[row]])
        self.chosen, self.row, self.many = chosen, row[chosen], many[chosen]

    def chunks(self) -> Iterator[tuple[int, int]]:
        """Stretches of ``chosen`` that end with a sketch and have some ``MEETS`` meetings."""
        ends = np.flatnonzero(np.append(self.row[1:] != self.row[:-1], True)) + 1 if len(self.row) else np.zeros(0, np.int64)
        upto, at = np.cumsum(self.many)[ends - 1], 0
        while at < len(ends):
            done = int(upto[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(upto, done + MEETS, side="right")))
            yield int(ends[at - 1]) if at else 0, int(ends[end - 1])
            at = end


def shared_slots(one: Block, two: Block, probe: Probe, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For pairs of rows, in slabs: the first pair, and number of pair, slot and slot of every shared hash."""
    upto, at = np.cumsum(probe.held[i]), 0
    while at < len(i):
        end = max(at + 1, int(np.searchsorted(upto, (int(upto[at - 1]) if at else 0) + MEETS, side="right")))
        some, held = i[at:end], probe.held[i[at:end]]
        pair, slot = np.repeat(np.arange(end - at), held), probe.slot[spans(probe.begin[some], held)]
        wanted = j[at:end][pair] * two.span + one.hs[slot]
        found = np.minimum(np.searchsorted(two.keys, wanted), len(two.keys) - 1)
        met = two.keys[found] == wanted
        yield at, pair[met], slot[met], found[met]
        at = end


def candidates(one: Block, two: Block, lists: Lists, probe: Probe, threshold: float, equal: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows that may reach the threshold and how often they met, by chunks; ``equal``: also those of equal size.

    Rows of ``two`` are at least as large. Inside one block a pair comes once, a row with itself included.
    """
    for a, b in probe.chunks():
        left, many = probe.row[a:b], probe.many[a:b]
        at = spans(lists.first[probe.number[probe.chosen[a:b]]], many)
        keys, met = np.unique(np.repeat(left, many) * two.rows + lists.rows[at], return_counts=True)
        i, j = keys // max(two.rows, 1), keys % max(two.rows, 1)
        fits = two.sizes[j] > one.sizes[i]
        if equal:
            fits |= (two.sizes[j] == one.sizes[i]) & ((j >= i) if one is two else True)
        fits &= met >= probe.times[i]
        yield i[fits], j[fits], met[fits]


def meetings(one: Block, two: Block, lists: Lists, probe: Probe) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Number of pair, slot and slot of all shared hashes of all pairs, by chunks."""
    for a, b in probe.chunks():
        left, many = probe.row[a:b], probe.many[a:b]
        at = spans(lists.first[probe.number[a:b]], many)
        slot = np.repeat(probe.slot[a:b], many)
        i, j = np.repeat(left, many), lists.rows[at]
        if one is two:
            some = np.flatnonzero(j >= i)
            at, slot, i, j = at[some], slot[some], i[some], j[some]
        order = np.argsort((i - left[0]) * two.rows + j, kind="stable")
        pair = (i * two.rows + j)[order]
        yield pair, slot[order], lists.slots[at[order]]


def both_ways(one: Block, two: Block, lists: Lists, threshold: float) -> Iterator[tuple[Block, Block, Lists, Probe]]:
    """The lesser sketch of a pair looks for the larger one, so that two blocks are compared from either side."""
    probe = Probe(one, lists, threshold)
    yield one, two, lists, probe
    if one is not two and len(probe.slot):
        met = Lists(one, probe.slot)
        yield two, one, met, Probe(two, met, threshold)


def near_pairs(one: Block, two: Block, lists: Lists, limit: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Rows ``i`` and ``j`` of the pairs that count, and the six sums of :func:`capped_sums`."""
    if not threshold:
        for pair, i, j in meetings(one, two, lists, Probe(one, lists, 0)):
            if len(pair):
                first, counts = capped_sums(one, two, pair, i, j, limit)
                keep = (counts[0] > 0) | (counts[3] > 0)
                yield one.row[i[first]][keep], two.row[j[first]][keep], [c[keep] for c in counts]
        return
    for x, y, held, probe in both_ways(one, two, lists, threshold):
        for i, j, _ in candidates(x, y, held, probe, threshold, y is two):
            for at, pair, a, b in shared_slots(x, y, probe, i, j):
                first, counts = capped_sums(x, y, pair, a, b, limit)
                rows = at + pair[first]
                keep = (counts[0] / x.sizes[i[rows]] >= threshold) | (counts[3] / y.sizes[j[rows]] >= threshold)
                counts, rows = [c[keep] for c in counts], rows[keep]
                if x is one:
                    yield i[rows], j[rows], counts
                else:  # seen from the other side
                    yield j[rows], i[rows], [counts[k] for k in TURNED]


def _each_cell(blocks: Blocks, groups: list[tuple[int, list[int]]], run):
    """``run(left, right, numbers of both, lists of the right one)`` for the pairs of blocks of a task's groups."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0).to_pylist():
                j, lefts = groups[group]
                right, lists, listed = Block(blocks.files[j]), None, None
                for i in lefts:
                    left = right if i == j else Block(blocks.files[i])
                    comparable(left, right)
                    if listed is not right.hs:
                        lists, listed = Lists(right), right.hs
                    yield from run(left, right, (i, j), lists)

    return work


def _dealt(spark: SparkSession, groups: list, work, schema: str) -> DataFrame:
    return spark.range(0, len(groups), 1, max(1, len(groups))).mapInArrow(work, schema)


def pair_table(entries: DataFrame, sets: int, limit: int, block: int = BLOCK, threshold: float = 0.0) -> DataFrame:
    """Every pair of sketches sharing a counted hash (diagonal included), ``name_i <= name_j``.

    ``ij`` columns come from walking i against j, ``ji`` columns the other way round (the capped
    walk is not symmetric): shared hashes, and the multiplicities of i and of j on them. With a ``threshold`` only pairs whose Jaccard index reaches it
    in a direction.
    """

    def run(one: Block, two: Block, numbers: tuple[int, int], lists: Lists) -> Iterator[pa.RecordBatch]:
        names = pa.concat_arrays([one.names, two.names])
        rank = np.empty(len(names), dtype=np.int64)
        rank[pc.sort_indices(names.cast(pa.binary())).to_numpy()] = np.arange(len(names))
        for i, j, counts in near_pairs(one, two, lists, limit, threshold):
            if not len(i):
                continue
            turn = rank[i] > rank[one.rows + j]
            both = lambda a, b: (np.where(turn, b, a), np.where(turn, a, b))
            values = [*both(one.sizes[i], two.sizes[j]), *both(one.totals[i], two.totals[j])]
            values += [np.where(turn, counts[TURNED[k]], counts[k]) for k in range(6)]
            columns = [*(names.take(pa.array(who)) for who in both(i, one.rows + j)), *(pa.array(c, pa.int64()) for c in values)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    blocks, spark = stored_blocks(entries, block), entries.sparkSession
    groups = [(j, [j]) for j in range(len(blocks.files))] + blocks.groups(3 * spark.sparkContext.defaultParallelism)
    return _dealt(spark, groups, _each_cell(blocks, groups, run), SCHEMA)


def forest(one: Block, two: Block, lists: Lists, limit: int, eps: float, root: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect whatever similar pairs of both blocks connect; ``root`` has the rows of one and then, if it is another, of two.

    Pairs that ``root`` connects already are not compared.
    """

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    shift, src, dst = 0 if one is two else one.rows, [], []
    for x, y, held, probe in both_ways(one, two, lists, eps):
        x_from, y_from = (0, shift) if x is one else (shift, 0)
        for i, j, met in candidates(x, y, held, probe, eps, y is two):
            order, size = np.argsort(-met, kind="stable"), 1024
            i, j = i[order], j[order]
            while len(i):
                apart = root[x_from + i] != root[y_from + j]
                i, j = i[apart], j[apart]
                for at, pair, a, b in shared_slots(x, y, probe, i[:size], j[:size]):
                    first, counts = capped_sums(x, y, pair, a, b, limit)
                    rows = at + pair[first]
                    near = rows[(counts[0] / x.sizes[i[rows]] >= eps) | (counts[3] / y.sizes[j[rows]] >= eps)]
                    for u, v in zip((x_from + i[near]).tolist(), (y_from + j[near]).tolist(), strict=True):
                        p, q = find(u), find(v)
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            src.append(u)
                            dst.append(v)
                while not np.array_equal(up := root[root], root):
                    root[:] = up
                i, j, size = i[size:], j[size:], 2 * size
    return src, dst


def link_table(entries: DataFrame, sets: int, limit: int, eps: float, block: int = BLOCK) -> DataFrame:
    """Enough links ``(src, dst)`` to connect whatever pairs with Jaccard >= ``eps`` (either way) would connect.

    A spanning forest of each block replaces its links, and then one of each pair of blocks those between trees that their own
    forests leave apart. Trees are told to the tasks by a number for each sketch.
    """
    blocks, spark = stored_blocks(entries, block), entries.sparkSession

    def inside(one: Block, two: Block, numbers: tuple[int, int], lists: Lists) -> Iterator[pa.RecordBatch]:
        root = np.arange(one.rows)
        src, dst = forest(one, one, lists, limit, eps, root)
        links = [pa.array([one.names.take(pa.array(x, pa.int64())).to_pylist()], pa.list_(pa.string())) for x in (src, dst)]
        yield pa.RecordBatch.from_arrays([pa.array([numbers[0]], pa.int32()), *links, pa.array([root.astype(np.int32).tobytes()], pa.binary())], ["block", "src", "dst", "roots"])

    own = [(j, [j]) for j in range(len(blocks.files))]
    schema = "block int, src array<string>, dst array<string>, roots binary"
    first = materialize(_dealt(spark, own, _each_cell(blocks, own, inside), schema), "own-links")
    trees = {r["block"]: bytes(r["roots"]) for r in first.select("block", "roots").collect()}

    def between(one: Block, two: Block, numbers: tuple[int, int], lists: Lists) -> Iterator[pa.RecordBatch]:
        left, right = (np.frombuffer(trees[x], dtype=np.int32).astype(np.int64) for x in numbers)
        src, dst = forest(one, two, lists, limit, eps, np.concatenate([left, one.rows + right]))
        names = pa.concat_arrays([one.names, two.names])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(x, pa.int64())) for x in (src, dst)], ["src", "dst"])

    groups = blocks.groups(3 * spark.sparkContext.defaultParallelism)
    others = _dealt(spark, groups, _each_cell(blocks, groups, between), "src string, dst string")
    return first.select(F.inline(F.arrays_zip("src", "dst"))).unionByName(others)
