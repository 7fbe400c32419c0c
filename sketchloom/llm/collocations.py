"""Phrase collocations: frequent phrases by Rabin-Karp fingerprints, scored by their weakest cut.

1. Texts are packed into compressed blocks once; a longer text is cut between words, and each cut piece
   carries the next words along, so that every phrase begins in one block and lies whole in it.
2. Polynomial prefix sums over the words' hashes give the fingerprint of every phrase of up to ``longest`` words
   of a block (a phrase never leaves its piece of text between marks). Tasks count the fingerprints, cut to as
   few bits as the size of the input allows, and send sorted runs to the part of their high bits. The pointer to
   the occurrences is the packing task that a run comes from.
3. A part adds up; fingerprints below ``min_count`` go. No phrase is lost by that, as a collision only adds. Of the
   others each task gets the list of those that it has, by file.
4. Tasks look at their blocks again. The occurrences of a listed fingerprint are compared, word by word, with the first
   one of the block, and where two texts share a fingerprint they are told apart. Only these phrases become strings,
   counted per block, added up in the task and then, bundled by part, by (language, phrase): the counts are those of texts,
   not of fingerprints, and phrases are rows only once they are added up.

Every part of a frequent phrase is frequent too, so cuts find their counts among the phrases that are left.

Defined cases: null text is empty, null language is ``und``; without words or frequent phrases the result is empty;
repeated rows count as often as they occur; of other columns nothing is read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm import files, textops
from sketchloom.session import materialize

MARKS = np.zeros(256, dtype=bool)
MARKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
LETTERS = ~MARKS
LETTERS[[0x20, 0x09]] = False

BLOCK = 2 << 20
HELD = 4 << 20  # fingerprints that a task holds before it sends them
PART_BYTES = 4 << 20  # of text a part
COUNT_BITS = 24
SALTS = 64

PACKED = pa.schema([("grp", pa.int32()), ("data", pa.binary()), ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("owns", pa.list_(pa.int64()))])


def cut(block: textops.Block, reach: int) -> Iterator[tuple[np.ndarray, int]]:
    """The pieces of one long text, and the bytes of each in which its phrases begin."""
    found = textops.words(block, LETTERS)
    at, size = 0, len(block.data)
    while at < size:
        word = int(np.searchsorted(found.starts, at + BLOCK))
        if word >= len(found.starts):
            yield block.data[at:], size - at
            return
        end = int(found.starts[word])
        yield block.data[at : int(found.ends[min(word + reach, len(found.ends)) - 1])], end - at
        at = end


def packed(docs: DataFrame, reach: int) -> DataFrame:
    """``grp`` (the task that packed), ``data``, and of each text in it language, bytes and own bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, shrink = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            langs = batch.column("lang")
            for block in textops.blocks(batch.column("text"), BLOCK):
                own = langs.slice(block.first, len(block.offsets) - 1).to_pylist()
                sizes = np.diff(block.offsets).tolist()
                pieces = [(block.data, own, sizes, sizes)] if len(block.data) <= BLOCK else [(data, own, [len(data)], [n]) for data, n in cut(block, reach)]
                for data, *lists in pieces:
                    row = [[group], [shrink.compress(data.tobytes())], *([x] for x in lists)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, PACKED, strict=True)], schema=PACKED)

    return materialize(docs.mapInArrow(run, "grp int, data binary, langs array<string>, sizes array<bigint>, owns array<bigint>"), "phrase-blocks")


class Phrases(NamedTuple):
    data: np.ndarray  # lower-cased
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray  # of every word
    lang: np.ndarray  # of every word, an index into `langs`
    langs: list[str]
    left: np.ndarray  # words to the end of the piece, this one included
    own: np.ndarray  # may phrases begin here?


def phrases(data, langs: list[str], sizes: list[int], owns: list[int]) -> Phrases:
    data = textops.LOWER[np.frombuffer(data, dtype=np.uint8)]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    block = textops.Block(0, data, offsets)
    found = textops.words(block, LETTERS)
    many = len(found.starts)
    names = sorted(set(langs))
    code = np.array([names.index(x) for x in langs], dtype=np.int64)
    marks = np.concatenate([[0], np.cumsum(MARKS[data])])
    ends = np.ones(many, dtype=bool)  # is this the last word of its piece?
    if many:
        ends[:-1] = (found.rows[1:] != found.rows[:-1]) | (marks[found.starts[1:]] != marks[found.starts[:-1]])
    lasts = np.flatnonzero(ends)
    left = lasts[np.searchsorted(lasts, np.arange(many))] - np.arange(many) + 1
    own = found.starts - offsets[:-1][found.rows] < np.array(owns, dtype=np.int64)[found.rows]
    return Phrases(data, found.starts, found.ends, textops.word_hashes(block, found), code[found.rows], names, left, own)


def fingerprints(p: Phrases, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words: where its phrases begin, and their 64-bit fingerprints."""
    many = len(p.hashes)
    prefix = np.zeros(many + 1, dtype=np.uint64)
    np.cumsum(p.hashes * textops.powers(many), out=prefix[1:])
    inverse = textops.powers(many, inverse=True)
    names = pa.array(p.langs, pa.string())
    tongue = np.zeros(0, dtype=np.uint64)
    for block in textops.blocks(names):
        tongue = textops.span_hash(textops.prefix_hash(block.data), block.offsets[:-1], block.offsets[1:])
    for n in range(1, longest + 1):
        at = np.flatnonzero(p.own & (p.left >= n))
        yield n, at, textops.mixed((prefix[at + n] - prefix[at]) * inverse[at] + tongue[p.lang[at]] + np.uint64(n))


def counts_of(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    return ordered[at], np.diff(np.append(at, len(ordered)))


RUNS = pa.schema([("part", pa.int32()), ("grp", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def part_edges(parts: int, bits: int) -> np.ndarray:
    return np.array([(k << bits) // parts for k in range(parts)], dtype=np.uint64)


def sent(blocks: DataFrame, longest: int, bits: int, parts: int) -> DataFrame:
    """Sorted runs of counted fingerprints for each part."""
    edges = part_edges(parts, bits)
    most = (1 << COUNT_BITS) - 1

    def flush(group: int, held: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(held)
        every.sort()
        keys, counts = counts_of(every)
        counts = np.minimum(counts, most).astype(np.uint32)
        cuts = np.append(np.searchsorted(keys, edges), len(keys))
        some = np.flatnonzero(np.diff(cuts)).tolist()
        shrink = zstandard.ZstdCompressor(level=1)
        spans = [slice(cuts[k], cuts[k + 1]) for k in some]
        # Gaps between sorted keys are small numbers, whose high planes compress away.
        columns = [some, [group] * len(some), [shrink.compress(textops.planes(np.diff(keys[s], prepend=edges[k]))) for k, s in zip(some, spans, strict=True)]]
        columns.append([shrink.compress(textops.planes(counts[s])) for s in spans])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RUNS, strict=True)], schema=RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, held, size, at = zstandard.ZstdDecompressor(), [], 0, None
        for batch in batches:
            for group, data, langs, sizes, owns in zip(*(batch.column(c) for c in PACKED.names), strict=True):
                if held and (size >= HELD or group.as_py() != at):
                    yield flush(at, held)
                    held, size = [], 0
                at = group.as_py()
                for _, _, prints in fingerprints(phrases(expand.decompress(data.as_py()), langs.as_py(), sizes.as_py(), owns.as_py()), longest):
                    held.append(prints >> np.uint64(64 - bits))
                    size += len(prints)
        if held:
            yield flush(at, held)

    return blocks.mapInArrow(run, "part int, grp int, keys binary, counts binary")


LISTED = pa.schema([("grp", pa.int32()), ("keys", pa.binary())])


def frequent_files(runs: DataFrame, min_count: int, bits: int, parts: int) -> str:
    """Of every group the fingerprints that are frequent in all: written by group. Returns the folder."""
    uri = files.new_folder(runs.sparkSession, "phrase-lists")
    shift = np.uint64(COUNT_BITS)
    edges = part_edges(parts, bits)

    def run(pieces: pa.Table) -> pa.Table:
        expand, edge = zstandard.ZstdDecompressor(), edges[pieces["part"][0].as_py()]
        keys = [np.cumsum(textops.from_planes(expand.decompress(k.as_py()))) + edge for k in pieces["keys"]]
        counts = [textops.from_planes(expand.decompress(c.as_py()), "u4") for c in pieces["counts"]]
        # Key and count in one number: a single sort brings equal keys together.
        every = np.concatenate([((k - edge) << shift) | c for k, c in zip(keys, counts, strict=True)])
        every.sort()
        own = every >> shift
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        often = own[at][np.add.reduceat(every & ((np.uint64(1) << shift) - np.uint64(1)), at) >= min_count] + edge
        groups = pieces["grp"].to_pylist()
        lists: dict[int, list[np.ndarray]] = {}
        for group, some in zip(groups, keys, strict=True):
            if len(often):
                hit = some[often[np.minimum(np.searchsorted(often, some), len(often) - 1)] == some]
                if len(hit):
                    lists.setdefault(group, []).append(hit)
        rows = [(g, np.unique(np.concatenate(x)).tobytes()) for g, x in lists.items()]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(LISTED)], schema=LISTED)

    lists = runs.groupBy("part").applyInArrow(run, "grp int, keys binary")
    lists.repartition("grp").write.partitionBy("grp").parquet(uri)
    return uri


def list_of(uri: str, group: int) -> np.ndarray:
    system, path = files.resolve(f"{uri}/grp={group}")
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return np.zeros(0, dtype=np.uint64)
    rows = dataset.dataset(path, filesystem=system, format="parquet").to_table(["keys"])["keys"]
    return np.unique(np.concatenate([np.frombuffer(k.as_buffer(), dtype=np.uint64) for k in rows]))


def word_numbers(p: Phrases) -> tuple[np.ndarray, pa.Array]:
    """The number of every word, equal for equal words only, and the distinct words: hashes are verified on the bytes."""
    _, first, number = np.unique(p.hashes, return_index=True, return_inverse=True)
    lengths = p.ends - p.starts
    bad = lengths != lengths[first][number]
    ends = np.cumsum(lengths)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
    here = np.repeat(p.starts, lengths) + within
    there = np.minimum(np.repeat(p.starts[first][number], lengths) + within, len(p.data) - 1)
    bad |= textops.sums((p.data[here] != p.data[there]).astype(np.int64), np.concatenate([[0], ends])) > 0
    texts = [p.data[a:b].tobytes() for a, b in zip(p.starts[first].tolist(), p.ends[first].tolist(), strict=True)]
    known: dict[bytes, int] = {}
    for word in np.flatnonzero(bad).tolist():  # words that share a hash with another one
        text = p.data[p.starts[word] : p.ends[word]].tobytes()
        if text not in known:
            known[text] = len(texts)
            texts.append(text)
        number[word] = known[text]
    return number, pa.array(texts, pa.binary()).cast(pa.string())


COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("count", pa.int64())])


ADDED = 1 << 20  # phrases that a task adds up before it sends them

BUNDLES = pa.schema([("part", pa.int32()), ("rows", pa.binary())])


def added(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The counts of all batches held, a row for each phrase."""
    keys = [name for name in held[0].schema.names if name != "count"]
    whole = pa.Table.from_batches(held).group_by(keys).aggregate([("count", "sum")])
    return whole.select([*keys, "count_sum"]).rename_columns([*keys, "count"]).cast(held[0].schema).combine_chunks().to_batches()[0]


def bundled(counts: pa.RecordBatch) -> pa.RecordBatch:
    """The counts of ``part`` and the columns of ``COUNTED`` as a compressed row for each part."""
    ordered = counts.sort_by([(name, "ascending") for name in ("part", "lang", "phrase")])
    numbers = ordered["part"].to_numpy()
    edges = np.append(np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])), len(numbers)).tolist()
    shrink, plain, rows = zstandard.ZstdCompressor(level=1), ordered.select(COUNTED.names), []
    for start, end in zip(edges[:-1], edges[1:], strict=True):
        # Taken, not sliced: a slice would be written with the buffers of all.
        batch, sink = plain.take(pa.array(np.arange(start, end))), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, COUNTED) as writer:
            writer.write_batch(batch)
        rows.append(shrink.compress(sink.getvalue().to_pybytes()))
    return pa.RecordBatch.from_arrays([pa.array(numbers[edges[:-1]], pa.int32()), pa.array(rows, pa.binary())], schema=BUNDLES)


def unbundled(pieces: pa.Table) -> pa.Table:
    """The counts of one part, added up over all tasks."""
    expand = zstandard.ZstdDecompressor()
    return pa.Table.from_batches([added([b for row in pieces["rows"] for b in pa.ipc.open_stream(expand.decompress(row.as_py()))])])


def counted(blocks: DataFrame, uri: str, longest: int, bits: int, parts: int = 1) -> DataFrame:
    """``lang, phrase, words, count`` of the listed phrases; words = 0 counts all words.

    Counts are added up over blocks in the task. As most tasks have most frequent phrases, tasks send them bundled, a row for
    each part of the fingerprints, and phrases become rows when their part is added up.
    """
    edges = part_edges(parts, bits)
    schema = pa.schema([BUNDLES.field("part"), *COUNTED])

    def rows(p: Phrases, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
        number, words = word_numbers(p)
        langs = pa.array(p.langs, pa.string())
        total = np.bincount(p.lang[p.own], minlength=len(p.langs))
        zeros = pa.array([0] * len(p.langs), pa.int32())
        yield pa.RecordBatch.from_arrays([zeros, langs, pa.array([""] * len(p.langs)), zeros, pa.array(total, pa.int64())], schema=schema)
        for n, at, prints in fingerprints(p, longest):
            short = prints >> np.uint64(64 - bits)
            listed = wanted[np.minimum(np.searchsorted(wanted, short), len(wanted) - 1)] == short if len(wanted) else np.zeros(len(short), dtype=bool)
            at, prints = at[listed], prints[listed]
            if not len(at):
                continue
            _, first, group = np.unique(prints, return_index=True, return_inverse=True)
            leader = at[first]
            other = p.lang[at] != p.lang[leader][group]
            for k in range(n):
                other |= number[at + k] != number[leader + k][group]
            count = np.bincount(group[~other], minlength=len(leader))
            apart: dict[tuple, list[int]] = {}
            for place in np.flatnonzero(other).tolist():  # another text of the same fingerprint
                word = at[place]
                apart.setdefault((p.lang[word], *number[word : word + n].tolist()), []).append(place)
            first = np.append(first, np.array([x[0] for x in apart.values()], dtype=np.int64))
            leader = at[first]
            count = np.append(count, np.array([len(x) for x in apart.values()], dtype=np.int64))
            text = pc.binary_join_element_wise(*[words.take(pa.array(number[leader + k])) for k in range(n)], " ")
            # Equal texts have equal fingerprints, so a phrase is in one part.
            part = (np.searchsorted(edges, prints[first] >> np.uint64(64 - bits), side="right") - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), langs.take(pa.array(p.lang[leader])), text, pa.array(np.full(len(leader), n, dtype=np.int32)), pa.array(count)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand, at, wanted = zstandard.ZstdDecompressor(), None, np.zeros(0, dtype=np.uint64)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for group, data, langs, sizes, owns in zip(*(batch.column(c) for c in PACKED.names), strict=True):
                if group.as_py() != at:
                    at = group.as_py()
                    wanted = list_of(uri, at)
                p = phrases(expand.decompress(data.as_py()), langs.as_py(), sizes.as_py(), owns.as_py())
                if len(p.starts):
                    held += rows(p, wanted)
                    if sum(b.num_rows for b in held) >= ADDED:
                        held = [added(held)]
                        if held[0].num_rows > ADDED // 2:
                            yield bundled(held.pop())
        if held:
            yield bundled(added(held))

    bundles = blocks.mapInArrow(run, "part int, rows binary")
    return bundles.groupBy("part").applyInArrow(unbundled, "lang string, phrase string, words int, count bigint")


def frequent(docs: DataFrame, min_count: int, longest: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, phrase, words, count`` of all frequent phrases, and with words = 0 all words of each language."""
    if not 1 <= min_count < 1 << COUNT_BITS:
        raise ValueError(f"min_count must be at least 1 and below {1 << COUNT_BITS}")
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    rows = docs.select(text.alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    # Some sixteen times as many values as phrases, and room for a part's key beside its count.
    bits = min(max(24, math.ceil(math.log2(max(size, 1) * longest / 5)) + 3), 64 - COUNT_BITS + int(math.log2(parts)))
    blocks = packed(rows, longest - 1)
    lists = frequent_files(sent(blocks, longest, bits, parts), min_count, bits, parts)
    found = counted(blocks, lists, longest, bits, parts)
    return materialize(found.filter((F.col("words") == 0) | (F.col("count") >= min_count)), "phrase-counts")


def scored(found: DataFrame) -> DataFrame:
    """``lang, phrase, words, a, l, r, n, score``: each phrase of two words or more, at its lowest-scoring cut."""
    part = found.filter("words > 0").select("lang", "phrase", "count")
    candidates = found.filter("words > 1").select("lang", "phrase", "words", F.col("count").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    join = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = cuts.select("lang", "phrase", "words", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("words")).alias("right"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("count").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("count").alias("r")), ["lang", "right"])
    cuts = cuts.join(found.filter("words = 0").select("lang", F.col("count").alias("n")), "lang")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))
    best = cuts.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def contained(found: DataFrame, share: int = 100) -> DataFrame:
    """``lang, phrase`` of those that lie in a longer frequent phrase with ``share`` percent of their count or more.

    A phrase in between is as frequent as the longer one at least, so those one word longer decide.
    """
    longer = found.filter("words > 2").select("lang", "words", "count", F.split("phrase", " ").alias("w"))
    inner = F.explode(F.array(*[F.array_join(F.slice("w", F.lit(k), F.col("words") - 1), " ") for k in (1, 2)])).alias("phrase")
    most = longer.select("lang", inner, "count").groupBy("lang", "phrase").agg(F.max("count").alias("longer"))
    both = found.filter("words > 1").join(most, ["lang", "phrase"])
    return both.filter(100 * F.col("longer") >= share * F.col("count")).select("lang", "phrase")


def mined(docs: DataFrame, min_count: int = 100, longest: int = 5, most: int = 2000, share: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``most`` phrases of each language."""
    found = frequent(docs, min_count, longest, text_col, lang_col)
    left = scored(found).join(contained(found, share), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # First in slices of a language, so that a language is never ranked whole in one task.
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
