"""Source divergence audit: how do the words of each source of a language differ from other sources and from the language?

Terms are runs of letters (A-Z lower-cased). The counting packs them by length: terms of up to 8 bytes are
one big-endian uint64, those of up to 16 bytes two, both radix-sorted on 16-bit digits and run-counted in
numpy; longer ones lie in a bucket for each padded width and are sorted as bytes. No term holds a zero byte,
so the padding is unambiguous and packed order is byte order.

1. Tasks count their texts by (term, lang, source), with the number of documents, and send sorted packed
   runs to the part of the term's hash. A term that every document has is one run per task and group.
2. A part merges its runs, sees all groups of a term at once, and keeps it for the languages where it is in
   ``min_docs`` documents or more. Totals follow from the kept counts.
3. ``p = 1 + floor(scale * (count + 2) / (N + 2 V))`` for each group and for the language, in exact integers.
4. Divergence of two sources is a sum over all kept terms. Only terms that both have are paired, inside a
   task, slab by slab, and come out as sums per pair of sources. The other terms have the same value on
   one side: they follow from the number of terms at each value of p.

Defined cases: null text, language and source count as ''; a document without terms still makes its group occur;
repeated rows count as often as they occur; without kept terms every pair has value 0 and there are no term rows; an
empty table gives empty results. Only the three named columns are read, whatever else the documents have.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm import textops
from sketchloom.session import materialize

# Terms of `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
LETTERS[0x80:] = True

BLOCK = 4 << 20
HELD = 1 << 20  # counted terms that a task holds before it sends them
PART_BYTES = 32 << 20  # of text a part: its runs are merged in one task
PAIRS = 1 << 21  # pairs of sources that a slab expands
SCALE = 1_000_000_000


class Runs(NamedTuple):
    """Counted terms of one width: ``words`` are uint64 columns (or one fixed-width byte column), then group, count, documents."""

    words: tuple[np.ndarray, ...]
    group: np.ndarray
    count: np.ndarray
    docs: np.ndarray


def radix_order(keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """The stable order of unsigned columns, the most significant first: 16 bits a pass, from the least."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for shift in range(0, 8 * key.dtype.itemsize, 16):
            digit = (key >> key.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # numpy's stable sort of 16 bits is a radix sort
    return order


def in_order(words: tuple[np.ndarray, ...], group: np.ndarray) -> np.ndarray:
    """By term, then group."""
    if words[0].dtype.kind == "u":
        return radix_order((*words, group))
    order = radix_order((group,))
    return order[np.argsort(words[0][order], kind="stable")]


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where a run of rows that are equal in all columns begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    if len(new):
        new[1:] = False
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def merged(words: tuple[np.ndarray, ...], group: np.ndarray, count: np.ndarray, docs: np.ndarray) -> Runs:
    """Equal terms of one group summed up, in order."""
    order = in_order(words, group)
    words, group = tuple(w[order] for w in words), group[order]
    at = starts_of(*words, group)
    if not len(at):
        return Runs(words, group, count, docs)
    return Runs(tuple(w[at] for w in words), group[at], np.add.reduceat(count[order], at), np.add.reduceat(docs[order], at))


def width_of(lengths: np.ndarray) -> np.ndarray:
    """1 and 2 for that many uint64; beyond, the padded width in bytes: multiples of 8 to 64, then powers of two."""
    whole = -(-lengths // 8)
    wide = np.where(whole <= 8, 8 * whole, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    return np.where(whole <= 2, whole, wide)


def packed_terms(block: textops.Block) -> Iterator[tuple[int, tuple[np.ndarray, ...], np.ndarray]]:
    """``width, words, row`` of all terms of a block."""
    found = textops.words(block, LETTERS)
    if not len(found.starts):
        return
    lengths = found.ends - found.starts
    widths = width_of(lengths)
    data = np.concatenate([textops.LOWER[block.data], np.zeros(24, dtype=np.uint8)])
    # The eight bytes from every position on, by doubling.
    eight = data.astype(np.uint64)
    for step in (1, 2, 4):
        eight = (eight[:-step] << np.uint64(8 * step)) | eight[step:]
    for width in np.unique(widths).tolist():
        some = np.flatnonzero(widths == width)
        starts, left = found.starts[some], lengths[some]
        if width <= 2:
            words = []
            for k in range(width):
                unused = np.clip(8 * (k + 1) - left, 0, 7).astype(np.uint64) * np.uint64(8)
                words.append((eight[starts + 8 * k] >> unused) << unused)
        else:
            table = np.zeros((len(some), width), dtype=np.uint8)
            ends = np.cumsum(left)
            within = np.arange(ends[-1]) - np.repeat(ends - left, left)
            table[np.repeat(np.arange(len(some)), left), within] = data[np.repeat(starts, left) + within]
            words = [table.view(f"S{width}").ravel()]
        yield width, tuple(words), found.rows[some]


def counted(block: textops.Block, groups: np.ndarray) -> Iterator[tuple[int, Runs]]:
    """The block's terms by group, with the number of documents; ``groups`` has each row's group."""
    turn = np.argsort(groups, kind="stable")
    rank = np.empty(len(groups), dtype=np.uint32)
    rank[turn] = np.arange(len(groups), dtype=np.uint32)
    for width, words, rows in packed_terms(block):
        ranks = rank[rows]
        runs = merged(words, ranks, np.ones(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64))
        # A run is a document; runs of one group lie side by side.
        group = groups[turn][runs.group].astype(np.uint32)
        at = starts_of(*runs.words, group)
        yield width, Runs(tuple(w[at] for w in runs.words), group[at], np.add.reduceat(runs.count, at), np.diff(np.append(at, len(group))))


def hashed(words: tuple[np.ndarray, ...]) -> np.ndarray:
    if words[0].dtype.kind == "S":
        width = words[0].dtype.itemsize
        words = tuple(np.ascontiguousarray(words[0]).view(">u8").reshape(-1, width // 8).astype(np.uint64).T)
    out = np.zeros(len(words[0]), dtype=np.uint64)
    for w in words:
        out = textops.mixed(out ^ w)
    return out


PIECES = pa.schema(
    [("part", pa.int32()), ("width", pa.int32()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string()))]
    + [(c, pa.binary()) for c in ("terms", "groups", "counts", "docs")]
)
SENT = "part int, width int, langs array<string>, sources array<string>, terms binary, groups binary, counts binary, docs binary"


def term_bytes(words: tuple[np.ndarray, ...]) -> bytes:
    return b"".join(textops.planes(w) for w in words) if words[0].dtype.kind == "u" else np.ascontiguousarray(words[0]).tobytes()


def term_words(data, width: int) -> tuple[np.ndarray, ...]:
    if width > 2:
        return (np.frombuffer(data, dtype=f"S{width}"),)
    whole = np.frombuffer(data, dtype=np.uint8)
    return tuple(textops.from_planes(c) for c in np.split(whole, width))


class Tally:
    """Counted terms of a task; packed pieces for each part come out when many are held."""

    def __init__(self, parts: int):
        self.parts, self.runs, self.size = parts, {}, 0
        self.names: dict[tuple[str, str], int] = {}

    def code(self, name: tuple[str, str]) -> int:
        return self.names.setdefault(name, len(self.names))

    def add(self, width: int, runs: Runs) -> Iterator[pa.RecordBatch]:
        self.runs.setdefault(width, []).append(runs)
        self.size += len(runs.group) * max(1, width // 8)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        names = list(self.names)
        for width, held in self.runs.items():
            words = tuple(np.concatenate(c) for c in zip(*(r.words for r in held), strict=True))
            runs = merged(words, *(np.concatenate([r[k] for r in held]) for k in (1, 2, 3)))
            part = ((hashed(runs.words) >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.append(starts_of(part[order]), len(part))
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = order[a:b]
                used, group = np.unique(runs.group[own], return_inverse=True)
                rows.append(
                    (int(part[own[0]]), width, [names[k][0] for k in used], [names[k][1] for k in used], term_bytes(tuple(w[own] for w in runs.words)))
                    + tuple(textops.planes(c.astype(np.uint32)) for c in (group, runs.count[own], runs.docs[own]))
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)
        self.runs, self.size = {}, 0


def plain(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    named = {"text": text_col, "lang": lang_col, "source": source_col}
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in named.items()])


def strings(words: tuple[np.ndarray, ...]) -> pa.Array:
    """Packed terms as strings."""
    if words[0].dtype.kind == "u":
        table = np.stack(words, axis=1).astype(">u8").view(np.uint8).reshape(len(words[0]), 8 * len(words))
    else:
        table = np.ascontiguousarray(words[0]).view(np.uint8).reshape(len(words[0]), words[0].dtype.itemsize)
    letters = table != 0
    ends = np.concatenate([[0], np.cumsum(np.count_nonzero(letters, axis=1))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(table), [None, pa.py_buffer(ends), pa.py_buffer(table[letters])]).cast(pa.string())


KEPT = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("total", pa.int64()), ("lead", pa.bool_())])


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """``part, lang, source, term, count, total, lead`` of every kept term and group that has it.

    ``total`` is the term's count in the language, ``lead`` true in one row of each language and term.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(parts)
        for batch in batches:
            codes = np.array([tally.code(x) for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], dtype=np.int64)
            for block in textops.blocks(batch.column("text"), BLOCK):
                for width, runs in counted(block, codes[block.first : block.first + len(block.offsets) - 1]):
                    yield from tally.add(width, runs)
        yield from tally.flush()

    def merge(pieces: pa.Table) -> pa.Table:
        names: dict[tuple[str, str], int] = {}
        by_width: dict[int, list[Runs]] = {}
        for row in range(pieces.num_rows):
            width = pieces["width"][row].as_py()
            own = np.array([names.setdefault(x, len(names)) for x in zip(pieces["langs"][row].as_py(), pieces["sources"][row].as_py(), strict=True)], dtype=np.uint32)
            group, count, seen = (textops.from_planes(pieces[c][row].as_buffer(), "u4") for c in ("groups", "counts", "docs"))
            by_width.setdefault(width, []).append(Runs(term_words(pieces["terms"][row].as_buffer(), width), own[group], count.astype(np.int64), seen.astype(np.int64)))
        # Groups in the order of their languages, so that a term's rows of one language lie side by side.
        ordered = sorted(names)
        place = np.empty(len(names), dtype=np.uint32)
        place[[names[x] for x in ordered]] = np.arange(len(ordered))
        tongues = {x: k for k, x in enumerate(dict.fromkeys(lang for lang, _ in ordered))}
        lang_of = np.array([tongues[lang] for lang, _ in ordered], dtype=np.int64)
        langs, sources = (pa.array([x[k] for x in ordered], pa.string()) for k in (0, 1))
        part, tables = pieces["part"][0].as_py(), []
        for held in by_width.values():
            words = tuple(np.concatenate(c) for c in zip(*(r.words for r in held), strict=True))
            group, count, seen = (np.concatenate([r[k] for r in held]) for k in (1, 2, 3))
            runs = merged(words, place[group], count, seen)
            at = starts_of(*runs.words, lang_of[runs.group])
            sizes = np.diff(np.append(at, len(runs.group)))
            often = np.repeat(np.add.reduceat(runs.docs, at) >= min_docs, sizes)
            lead = np.zeros(len(runs.group), dtype=bool)
            lead[at] = True
            total = np.repeat(np.add.reduceat(runs.count, at), sizes)[often]
            many = int(np.count_nonzero(often))
            columns = [pa.array(np.full(many, part, dtype=np.int32)), langs.take(pa.array(runs.group[often])), sources.take(pa.array(runs.group[often]))]
            columns += [strings(tuple(w[often] for w in runs.words)), pa.array(runs.count[often]), pa.array(total), pa.array(lead[often])]
            tables.append(pa.Table.from_arrays(columns, schema=KEPT))
        return pa.concat_tables(tables)

    sent = docs.select("lang", "source", "text").mapInArrow(run, SENT)
    return materialize(sent.groupBy("part").applyInArrow(merge, "part int, lang string, source string, term string, count bigint, total bigint, lead boolean"), "divergence-terms")


def share(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(scale * (count + 2) / (n + 2 v))``, exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 2), wide(n + 2 * v))


def distance(p: str, q: str) -> Column:
    """``floor((p - q)^2 / (p + q))``: shares are below 2^31, so the square fits."""
    gap = F.col(p) - F.col(q)
    return F.call_function("div", gap * gap, F.col(p) + F.col(q))


PAIRED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class PairSums:
    """Sums per pair of sources, over whole terms."""

    def __init__(self):
        self.names: dict[tuple[str, str], int] = {}
        self.keys, self.values, self.size = [], [], 0

    def codes(self, rows: pa.Table) -> np.ndarray:
        lang, source = (rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        both = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        some, inverse = np.unique(both, return_inverse=True)
        langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
        return np.array([self.names.setdefault((langs[k // len(sources)], sources[k % len(sources)]), len(self.names)) for k in some.tolist()])[inverse]

    def add(self, rows: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Rows of whole terms, each from where ``begins`` says: every source with those after it, slab by slab."""
        code, p, none = self.codes(rows), rows["p"].to_numpy(), rows["none"].to_numpy()
        sizes = np.diff(np.append(begins, len(code)))
        partners = np.repeat(begins + sizes, sizes) - np.arange(len(code)) - 1
        before = np.concatenate([[0], np.cumsum(partners)])
        row = 0
        while row < len(code):
            end = max(row + 1, int(np.searchsorted(before, before[row] + PAIRS, side="right")) - 1)
            one = np.repeat(np.arange(row, end), partners[row:end])
            other = one + 1 + np.arange(len(one)) - np.repeat(before[row:end] - before[row], partners[row:end])
            value = gap(p[one], p[other]) - gap(p[one], none[other]) - gap(none[one], p[other]) + gap(none[one], none[other])
            self.keys.append((code[one] << 32) | code[other])
            self.values.append(value)
            self.size += len(one)
            if self.size >= PAIRS:
                self.reduce()
                if self.size >= PAIRS // 2:
                    yield from self.flush()
            row = end

    def reduce(self) -> None:
        keys, inverse = np.unique(np.concatenate(self.keys), return_inverse=True)
        total = np.zeros(len(keys), dtype=np.int64)
        np.add.at(total, inverse, np.concatenate(self.values))
        self.keys, self.values, self.size = [keys], [total], len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self.reduce()
            lang, source = (pa.array([x[k] for x in self.names], pa.string()) for k in (0, 1))
            one, other = pa.array(self.keys[0] >> 32), pa.array(self.keys[0] & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([lang.take(one), source.take(one), source.take(other), pa.array(self.values[0])], schema=PAIRED)
        self.keys, self.values, self.size = [], [], 0


def shared_terms(rows: DataFrame) -> DataFrame:
    """``lang, source, item, value``: what the terms that both sources have add to what they would if each were absent.

    ``rows(part, lang, source, term, p, none)``: ``none`` is the share of an absent term. Tasks read the terms of their
    parts in order and send a sum per pair, in one direction only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, carried = PairSums(), None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if carried is None else pa.concat_tables([carried, pa.Table.from_batches([batch])])
            if not held.num_rows:
                continue
            columns = [held[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term")]
            begins = starts_of(*columns)
            last = int(begins[-1])  # the last term may go on in the next batch
            if last:
                yield from sums.add(held.slice(0, last), begins[:-1])
            carried = held.slice(last)
        if carried is not None:
            yield from sums.add(carried, np.zeros(1, dtype=np.int64))
        yield from sums.flush()

    ordered = rows.repartition("part").sortWithinPartitions("lang", "term").select("lang", "source", "term", "p", "none")
    return ordered.mapInArrow(run, "lang string, source string, item string, value bigint")


def audit(docs: DataFrame, min_docs: int = 10, ranks: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank``: distances between sources, and the terms that stand out in each source."""
    rows = plain(docs, text_col, lang_col, source_col)
    kept = kept_terms(rows, min_docs)
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.sum(F.col("lead").cast("bigint")).alias("leads"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left")
    groups = materialize(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n", "leads")]), "divergence-groups")
    langs = groups.groupBy("lang").agg(F.sum("leads").alias("v"), F.sum("n").alias("all"))
    zero = F.lit(0).cast("bigint")
    groups = groups.drop("leads").join(langs, "lang").withColumn("none", F.when(F.col("v") > 0, share(zero, F.col("n"), F.col("v"))))
    groups = materialize(groups, "divergence-shares")
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))
    shares = shares.withColumn("q", share(F.col("total"), F.col("all"), F.col("v")))

    # Every pair of sources of a language has a row in the result: the base is as large as that.
    other = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"))
    base = groups.join(other, "lang").filter("source <> item")
    base = base.select("lang", "source", "item", F.when(F.col("v") > 0, F.col("v") * distance("none", "item_none")).otherwise(zero).alias("value"))
    values = shares.groupBy("lang", "source", "p", "none").agg(F.count(F.lit(1)).alias("terms"))
    single = values.join(other, "lang").filter("source <> item")
    single = single.withColumn("value", F.col("terms") * (distance("p", "item_none") - distance("none", "item_none"))).select("lang", "source", "item", "value")
    one_way = single.unionByName(shared_terms(shares.select("part", "lang", "source", "term", "p", "none")))
    one_way = one_way.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    back = one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    pairs = base.unionByName(one_way).unionByName(back).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), distance("p", "q").alias("value"), F.lit("term").alias("part"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    ranked = pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= ranks))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
