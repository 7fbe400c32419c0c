"""MinHash near-dedup with b-bit signatures: bands, collision-corrected estimates, exact confirmation.

A document is the set of its distinct five-word shingles. Documents of the same set are one class
from the start. 128 minima per class make 32 bands of four; classes that share a band are
candidates. The two low bits of every minimum are packed into four longs; their bit counts give the
similarity, corrected for chance agreement. Pairs whose estimate is over five standard errors below the
threshold, or whose set sizes rule it out, are dropped; the others are confirmed on full sets.
A pair at the threshold misses all bands with probability (1 - 0.75^4)^32 = 5e-6.

Groups are never expanded into pairs. In every round each band bucket tests a few hubs, those that
share most bands with others first, against its members of other components; the links found join
components, and buckets that lie in one component are done. After the first round, in which
thousands of near copies usually join one component, shingles that no other open class has are counted: a
class with too many of them can reach the threshold with none and leaves its buckets. The hubs grow
sixteenfold from round to round, so a bucket is settled after log16(members) rounds at most.

Defined cases: null or wordless text has the empty set and is linked with nothing, as is a row with
a null id (its component is null and it is kept). Rows of one id are documents of their own that
share the id. Empty tables give empty results; further columns travel inside a struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sketchloom.llm import textops
from sketchloom.session import discard, materialize

HASHES, BANDS, BITS = 128, 32, 2
PER_BAND = HASHES // BANDS
LOW = 0x5555555555555555

_random = np.random.default_rng(20240607)
MULTIPLIERS = (_random.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
ADDENDS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
BAND_ODD = (_random.integers(0, 1 << 63, (BANDS, PER_BAND), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def sets_of(block: textops.Block) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and where each row's begin."""
    lowered = textops.LOWER[block.data]
    found = textops.words(block)
    hashes, first = textops.shingles(textops.word_hashes(block, found, lowered), found)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.searchsorted(rows, np.arange(len(first)))


def digests(hashes: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    return [hashlib.md5(hashes[a:b].tobytes()).digest() if b > a else None for a, b in zip(first[:-1], first[1:], strict=True)]


def signatures(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows x bands) and packed low bits (rows x 4 longs) of the non-empty rows."""
    small = (hashes >> np.uint64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(first))
    starts = first[:-1][full]
    bands = np.zeros((len(full), BANDS), dtype=np.uint64)
    packed = np.zeros((len(full), HASHES * BITS // 64), dtype=np.uint64)
    for k in range(HASHES):
        minima = np.minimum.reduceat(small * MULTIPLIERS[k] + ADDENDS[k], starts) if len(full) else np.zeros(0, dtype=np.uint32)
        band, slot = divmod(k, PER_BAND)
        wide = minima.astype(np.uint64)
        bands[:, band] += textops.mixed(wide + np.uint64(1)) * BAND_ODD[band, slot]
        # The high bits of a product are its best ones; mixed, the two lowest are as good as any.
        low = textops.mixed(wide) & np.uint64((1 << BITS) - 1)
        word, shift = divmod(k * BITS, 64)
        packed[:, word] |= low << np.uint64(shift)
    return textops.mixed(bands + np.arange(BANDS, dtype=np.uint64)), packed


SIGNED = "n_shingles bigint, node binary, bands array<bigint>, s0 bigint, s1 bigint, s2 bigint, s3 bigint"


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, node`` (the class: a digest of the set; null if empty), band keys and signature."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textops.blocks(batch.column("text")):
                hashes, first = sets_of(block)
                many = len(first) - 1
                bands, packed = signatures(hashes, first)
                full = np.diff(first) > 0
                at = np.cumsum(full) * BANDS
                band_list = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at]).astype(np.int32)), pa.array(bands.ravel().view(np.int64)))
                whole = np.zeros((many, packed.shape[1]), dtype=np.uint64)
                whole[full] = packed
                longs = [pa.array(whole[:, k].view(np.int64) if many == 1 else np.ascontiguousarray(whole[:, k]).view(np.int64)) for k in range(packed.shape[1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(block.first, many), pa.array(np.diff(first).astype(np.int64)), pa.array(digests(hashes, first), pa.binary()), band_list, *longs],
                    ["id", "n_shingles", "node", "bands", "s0", "s1", "s2", "s3"],
                )

    return rows.mapInArrow(run, f"id {kind}, {SIGNED}")


def set_table(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``node, items`` (the sorted set) of the wanted classes, from the text of one of their rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(wanted.select("id").hint("merge"), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textops.blocks(batch.column("text")):
                hashes, first = sets_of(block)
                items = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(digests(hashes, first), pa.binary()), items], ["node", "items"])

    made = rows.mapInArrow(run, "node binary, items array<bigint>")
    # Two rows of one id can differ in text; of equal ones a single row stays.
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


MISSING = [f"miss{k}" for k in range(4)]


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = 75) -> DataFrame:
    """``pairs(a, b)`` with ``linked``: is 100 * intersection >= threshold * union, on full sets?

    Also how many shingles are in both, and a map of those of ``a`` that ``b`` lacks: 256 bits, one for
    each value of the hash's first byte.
    """
    both = pairs.join(sets.withColumnsRenamed({"node": "b", "items": "right"}), "b").join(sets.withColumnsRenamed({"node": "a", "items": "left"}), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, x_at), (y, y_at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("left"), batch.column("right")))
            x, y = x.view(np.uint64), y.view(np.uint64)
            many = batch.num_rows
            linked, common, maps = np.zeros(many, dtype=bool), np.zeros(many, dtype=np.int64), np.zeros((many, 4), dtype=np.uint64)
            for k in range(many):
                left, right = x[x_at[k] : x_at[k + 1]], y[y_at[k] : y_at[k + 1]]
                found = right[np.minimum(np.searchsorted(right, left), len(right) - 1)] == left
                common[k] = np.count_nonzero(found)
                linked[k] = 100 * common[k] >= threshold * (len(left) + len(right) - common[k])
                first = np.zeros(256, dtype=bool)
                first[left[~found] >> np.uint64(56)] = True
                maps[k] = np.packbits(first).view(np.uint64)
            columns = [pa.array(np.ascontiguousarray(maps[:, k]).view(np.int64)) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked), pa.array(common), *columns], ["a", "b", "linked", "common", *MISSING])

    return both.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary, linked boolean, common bigint, " + ", ".join(f"{c} bigint" for c in MISSING))


def estimate(one: str, other: str) -> Column:
    """Similarity from two signatures: agreement of b-bit values, less what chance gives."""
    differ = F.lit(0)
    for k in range(HASHES * BITS // 64):
        x = F.col(f"{one}s{k}").bitwiseXOR(F.col(f"{other}s{k}"))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LOW)))
    chance = 2.0**-BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """Five standard errors below the threshold."""
    chance = 2.0**-BITS
    agree = threshold + (1 - threshold) * chance
    return threshold - 5 * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)


def join_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(node, label)`` after the links ``(a, b)`` between nodes: the least label reachable.

    Works on the labels that the links touch, one row per linked pair of labels. In each round every
    label goes to its least neighbour and the links are redrawn between the new labels, until none
    is left. Labels are digests and so in random order, which makes the rounds few.
    """
    of = lambda side: links.join(labels.withColumnsRenamed({"node": side, "label": f"{side}l"}), side)
    edges = of("a").join(labels.withColumnsRenamed({"node": "b", "label": "bl"}), "b")
    edges = edges.filter("al <> bl").select(F.greatest("al", "bl").alias("x"), F.least("al", "bl").alias("y")).distinct()
    edges = materialize(edges, "neardup-edges")
    moved = None
    while not edges.isEmpty():
        replaced = [edges] if moved is None else [edges, moved]
        # Every label goes to its least neighbour, where that is less; links are then drawn anew.
        best = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy("x").agg(F.min("y").alias("to")).filter(F.col("to") < F.col("x"))
        if moved is None:
            moved = best
        else:
            further = moved.join(best.select(F.col("x").alias("to"), F.col("to").alias("further")), "to", "left")
            moved = further.select("x", F.coalesce("further", "to").alias("to")).unionByName(best.join(moved.select("x"), "x", "left_anti"))
        moved = materialize(moved, "neardup-moved")
        after = edges
        for side in ("x", "y"):
            after = after.join(best.withColumnsRenamed({"x": side, "to": f"{side}to"}), side, "left").withColumn(f"n{side}", F.coalesce(f"{side}to", side)).drop(f"{side}to")
        after = after.filter("nx <> ny").select(F.greatest("nx", "ny").alias("x"), F.least("nx", "ny").alias("y")).distinct()
        edges = materialize(after, "neardup-edges")
        discard(*replaced)
    discard(edges)
    if moved is None:
        return labels
    new = labels.join(moved.withColumnRenamed("x", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    new = materialize(new, "neardup-labels")
    discard(moved, labels)
    return new


def next_hubs(members: DataFrame, many: int) -> DataFrame:
    """The first ``many`` members of each bucket that have been no hub yet.

    Only so many rows a bucket and task are shuffled: the limit on the rank is applied before.
    """
    rank = F.row_number().over(Window.partitionBy("key").orderBy("turn"))
    hubs = members.filter(~F.col("met")).withColumn("rank", rank).filter(F.col("rank") <= many)
    return hubs.select(*[F.col(f"`{c}`").alias(f"h_{c}") for c in hubs.columns if c not in ("met", "rank")])


def candidates(members: DataFrame, hubs: DataFrame, threshold: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` of hubs and members of their bucket that are in other components and come later.

    Dropped are pairs that set sizes or the shingles that both can have in common rule out, and
    those whose signatures differ too much. After :func:`beside_hub` the bound is sharper: of the first
    hub's shingles a pair has none in common that either lacks. Where the members have their ``bands``, a
    pair is told by the least band that it shares, and not by every one.
    """
    common = F.least("solid", "h_solid", "n_shingles", "h_n_shingles")
    if "apart" in members.columns:
        lacked = F.lit(0)
        for c in MISSING:
            lacked = lacked + F.bit_count(F.col(c).bitwiseOR(F.col(f"h_{c}")))
        common = F.least(common, F.col("centre") - lacked + F.least("apart", "h_apart"))
    reach = 100 * common >= threshold * (F.col("n_shingles") + F.col("h_n_shingles") - common)
    near = estimate("", "h_") >= least_estimate(threshold / 100)
    other = ~F.col("met") & (F.col("turn") > F.col("h_turn")) & (F.col("label") != F.col("h_label"))
    wanted = (F.col("key") == F.col("h_key")) & other & reach & near
    if "bands" in members.columns:
        wanted = wanted & (F.array_min(F.array_intersect("bands", "h_bands")) == F.col("key"))
    return members.join(hubs, wanted).select(F.col("h_node").alias("a"), F.col("node").alias("b")).distinct()


def split(members: DataFrame) -> DataFrame:
    """The members of buckets that still hold several components and untested pairs."""
    unmet = F.count(F.when(~F.col("met"), 1))
    state = members.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), unmet.alias("unmet"))
    return members.join(state.filter((F.col("low") != F.col("high")) & (F.col("unmet") > 1)).select("key"), "key", "left_semi")


def within_reach(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The members that can be linked in their bucket, with ``solid``: shingles that another open class has too.

    Of a set with n shingles, s of them solid, at most s can be common with another; with one of m
    shingles the similarity is s / (n + m - s) at most for m >= s, and s / n for smaller ones.
    """
    nodes = members.select("node").distinct()
    items = sets.join(nodes, "node", "left_semi").select("node", F.explode("items").alias("item"))
    alone = items.groupBy("item").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("node")).filter("many = 1")
    alone = materialize(alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone")), "neardup-alone")
    solid = members.drop("solid").join(alone, "node", "left").withColumn("solid", F.col("n_shingles") - F.coalesce("alone", F.lit(0))).drop("alone")
    solid = materialize(solid, "neardup-solid")
    discard(alone)
    least = solid.groupBy("key").agg(F.min("n_shingles").alias("least"))
    reach = 100 * F.col("solid") >= threshold * (F.col("n_shingles") + F.greatest("least", "solid") - F.col("solid"))
    return solid.join(least, "key").filter(reach).drop("least")


def beside_hub(members: DataFrame, hubs: DataFrame, tested: DataFrame) -> DataFrame:
    """The members with what they lack of their bucket's first hub, and how many solid shingles they have beside it.

    A member that was not compared with the hub counts as lacking none, and all its solid shingles as beside it.
    """
    centre = hubs.select(F.col("h_key").alias("key"), F.col("h_node").alias("a"), F.col("h_n_shingles").alias("centre"))
    known = tested.drop("linked").withColumnsRenamed({"b": "node", "common": "shared"})
    out = members.join(centre, "key").join(known, ["a", "node"], "left")
    own = F.when(F.col("a") == F.col("node"), F.col("centre")).otherwise(F.coalesce("shared", F.lit(0)))
    out = out.withColumns({"apart": F.col("solid") - own, **{c: F.coalesce(c, F.lit(0)) for c in MISSING}})
    return out.drop("a", "shared")


def components(docs: DataFrame, threshold: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, n_shingles, component_id``."""
    return classed(docs, threshold, id_col, text_col).select("id", "n_shingles", "component_id")


def classed(docs: DataFrame, threshold: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The components with each document's class ``node`` and the component's ``label``, which no other has; null if empty."""
    rows = materialize(signed(docs, id_col, text_col), "neardup-signed")
    linked = rows.filter(F.col("node").isNotNull() & F.col("id").isNotNull())
    least = linked.groupBy("node").agg(F.min("id").alias("least"))
    classes = materialize(linked.join(least.withColumnRenamed("node", "c"), (F.col("node") == F.col("c")) & (F.col("id") == F.col("least"))).drop("c", "least").dropDuplicates(["node"]), "neardup-classes")
    banded = classes.select(F.explode("bands").alias("key"), "node", "id", "n_shingles", "s0", "s1", "s2", "s3")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    sharing = materialize(banded.join(shared, "key"), "neardup-sharing")
    seen = sharing.groupBy("node").agg(F.sum("many").alias("seen"), F.first("id").alias("id"))
    seen = materialize(seen, "neardup-seen")
    sets = materialize(set_table(docs, seen.select("node", "id"), id_col, text_col), "neardup-sets")
    labels = seen.select("node", F.col("node").alias("label"))
    turned = sharing.drop("id", "many").join(seen.select("node", F.struct((-F.col("seen")).alias("seen"), "node").alias("turn")), "node")
    members = materialize(turned.withColumns({"label": F.col("node"), "solid": F.col("n_shingles"), "met": F.lit(False)}), "neardup-members")
    discard(sharing)
    many = 1
    while not members.isEmpty():
        hubs = materialize(next_hubs(members, many), "neardup-hubs")
        tested = materialize(confirmed(candidates(members, hubs, threshold), sets, threshold), "neardup-tested")
        labels = join_components(labels, tested.filter("linked").select("a", "b"))
        last = hubs.groupBy("h_key").agg(F.max("h_turn").alias("last"))
        current = members.drop("label").join(labels, "node").join(last, F.col("key") == F.col("h_key"), "left")
        current = split(current.withColumn("met", F.col("met") | F.coalesce(F.col("turn") <= F.col("last"), F.lit(False))).drop("h_key", "last"))
        between = []
        if many == 1:
            between = [materialize(current, "neardup-members")]
            between.append(materialize(beside_hub(within_reach(between[0], sets, threshold), hubs, tested), "neardup-beside"))
            current = split(between[1]).join(classes.select("node", "bands"), "node")
        before, members = members, materialize(current, "neardup-members")
        discard(before, hubs, tested, *between)
        many *= 16
    discard(members, sets)
    full = classes.select("node", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = full.join(full.groupBy("label").agg(F.min("id").alias("component_id")), "label").select(F.col("node").alias("c"), "component_id", "label")
    done = rows.select("id", "n_shingles", "node").join(named, F.col("node") == F.col("c"), "left")
    own = F.when(F.col("node").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return done.select("id", "n_shingles", own.alias("component_id"), "node", "label")


def nodes_of(rows: DataFrame) -> DataFrame:
    """``rows(id, digest, text)`` to ``id, digest, node``."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textops.blocks(batch.column("text")):
                many = len(block.offsets) - 1
                own = [batch.column(c).slice(block.first, many) for c in ("id", "digest")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(digests(*sets_of(block)), pa.binary())], ["id", "digest", "node"])

    return rows.select("id", "digest", "text").mapInArrow(run, f"id {kind}, digest string, node binary")


def deduplicated(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """The document of each component with the least id, with its own columns.

    Rows of one id are told apart by their class: those in other components than the id's own go, and
    of several in one component, or without words, the one with the least text checksum stays. Only rows
    of repeated ids are read for that; rows with a null id all stay.
    """
    found = materialize(classed(docs, threshold), "neardup-found")
    leads = F.max(F.col("id") == F.col("component_id")).alias("leads")
    kept = found.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count(F.lit(1)).alias("rows"), leads)
    kept = materialize(kept.filter("leads").drop("leads"), "neardup-kept")
    own = [F.col(f"`{c}`") for c in docs.columns]
    row = docs.select(F.struct(*own).alias("row"), F.col("doc_id").alias("id"))
    # The table of ids grows with the documents and is no broadcast.
    single = row.join(kept.filter("rows = 1").hint("merge"), "id", "left_semi")
    result = single.unionByName(row.filter("id is null"))
    repeated = kept.filter("rows > 1").select("id")
    if repeated.isEmpty():  # a table that is written already; without such ids the texts need not be moved again
        return result.select("row.*")
    text, empty = F.coalesce(F.col("row.text"), F.lit("")), F.lit(bytearray())
    rows = row.join(repeated, "id", "left_semi").withColumn("digest", F.sha2(text, 256))
    won = found.filter(F.col("id") == F.col("component_id")).join(repeated, "id", "left_semi")
    won = won.select("id", F.coalesce("node", empty).alias("node"), F.coalesce("label", empty).alias("label")).distinct()
    nodes = nodes_of(rows.select("id", "digest", text.alias("text"))).withColumn("node", F.coalesce("node", empty)).distinct()
    labelled = materialize(nodes.join(won, ["id", "node"]).select("id", "digest", "label"), "neardup-labelled")
    order = Window.partitionBy("id", "label").orderBy(F.crc32(F.coalesce(F.col("row.text"), F.lit(""))))
    several = rows.join(labelled, ["id", "digest"]).withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("row", "id")
    return result.unionByName(several).select("row.*")
