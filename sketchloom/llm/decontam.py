"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. One automaton holds all
items of a part of the benchmark; document words are streamed through it, and the longest match
that ends at each word is tracked. A match of ``window`` words or more contains windows of
consecutive item words, all of whose words are hit; an item of fewer words is a window as a whole.

The benchmark is cut into parts of at most ``part_words`` words, which bounds the broadcast
automaton (about 200 bytes a word); a larger benchmark costs more passes over the documents, one part each. Words
outside the part's vocabulary end every match, so only runs of known words are walked, after a vectorised
look-up. Texts are never moved.

Defined cases: null or wordless documents have no hits, wordless items no windows; equal items are
found under each of their ids, repeated rows of an item once; a null item_id is the empty string.
Empty tables give no hits. The result is one struct ``hits``, which
replaces a column of that name; ``cleaned`` returns the documents' own columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sketchloom.llm import textops
from sketchloom.llm.columns import shielded
from sketchloom.session import materialize

WINDOW = 10
PART_WORDS = 500_000


class Automaton:
    """A generalised suffix automaton over word numbers, with what each window belongs to."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, dtype=np.uint64)
        self.vocabulary, self.window = vocabulary, window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, np.searchsorted(vocabulary, h).tolist()) for name, h in items]
        for _, words in coded:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self._mark(coded)

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """``target`` if it is one word longer than ``state``, else a copy of it that is."""
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return self._split(last, word, known)
        new = self._new(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word, self.next[state][word])
        return new

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """Per state: the ancestor that stands for its last ``window`` words; items by such state; short items on the chain."""
        window, order = self.window, sorted(range(len(self.length)), key=self.length.__getitem__)
        self.full = [-1] * len(self.length)
        for s in order[1:]:
            self.full[s] = -1 if self.length[s] < window else s if self.length[self.link[s]] < window else self.full[self.link[s]]
        self.owners: dict[int, set[str]] = {}
        ends: dict[int, set[str]] = {}
        for name, words in coded:
            state = 0
            for k, word in enumerate(words):
                state = self.next[state][word]
                if k + 1 >= window:
                    self.owners.setdefault(self.full[state], set()).add(name)
            if 0 < len(words) < window:
                ends.setdefault(state, set()).add(name)
        # Each state's list of (words, state of the short item), its own and those of its suffixes.
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.length)
        self.ends, short_length = ends, {}
        for name, words in coded:
            if 0 < len(words) < window:
                state = 0
                for word in words:
                    state = self.next[state][word]
                short_length[state] = len(words)
        for s in order[1:]:
            own = ((short_length[s], s),) if s in short_length else ()
            self.short[s] = own + self.short[self.link[s]]
        self.least = min([window, *short_length.values()])

    def walk(self, words: list[int], hit: np.ndarray, base: int, found: set[int], shorts: set[int]) -> None:
        """Stream known words; ``hit[base + i]`` is set where word ``i`` lies in a window."""
        state, matched, window, covered = 0, 0, self.window, 0
        following, link, length = self.next, self.link, self.length
        for i, word in enumerate(words):
            target = following[state].get(word)
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = following[state].get(word)
            if target is None:
                continue
            state = target
            matched += 1
            if matched >= window:
                found.add(self.full[state])
                low = max(i + 1 - matched, covered)
                hit[base + low : base + i + 1] = True
                covered = i + 1
            for many, end in self.short[state]:
                if many <= matched:
                    shorts.add(end)
                    hit[base + i + 1 - many : base + i + 1] = True


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for block in textops.blocks(pa.array(texts, pa.string())):
        lowered = textops.Block(block.first, textops.LOWER[block.data], block.offsets)
        found = textops.words(lowered, textops.ALNUM)
        hashes = textops.word_hashes(lowered, found)
        out += [hashes[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
    return out


def parts(benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> Iterator[Automaton]:
    """Automata of the benchmark's items, streamed to the driver part by part."""
    batch: list[tuple[str, np.ndarray]] = []
    size = 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct().toLocalIterator():
        words = item_words([row["text"]])[0]
        if batch and size + len(words) > part_words:
            yield Automaton(batch, window)
            batch, size = [], 0
        batch.append((row["item_id"], words))
        size += len(words)
    yield Automaton(batch, window)


HITS = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("rest", T.StringType())]
)


def block_hits(block: textops.Block, automaton: Automaton) -> tuple[textops.Words, np.ndarray, list[set[str]]]:
    lowered = textops.Block(block.first, textops.LOWER[block.data], block.offsets)
    found = textops.words(lowered, textops.ALNUM)
    n = len(found.starts)
    hit, items = np.zeros(n, dtype=bool), [set() for _ in range(len(block.offsets) - 1)]
    if not n or not len(automaton.vocabulary):
        return found, hit, items
    hashes = textops.word_hashes(lowered, found)
    at = np.minimum(np.searchsorted(automaton.vocabulary, hashes), len(automaton.vocabulary) - 1)
    known = automaton.vocabulary[at] == hashes
    # Runs of known words inside one row, at least as long as the shortest window.
    begins = known.copy()
    begins[1:] &= ~known[:-1] | (found.rows[1:] != found.rows[:-1])
    closes = known.copy()
    closes[:-1] &= ~known[1:] | (found.rows[1:] != found.rows[:-1])
    lows, highs = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    enough = highs - lows >= automaton.least
    for low, high in zip(lows[enough].tolist(), highs[enough].tolist(), strict=True):
        full, shorts = set(), set()
        automaton.walk(at[low:high].tolist(), hit, low, full, shorts)
        own = items[found.rows[low]]
        for state in full:
            own |= automaton.owners[state]
        for state in shorts:
            own |= automaton.ends[state]
    return found, hit, items


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW, part_words: int = PART_WORDS, rest: bool = False) -> DataFrame:
    """The documents (or their columns ``keep``) with ``hits``: word and hit counts, item ids, hit byte spans.

    With ``rest`` also the text without the spans, a space in the place of each; null where there are none.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != "hits"]
    both = list(dict.fromkeys([*names, text_col]))
    found = docs.select(*[F.col(f"`{c}`") for c in both])
    for k, automaton in enumerate(parts(benchmark, window, part_words)):
        # Passes are kept apart by written tables: chained in one task, each would hold its automaton.
        found = one_pass(found if not k else materialize(found, "decontam-part"), automaton, text_col, rest)
    return found.select(*[F.col(f"`{c}`") for c in names], "hits")


def one_pass(docs: DataFrame, automaton: Automaton, text_col: str, rest: bool) -> DataFrame:
    """``hits`` of one part of the benchmark, together with those that the documents already carry."""
    names = [c for c in docs.columns if c != "hits"]
    earlier = len(names) < len(docs.columns)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("hits", HITS)])
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for block in textops.blocks(batch.column(text_col)):
                found, hit, items = block_hits(block, shared.value)
                many = len(block.offsets) - 1
                for row, before in enumerate(batch.column("hits").slice(block.first, many).to_pylist() if earlier else []):
                    items[row] |= set(before["items"])
                    for low, high in before["spans"]:
                        base = block.offsets[row]
                        hit[np.searchsorted(found.starts, low + base) : np.searchsorted(found.ends, high + base, side="right")] = True
                made += rows_of(block, found, hit, items, rest)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, ARROW_HITS)], [*names, "hits"])

    return docs.mapInArrow(run, schema)


ARROW_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.list_(pa.int64()))), ("rest", pa.string())])


def rows_of(block: textops.Block, found: textops.Words, hit: np.ndarray, items: list[set[str]], rest: bool) -> list[dict]:
    counts, out = textops.sums(hit.astype(np.int64), found.first).tolist(), []
    for row, hit_words in enumerate(counts):
        spans, left = [], None
        low, high, base = found.first[row], found.first[row + 1], block.offsets[row]
        if hit_words:
            own = np.flatnonzero(hit[low:high]) + low
            cut = np.flatnonzero(np.diff(own) > 1)
            firsts, lasts = own[np.concatenate([[0], cut + 1])], own[np.concatenate([cut, [len(own) - 1]])]
            spans = np.stack([found.starts[firsts] - base, found.ends[lasts] - base], axis=1).tolist()
            if rest:
                cuts = [0, *np.ravel(spans).tolist(), block.offsets[row + 1] - base]
                data = block.data[base : block.offsets[row + 1]].tobytes()
                left = b" ".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)).decode()
        out.append({"n_words": int(high - low), "n_hit": hit_words, "items": sorted(items[row], key=str.encode), "spans": spans, "rest": left})
    return out


def digest(items) -> F.Column:
    """SHA-256 of the sorted item ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


def cleaned(docs: DataFrame, benchmark: DataFrame, most_covered: float = 0.5, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """The documents without the hit spans; those with more than ``most_covered`` of their words hit are dropped.

    A span is replaced by one space. All columns stay; ``text`` is the shortened text and ``n_chars``,
    where it exists, its length.
    """
    rows, names = shielded(docs, ["text", "n_chars"])
    found = with_hits(rows, benchmark, window=window, part_words=part_words, rest=True)
    found = found.filter(F.col("hits.n_hit") <= most_covered * F.col("hits.n_words"))
    changed = {"text": F.coalesce("hits.rest", "text")}
    if "n_chars" in docs.columns:
        own = F.when(F.col("hits.rest").isNull(), F.col("n_chars")).otherwise(F.length("hits.rest"))
        changed["n_chars"] = own.cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, F.col(n)).alias(c) for c, n in names.items()])
