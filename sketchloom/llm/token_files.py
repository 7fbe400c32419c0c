"""Token ids as fixed-width packed binary files with random access.

Each id takes the least number of bits that holds the vocabulary. A file has blocks of ``BLOCK_IDS``
ids, each starting at a byte, then an index and a footer:

    blocks | offset of every block, and the end (u64) | document ids (i64) | null flags (u8)
           | first id of every document, and the total (u64) | footer: bits, ids a block,
             blocks, documents, position of the index, magic (6 x u64)

Any id is found from its number: block ``n // BLOCK_IDS``, bit ``n % BLOCK_IDS * bits``. Blocks
unpack with numpy, without a loop over ids.

Documents are range-partitioned by id and each range becomes one file, so the files in order are the
documents in order. Tasks name files by attempt and the written table of files lists only those of
attempts that succeeded, so a lost executor leaves at most an unlisted file behind.

Defined cases: null text is empty and is its end id only; null document ids come last; equal ids
are ordered by text; empty tables give no files; further columns are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sketchloom.llm import files, textops
from sketchloom.session import materialize

BLOCK_IDS = 1 << 16
BLOCK = 4 << 20  # bytes of text encoded together
MAGIC = int.from_bytes(b"PKTOKEN1", "little")


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    single = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(single.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=count).astype("<u4")
    single = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (single.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


class Writer:
    """Streams documents' ids into one file; holds one block and the index."""

    def __init__(self, uri: str, bits: int):
        self.out, self.bits = files.create(uri), bits
        self.rest, self.waiting, self.offsets, self.at = [], 0, [0], 0
        self.docs, self.starts = [], [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            every = np.concatenate(self.rest)
            whole = len(every) // BLOCK_IDS * BLOCK_IDS
            for low in range(0, whole, BLOCK_IDS):
                self._block(every[low : low + BLOCK_IDS])
            self.rest, self.waiting = [every[whole:]], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        for values, kind in (
            (self.offsets, "<u8"),
            ([d or 0 for d in self.docs], "<i8"),
            ([d is None for d in self.docs], "u1"),
            (self.starts, "<u8"),
            ([self.bits, BLOCK_IDS, len(self.offsets) - 1, len(self.docs), self.at, MAGIC], "<u8"),
        ):
            self.out.write(np.array(values, dtype=kind).tobytes())
        self.out.close()


class Reader:
    """Random access to one file; only the index is held."""

    def __init__(self, uri: str):
        self.file = files.open_random(uri)
        size = self.file.size()
        bits, block, blocks, docs, at, magic = np.frombuffer(self.file.read_at(48, size - 48), dtype="<u8").tolist()
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        self.bits, self.block = bits, block
        index = self.file.read_at(size - 48 - at, at)
        cuts = np.cumsum([0, 8 * (blocks + 1), 8 * docs, docs, 8 * (docs + 1)])
        part = [index[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.offsets = np.frombuffer(part[0], dtype="<u8").astype(np.int64)
        missing = np.frombuffer(part[2], dtype="u1")
        self.docs = [None if m else d for d, m in zip(np.frombuffer(part[1], dtype="<i8").tolist(), missing.tolist(), strict=True)]
        self.starts = np.frombuffer(part[3], dtype="<u8").astype(np.int64)
        self._held: tuple[int, np.ndarray] = (-1, np.zeros(0, dtype="<u4"))

    def _unpacked(self, k: int) -> np.ndarray:
        if self._held[0] != k:
            low, high = int(self.offsets[k]), int(self.offsets[k + 1])
            count = min(self.block, int(self.starts[-1]) - k * self.block)
            self._held = (k, unpack(self.file.read_at(high - low, low), count, self.bits))
        return self._held[1]

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids number ``low`` to ``high`` (excluded) of the file."""
        some = [self._unpacked(k)[max(low - k * self.block, 0) : high - k * self.block] for k in range(low // self.block, -(-high // self.block))]
        return np.concatenate(some) if some else np.zeros(0, dtype="<u4")

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


# Texts are cut at these bytes before their pieces are encoded.
PIECES = np.ones(256, dtype=bool)
PIECES[[0x20, 0x0A]] = False


class Encoder:
    """The ids of texts, remembering those of words.

    For tokenizers that lower-case, split at white space and part letters from marks, as the one named here does: a
    text's ids are those of its pieces between spaces and line breaks, and a piece not seen before
    can follow from its lower-case form or from the word before a comma or full stop. A piece with an
    added token in it, in whatever casing, is encoded as it is: the library looks for those before it
    lower-cases. A block's distinct pieces are looked up once each. At most ``most`` pieces are remembered.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.vocabulary = self.tokenizer.get_vocab_size()
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        self.known: dict[bytes, bytes] = {}

    def base(self, piece: str) -> str:
        """The lower-case word before a comma or full stop, which has the same ids."""
        if self.added.search(piece):
            return piece
        low = piece.lower() if piece.isascii() else piece
        if low[-1] in ",." and low[-2:-1].isalpha() and low[-2] < "\u0250":
            return low[:-1]
        return low

    def pieces(self, some: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces, as 32-bit bytes."""
        found = list(map(self.known.get, some))
        if None not in found:
            return found
        missing = [k for k, ids in enumerate(found) if ids is None]
        texts = [some[k].decode() for k in missing]
        bases = [self.base(text) for text in texts]
        wanted = {".", ","}.union(bases)
        new = {word: self.known.get(word.encode()) for word in wanted}
        fresh = [word for word, ids in new.items() if ids is None]
        for word, encoded in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False), strict=True):
            new[word] = array("I", encoded.ids).tobytes()
        if len(self.known) + len(missing) + len(fresh) > self.most:
            self.known.clear()
        self.known.update((word.encode(), new[word]) for word in fresh if len(word) <= 64)
        for k, text, base in zip(missing, texts, bases, strict=True):
            found[k] = new[base] if len(text) == len(base) else new[base] + new[text[-1]]
            if len(text) <= 64:
                self.known[some[k]] = found[k]
        return found

    def ids(self, block: textops.Block, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts, each with the end id, and where each text's begin."""
        cut, data, many = textops.words(block, PIECES), block.data.tobytes(), len(block.offsets) - 1
        _, at, which = np.unique(textops.word_hashes(block, cut), return_index=True, return_inverse=True)
        found = self.pieces([data[a:b] for a, b in zip(cut.starts[at].tolist(), cut.ends[at].tolist(), strict=True)])
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        every, begins = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes) - sizes
        own = sizes[which]
        last = np.concatenate([[0], np.cumsum(own)])
        ids = every[np.repeat(begins[which] - last[:-1], own) + np.arange(last[-1])]
        per_text = last[cut.first]
        starts = per_text + np.arange(many + 1)
        out = np.full(len(ids) + many, end_id, dtype="<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(many), np.diff(per_text))] = ids
        return out, starts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept for its later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


FILES = "part int, path string, n_docs bigint, n_ids bigint"


def write(docs: DataFrame, tokenizer: str, end_id: int, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written table of files in order: ``part, path, n_docs, n_ids``."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = files.new_folder(spark, "tokens")
    order = [F.col("id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(parts, order[0]).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, path = TaskContext.get().partitionId(), None, ""
        encode = encoder(tokenizer)
        for batch in batches:
            if writer is None and batch.num_rows:
                path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.bin"
                writer = Writer(path, width(encode.vocabulary))
            for block in textops.blocks(batch.column("text"), BLOCK):
                ids, starts = encode.ids(block, end_id)
                for k, doc_id in enumerate(batch.column("id").slice(block.first, len(starts) - 1).to_pylist()):
                    writer.add(doc_id, ids[starts[k] : starts[k + 1]])
        if writer is not None:
            writer.close()
            made = {"part": [part], "path": [path], "n_docs": [len(writer.docs)], "n_ids": [writer.starts[-1]]}
            yield pa.RecordBatch.from_pydict(made, pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return materialize(ranged.mapInArrow(run, FILES), "token-files")


def read(spark: SparkSession, written: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Every document of the files: id, ``start`` (ids before it in all files), ``n_tokens``, ``ids_crc32``.

    Only the table of files is ordered to add up where each begins; the ids are read a block at a time.
    """
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    based = materialize(written.withColumn("base", F.coalesce(before, F.lit(0))), "token-bases")
    count = based.count()
    schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                reader = Reader(path)
                crcs = [zlib.crc32(reader.document(k).tobytes()) for k in range(len(reader.docs))]
                yield pa.RecordBatch.from_arrays([pa.array(reader.docs, pa.int64()), pa.array(reader.starts[:-1] + base), pa.array(np.diff(reader.starts)), pa.array(crcs, pa.int64())], schema=schema)

    spread = based.repartition(max(1, count), "part")
    return spread.mapInArrow(run, f"{id_col} bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
