"""FASTA by byte ranges, as a Spark data source: a chromosome is many rows, read by many tasks.

Files are cut into ranges of ``step`` bytes; a partition is a range, or a run of short neighbouring ones. A range tells from the bytes before it
whether it begins inside a header, finds its own record starts, and gives its letters in pieces of
``piece``, each with ``overlap`` letters of what follows, also beyond the range. A piece that goes on in a record of an
earlier range has no header yet; :func:`with_records` fills it in from the last header before it, which needs one
small row per range. Compressed files have no ranges: one task streams each of them in the same way.

Rows: ``path, name`` (base name), ``record`` (header, or null), ``start`` (of the range), ``place`` (byte of the
record's first letter in this range), ``at`` (letters of the range before this piece), ``own``, ``seq``. A letter whose
first byte lies in the range is its own. A row without own letters carries the header of a record that begins here
with nothing behind it. Headers longer than 64 KB are refused; text before the first header counts as a record without one.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sketchloom.functions.seq import PIECE
from sketchloom.session import materialize, small_or_shuffled

STEP = 32 << 20
RUN = 32 << 20  # bytes of neighbouring ranges that one task reads, at most, where ranges are shorter
HEADER = 64 << 10
TAIL = 16 << 10
BATCH = 4 << 20  # letters a batch
CODECS = {".gz": "gzip", ".bz2": "bz2", ".zst": "zstd"}

SCHEMA = pa.schema(
    [("path", pa.string()), ("name", pa.string()), ("record", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("at", pa.int64()), ("own", pa.int32()), ("seq", pa.string())]
)
COLUMNS = "path string, name string, record string, start bigint, place bigint, at bigint, own int, seq string"


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri.removeprefix("file:")))


def codec_of(path: str) -> str | None:
    return CODECS.get(os.path.splitext(path)[1])


class Bytes:
    """Any stretch of a file; of a compressed one, stretches that move forward by ``step`` and look back ``HEADER`` bytes."""

    def __init__(self, uri: str):
        system, path = resolve(uri)
        codec = codec_of(path)
        self.file = None if codec else system.open_input_file(path)
        self.stream = system.open_input_stream(path, compression=codec) if codec else None
        self.held, self.base = bytearray(), 0

    def get(self, a: int, b: int) -> bytes:
        if self.file is not None:
            self.file.seek(min(a, self.file.size()))
            return self.file.read(b - a)
        while self.base + len(self.held) < b and (more := self.stream.read(1 << 20)):
            self.held += more
        return bytes(self.held[a - self.base : b - self.base])

    def forget(self, upto: int) -> None:
        if self.stream is not None and upto > self.base:
            del self.held[: upto - self.base]
            self.base = upto

    def close(self) -> None:
        (self.file or self.stream).close()


def inside_header(source: Bytes, start: int) -> bool:
    before = source.get(max(0, start - HEADER), start)
    line = before.rfind(b"\n")
    if line < 0:  # a line that began further back is no header: those are shorter
        return start <= HEADER and before[:1] == b">"
    return before[line + 1 : line + 2] == b">"


def segments(source: Bytes, start: int, end: int) -> Iterator[tuple[str | None, int, bytes, bool]]:
    """``header, place, body, open`` of the records in a range; ``open`` if the body may go on behind it."""
    data = source.get(start, end)
    end = start + len(data)
    at = 0
    if start and inside_header(source, start):
        at = data.find(b"\n") + 1
        if not at:
            return
    line_start = at > 0 or start == 0 or source.get(start - 1, start) == b"\n"
    header, body = None, at
    following = at if line_start and data[at : at + 1] == b">" else data.find(b"\n>", max(at - 1, 0)) + 1 or -1
    while following >= 0:
        if following > body or header is not None:
            yield header, start + body, data[body:following], False
        close = data.find(b"\n", following)
        if close < 0:
            rest = source.get(end, end + HEADER)
            stop = rest.find(b"\n")
            if stop < 0 and len(rest) == HEADER:
                raise ValueError("a header of more than 64 KB")
            line, body = data[following:] + (rest[:stop] if stop >= 0 else rest), len(data)
        else:
            line, body = data[following:close], close + 1
        if len(line) > HEADER:
            raise ValueError("a header of more than 64 KB")
        header = line[1:].rstrip(b"\r").decode("utf-8", "replace")
        following = data.find(b"\n>", max(body - 1, 0)) + 1 or -1
    if body < len(data) or header is not None:
        yield header, start + body, data[body:], body < len(data)


def behind(source: Bytes, end: int, letters: int) -> tuple[bytes, str]:
    """The rest of a letter that the range cut, and up to ``letters`` letters of the record after that."""
    have, at, first = bytearray(), end, source.get(end - 1, end)
    while True:
        more = source.get(at, at + TAIL)
        stop = 0 if first == b"\n" and more[:1] == b">" else more.find(b"\n>")
        have += more if stop < 0 else more[:stop]
        plain = bytes(have).translate(None, b"\r\n")
        cut = next((k for k in range(min(4, len(plain))) if not 0x80 <= plain[k] < 0xC0), min(4, len(plain)))
        text = plain[cut:].decode("utf-8", "ignore")
        if stop >= 0 or len(more) < TAIL or len(text) >= letters:
            return plain[:cut], text[:letters]
        at, first = at + TAIL, more[-1:]


def range_rows(source: Bytes, path: str, start: int, end: int, piece: int, overlap: int) -> Iterator[tuple]:
    name = os.path.basename(path)
    for header, place, body, goes_on in segments(source, start, end):
        plain, more = body.translate(None, b"\r\n"), ""
        if header is None:  # a letter that began in the range before
            plain = plain[next((k for k in range(min(4, len(plain))) if not 0x80 <= plain[k] < 0xC0), min(4, len(plain))) :] if start else plain
        if goes_on:
            rest, more = behind(source, place + len(body), overlap)
            plain += rest if plain else b""
        text = plain.decode("utf-8", "replace")
        own = len(text)
        text += more
        for at in range(0, max(own, 1 if header is not None else 0), piece):
            yield path, name, header, start, place, at, min(piece, own - at), text[at : at + piece + overlap] if own else ""


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class FastaRanges(DataSource):
    """``spark.read.format("fasta_ranges")`` with options ``paths`` (a JSON list), ``step``, ``piece`` and ``overlap``."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.step, self.piece, self.overlap, self.tasks = (int(options.get(c, d)) for c, d in (("step", STEP), ("piece", PIECE), ("overlap", 0), ("tasks", 1)))
        if self.step < 1 or self.piece < 1 or self.overlap < 0:
            raise ValueError("step and piece are at least 1, overlap at least 0")

    def partitions(self) -> list[Range]:
        out, whole = [], []
        for item in self.paths:
            system, path = resolve(item)
            info = system.get_file_info(path)
            found = system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
            for f in found:
                if f.type == fs.FileType.NotFound:
                    raise FileNotFoundError(item)
                if f.type != fs.FileType.File or f.base_name[0] in "._":
                    continue
                uri = f.path if isinstance(system, fs.LocalFileSystem) else f"{item.split('://')[0]}://{f.path}"
                if codec_of(f.path):
                    out.append(Range(uri, 0, -1))
                else:
                    whole.append((uri, f.size))
        # A few tasks for each core, of whole ranges.
        run = self.step * max(1, min(RUN, sum(size for _, size in whole) // (4 * self.tasks)) // self.step)
        return out + [Range(uri, a, min(a + run, size)) for uri, size in whole for a in range(0, size, run)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file has a byte
            return
        source, rows, size = Bytes(part.path), [], 0
        try:
            start = part.start
            while part.end >= 0 and start < part.end or part.end < 0 and source.get(start, start + 1):
                end = min(start + self.step, part.end) if part.end >= 0 else start + self.step
                for row in range_rows(source, part.path, start, end, self.piece, self.overlap):
                    rows.append(row)
                    size += len(row[-1]) + 64
                    if size >= BATCH:
                        yield self.batch(rows)
                        rows, size = [], 0
                start = end
                source.forget(start - HEADER)
            if rows:
                yield self.batch(rows)
        finally:
            source.close()

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def read_ranges(spark: SparkSession, paths: str | list[str], overlap: int = 0, step: int = STEP, piece: int = PIECE) -> DataFrame:
    """The pieces of FASTA files, read range by range. With ``overlap = k - 1`` every shingle of k letters is in one piece."""
    spark.dataSource.register(FastaRanges)
    given = [paths] if isinstance(paths, str) else list(paths)
    options = {"paths": json.dumps(given), "step": step, "piece": piece, "overlap": overlap, "tasks": spark.sparkContext.defaultParallelism}
    return spark.read.format("fasta_ranges").options(**options).load()


def with_records(rows: DataFrame) -> DataFrame:
    """The pieces with the header of their record: that of the last header in an earlier range where the own range has none before."""
    last = rows.groupBy("path", "start").agg(F.max_by("record", F.when(F.col("record").isNotNull(), F.col("place"))).alias("last"))
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = materialize(last.select("path", "start", F.last("last", ignorenulls=True).over(earlier).alias("going")), "going")
    return rows.join(small_or_shuffled(known), ["path", "start"]).withColumn("record", F.coalesce("record", "going")).drop("going").select(*rows.columns)


def whole_records(rows: DataFrame) -> DataFrame:
    """``(name, path, record, seq)``: the pieces of each record put together again, for records that fit a row.

    Records are told apart by file and header; pieces without own letters make an empty sequence.
    """
    own = F.struct("start", "place", "at", F.col("seq").substr(F.lit(1), F.col("own")).alias("letters"))
    parts = with_records(rows).groupBy("name", "path", "record").agg(F.array_sort(F.collect_list(own)).alias("parts"))
    return parts.select("name", "path", "record", F.array_join("parts.letters", "").alias("seq"))
