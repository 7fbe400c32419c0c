"""WARC archives with one Zstandard frame a record and a dictionary of their own.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on a
spread of the archive's records; each record follows as a frame of its own, compressed with it.
Archives of too few records to train on have no such frame. Payloads that occur more than once
and are long enough are stored once, as the response of the largest id; the others are revisit
records that refer to it.

Tasks write archives of bounded size and name them by attempt; the written table of archives lists
only those of attempts that succeeded. Readers take archives one by one and records one by one,
and check every stored payload against its digest.

Defined cases: null payload is empty; null ids are written as `null` and read back as null, and never
chosen as response while another has the payload; rows that repeat the response's id are responses too; a null address
leaves its header out; empty tables give no archives; further columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm import files
from sketchloom.session import materialize

# Fixed values of the format.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 16 << 20  # uncompressed, in memory of a task
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 2 << 20
LEAST_SAMPLES = 8
ID = "urn:x-page:"


def with_revisits(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` (null for a response). Only digests are shuffled to find copies."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    copies = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("many"))
    copies = materialize(copies.filter("many > 1").drop("many"), "warc-copies")
    # Only payloads with copies are in the table; it is broadcast by its written size when small.
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    return rows.join(copies, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records spread evenly over the archive, as many as fit in ``SAMPLE_BYTES``."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = records[::step]
    if len(samples) < LEAST_SAMPLES:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
    except zstandard.ZstdError:  # too little or too uniform to train on
        return None


def write_archive(uri: str, records: list[bytes], level: int) -> int:
    trained = dictionary_of(records)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    size = 0
    with files.create(uri) as out:
        if trained is not None:
            held = trained.as_bytes()
            size += out.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(held).to_bytes(4, "little") + held)
        for one in records:
            size += out.write(compressor.compress(one))
    return size


ARCHIVES = "path string, records bigint, bytes bigint"


def write(rows: DataFrame, level: int = 3, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The written table of archives: ``path, records, bytes``."""
    folder = files.new_folder(rows.sparkSession, "warc")
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            written = write_archive(path, held, level)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [written]}, schema)

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                held.append(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return materialize(rows.mapInArrow(run, ARCHIVES), "warc-archives")


def records_of(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of an archive, one at a time."""
    with files.open_random(uri) as file:
        head, trained = file.read(8), None
        if head[:4] == DICTIONARY_FRAME.to_bytes(4, "little"):
            trained = zstandard.ZstdCompressionDict(file.read(int.from_bytes(head[4:], "little")))
        else:
            file.seek(0)
        plain = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(file, read_across_frames=True)
        stream = io.BufferedReader(plain, 1 << 16)
        while line := stream.readline():
            if line.rstrip() != b"WARC/1.1":
                raise ValueError(f"{uri}: a record begins with {line[:40]!r}")
            headers = {}
            while line := stream.readline().rstrip(b"\r\n"):
                key, _, value = line.decode().partition(":")
                headers[key.lower()] = value.strip()
            block = stream.read(int(headers["content-length"]))
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError(f"{uri}: record {headers['warc-record-id']} is cut off")
            yield headers, block


def _page(name: str | None) -> int | None:
    number = None if name is None else name.strip("<>").removeprefix(ID)
    return None if number in (None, "null") else int(number)


READ = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the archives. ``payload`` is null for revisits, and for all without ``payloads``."""
    count = archives.count()
    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    )

    def parsed(headers: dict[str, str], block: bytes) -> tuple:
        http, _, body = block.partition(b"\r\n\r\n")
        size = next(int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length")
        digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
        if kind == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
            raise ValueError(f"The payload of {headers['warc-record-id']} differs from its digest")
        return _page(headers["warc-record-id"]), headers.get("warc-target-uri"), kind, body if payloads and kind == "response" else None, size, digest, _page(headers.get("warc-refers-to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for headers, block in records_of(path):
                    rows.append(parsed(headers, block))
                    size += len(block) if payloads else 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select("path").repartition(max(1, count), "path").mapInArrow(run, READ)
