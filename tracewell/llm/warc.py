"""WARC archives in zstandard: one frame per record, a dictionary in a leading skippable frame.

The writer makes a record of each page. Of pages with equal payloads the one with the largest id
is a response and the others revisit it. A file begins with a skippable frame that holds the
dictionary (itself compressed); each record is a frame of its own made with that dictionary, so
records can be read one by one. The reader loads the dictionary, decodes frame by frame, and
checks versions, mandatory headers, block lengths, payload lengths and digests.

Defined results: a null html is an empty payload, and empty payloads are equal to each other; a
null url is written as an empty target. Rows that repeat a page with the largest id of its payload
are all responses. A null id counts as less than any other; pages of equal payload without any
id are all responses. No pages give no files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of the dictionary, and pages and bytes that it is trained on in each file.
DICTIONARY_BYTES, TRAINING_PAGES, TRAINING_BYTES = 65_536, 512, 8_000_000
# Fixed values of the formats.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None, row: int) -> str:
    """A stable record id: the page's, or for a page without one that of its row."""
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.UUID(int=row)}>"


def record(page_id, row, url, payload: bytes, refers_to) -> bytes:
    """One record: the response's block is an HTTP head and the payload, a revisit's the head."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        (b"WARC-Type", b"revisit" if refers_to is not None else b"response"),
        (b"WARC-Record-ID", record_uri(page_id, row).encode()),
        (b"WARC-Date", DATE),
        (b"WARC-Target-URI", b"".join((url or "").encode().split())),
        (b"WARC-Payload-Digest", b"sha1:" + digest(payload).encode()),
        (b"Content-Type", b"application/http; msgtype=response"),
        (b"Content-Length", b"%d" % len(block)),
    ]
    if refers_to is not None:
        fields += [(b"WARC-Refers-To", record_uri(refers_to, 0).encode()), (b"WARC-Profile", REVISIT_PROFILE)]
    return VERSION + b"\r\n" + b"".join(k + b": " + v + b"\r\n" for k, v in fields) + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on records, or where they are too few, of their plain bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or VERSION, zstandard.DICT_TYPE_RAWCONTENT)


def write_file(out, records: Iterator[bytes]) -> int:
    """Write the dictionary's frame and a frame for each record; returns the number of these."""
    first, size = [], 0
    for x in records:
        first.append(x)
        size += len(x)
        if len(first) == TRAINING_PAGES or size > TRAINING_BYTES:
            break
    dictionary = train(first)
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    zstd = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    count = 0
    for part in (first, records):
        for x in part:
            out.write(zstd.compress(x))
            count += 1
    return count


class Broken(ValueError):
    """A file or record that is not what the formats ask for."""


def read_frames(source) -> Iterator[bytes]:
    """The plain bytes of each record of a stream."""
    head = source.read(8)
    if len(head) < 8:
        raise Broken("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise Broken("the leading frame holds no dictionary")
    held = source.read(size)
    if len(held) != size:
        raise Broken("the dictionary is cut short")
    if held[:4] == struct.pack("<I", FRAME_MAGIC):
        held = zstandard.ZstdDecompressor().decompress(held)
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    rest = b""
    while True:
        rest = rest or source.read(1 << 20)
        if not rest:
            return
        frame, plain = zstd.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise Broken("a frame is cut short")
            plain.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else source.read(1 << 20)
        yield b"".join(plain)


def _fields(head: bytes) -> dict[bytes, bytes]:
    pairs = [line.partition(b":") for line in head.split(b"\r\n")]
    if any(not colon for _, colon, _ in pairs):
        raise Broken("a header has no colon")
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _length(fields: dict[bytes, bytes]) -> int:
    value = fields.get(b"content-length", b"")
    if not value.isdigit():
        raise Broken("no valid Content-Length")
    return int(value)


def parse(plain: bytes) -> dict:
    """A record's fields and payload, after validation."""
    head, gap, rest = plain.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version != VERSION or not gap:
        raise Broken("no WARC version line or no end of the headers")
    fields = _fields(lines)
    if missing := {b"warc-type", b"warc-record-id", b"warc-date", b"content-length"} - fields.keys():
        raise Broken(f"missing headers: {sorted(missing)}")
    size = _length(fields)
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Broken("the block's length is not Content-Length")
    kind = fields[b"warc-type"].decode()
    http, gap, payload = rest[:size].partition(b"\r\n\r\n")
    if not gap or kind not in ("response", "revisit"):
        raise Broken("not an HTTP response or revisit")
    payload_bytes = _length(_fields(http.partition(b"\r\n")[2]))
    found = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
    if kind == "response" and (len(payload) != payload_bytes or digest(payload) != found):
        raise Broken("the payload's length or digest differs")
    if kind == "revisit" and (payload or b"warc-refers-to" not in fields):
        raise Broken("a revisit with a payload or without its reference")
    page = lambda x: int(x[len("<urn:page:") : -1]) if x.startswith("<urn:page:") else None
    return {
        "page_id": page(fields[b"warc-record-id"].decode()),
        "url": fields.get(b"warc-target-uri", b"").decode(),
        "payload_bytes": payload_bytes,
        "payload_digest": found,
        "record_type": kind,
        "refers_to": page(fields[b"warc-refers-to"].decode()) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def references(pages: DataFrame) -> DataFrame:
    """pages' ``page_id``, ``url``, ``html`` with ``row`` and ``refers_to``, null for responses.

    Payloads are equal if their SHA-256 and lengths are. Only ids and digests are grouped, with
    maxima taken before the shuffle; the pages' text moves once, to meet its group's id. Payloads
    of very many pages do not gather: their ids are broadcast."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.monotonically_increasing_id().alias("row"),
        F.sha2(html.cast("binary"), 256).alias("key"), F.octet_length(html).alias("size"),
    )
    last = keyed.groupBy("key", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
    other = F.col("page_id").isNull() & F.col("last").isNotNull() | (F.col("page_id") < F.col("last"))
    met = common.lookup(keyed, last, ["key", "size"], ["last"], "n", pages.count(), ["row"])
    return met.select("page_id", "url", "html", "row", F.when(other, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, folder: str) -> list[str]:
    """Write archives of all pages, one for each task; returns the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/pages-{TaskContext.get().partitionId():08d}.warc.zst"

        def records() -> Iterator[bytes]:
            for batch in common.steps(batches, "html"):
                columns = [batch.column(c).to_pylist() for c in ("page_id", "row", "url")]
                refers = batch.column("refers_to").to_pylist()
                for page_id, row, url, payload, other in zip(*columns, common.texts_of(batch, "html"), refers, strict=True):
                    yield record(page_id, row, url, payload, other)

        stream = records()
        first = next(stream, None)
        if first is not None:
            common.publish(uri, lambda out: write_file(out, _chain(first, stream)))
            yield pa.RecordBatch.from_arrays([pa.array([uri])], names=["file"])

    return sorted(r.file for r in references(pages).mapInArrow(run, "file string").collect())  # a row for each file


def _chain(first, rest):
    yield first
    yield from rest


RESULT = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)
_MORE = [T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType())]


def read(spark: SparkSession, files: list[str], with_payload: bool = False) -> DataFrame:
    """A row for each record of the files: RESULT, and ``url`` and ``payload`` if asked for."""
    schema = T.StructType([*RESULT.fields, *(_MORE if with_payload else [])])
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                store, path = common.filesystem(uri)
                with store.open_input_stream(path, compression=None) as source:
                    rows, size = [], 0
                    for plain in read_frames(source):
                        rows.append(parse(plain))
                        size += len(plain)
                        if len(rows) == 4096 or size > common.STEP_CHARS:
                            yield _table(rows)
                            rows, size = [], 0
                    if rows:
                        yield _table(rows)

    def _table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], kinds[f.dataType]) for f in schema], names=schema.names)

    listed = spark.createDataFrame([(f,) for f in files], "file string")
    return listed.repartition(max(1, len(files))).mapInArrow(run, schema)
