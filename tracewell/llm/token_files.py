"""Token ids in seekable files: independent zstandard frames and a trailing seek table.

A file holds whole documents in ascending order of their ids:

* data frames, each the little-endian unsigned 32-bit ids of consecutive documents; a frame is
  closed when it has FRAME_IDS ids or more;
* a skippable frame with the directory: for each document its id, whether the id is known, and
  its number of tokens;
* a skippable frame with the seek table: for each data frame its compressed and plain sizes and
  the low half of the XXH64 of its plain bytes, then the number of frames, a descriptor byte and
  the closing magic number.

A reader of some documents reads the two tables and those documents' frames only.

Defined results: a null or empty text is its end id alone; documents with a null id come first;
documents of one id follow each other in the order of a hash of their texts. No documents give
no files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

FRAME_IDS = 65_536
# Fixed values of the zstandard formats.
DIRECTORY_MAGIC, SEEK_MAGIC, CLOSING_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80


class Writer:
    """Writes one file to a stream."""

    def __init__(self, out):
        self.out, self.zstd = out, zstandard.ZstdCompressor(level=3)
        self.table: list[tuple[int, int, int]] = []
        self.directory: list[tuple[int, int, int]] = []
        self.pending, self.size = [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.directory.append((doc_id or 0, doc_id is not None, len(ids) // 4))
        self.pending.append(ids)
        self.size += len(ids) // 4
        if self.size >= FRAME_IDS:
            self._frame()

    def _frame(self) -> None:
        plain = b"".join(self.pending)
        packed = self.zstd.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.pending, self.size = [], 0

    def close(self) -> None:
        if self.pending:
            self._frame()
        d = np.array(self.directory, "<i8").reshape(-1, 3)
        directory = d[:, 0].tobytes() + d[:, 1].astype("<u1").tobytes() + d[:, 2].astype("<u4").tobytes()
        self.out.write(struct.pack("<II", DIRECTORY_MAGIC, len(directory)) + directory)
        seek = np.array(self.table, "<u4").reshape(-1, 3).tobytes()
        seek += struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, CLOSING_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(seek)) + seek)


class Reader:
    """Reads documents of one file; ``source`` is a seekable stream of ``size`` bytes."""

    def __init__(self, source, size: int):
        self.source = source
        n, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != CLOSING_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end")
        seek = size - 9 - 12 * n - 8
        if struct.unpack("<II", self._at(seek, 8)) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("the seek table's frame is broken")
        self.table = np.frombuffer(self._at(seek + 8, 12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.place = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.first = np.concatenate([[0], np.cumsum(self.table[:, 1])]) // 4
        head = int(self.place[-1])
        magic, length = struct.unpack("<II", self._at(head, 8))
        if magic != DIRECTORY_MAGIC or head + 8 + length != seek or length % 13:
            raise ValueError("the directory's frame is broken")
        raw, docs = self._at(head + 8, length), length // 13
        self.known = np.frombuffer(raw, "<u1", docs, 8 * docs).astype(bool)
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.n_tokens = np.frombuffer(raw, "<u4", docs, 9 * docs).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.n_tokens)])
        if self.start[-1] != self.first[-1]:
            raise ValueError("the directory and the frames differ in length")

    def _at(self, place: int, size: int) -> bytes:
        self.source.seek(place)
        return self.source.read(size)

    def frame(self, i: int) -> bytes:
        packed, plain, check = self.table[i].tolist()
        data = zstandard.ZstdDecompressor().decompress(self._at(int(self.place[i]), packed), max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return data

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(id, tokens before it in the file, its ids) of the wanted documents, all by default."""
        frame, data = -1, b""
        for k in range(len(self.doc_ids)):
            doc_id = int(self.doc_ids[k]) if self.known[k] else None
            if wanted is not None and doc_id not in wanted:
                continue
            start, end = int(self.start[k]), int(self.start[k + 1])
            own = int(np.searchsorted(self.first, start, side="right")) - 1
            if own != frame:
                frame, data = own, self.frame(own)
            at = 4 * (start - int(self.first[own]))
            yield doc_id, start, data[at : at + 4 * (end - start)]


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int) -> list[tuple[str, int, int]]:
    """Write all documents; returns (file, tokens before it, documents) in ascending order.

    The texts are dealt by ranges of the id, and of a hash of the text where ids repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        uri = f"{folder}/tokens-{part:08d}.zst"
        counts = [0, 0]

        def fill(out, first: pa.RecordBatch) -> None:
            writer = Writer(out)
            for batch in common.steps(_chain(first, batches), chars=tokens.PART_BYTES):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(common.texts_of(batch)), strict=True):
                    writer.add(doc_id, ids + end)
                    counts[0] += 1
                    counts[1] += len(ids) // 4 + 1
            writer.close()

        first = next((b for b in batches if b.num_rows), None)
        if first is not None:
            common.publish(uri, lambda out: fill(out, first))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([uri]), pa.array([counts[0]]), pa.array([counts[1]])], names=["part", "file", "docs", "tokens"]
            )

    order = [F.col("doc_id").asc_nulls_first(), F.col("__order").asc()]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__order"))
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = dealt.mapInArrow(run, "part long, file string, docs long, tokens long").collect()  # a row for each file
    out, before = [], 0
    for row in sorted(found):
        out.append((row.file, before, row.docs))
        before += row.tokens
    return out


def _chain(first, rest):
    yield first
    yield from rest


RESULT = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def read_back(spark: SparkSession, files: list[tuple[str, int, int]], with_ids: bool = False) -> DataFrame:
    """A row for each document of the files: the columns of RESULT, and ``ids`` if asked for."""
    schema = T.StructType([*RESULT.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                store, path = common.filesystem(uri)
                with store.open_input_file(path) as source:
                    rows = []
                    for doc_id, start, ids in Reader(source, source.size()).documents():
                        rows.append((doc_id, before + start, len(ids) // 4, zlib.crc32(ids), ids)[: len(schema)])
                        if len(rows) == 4096:
                            yield _rows(rows, schema)
                            rows = []
                    if rows:
                        yield _rows(rows, schema)

    listed = spark.createDataFrame([(f, b) for f, b, _ in files], "file string, before long")
    return listed.repartition(max(1, len(files))).mapInArrow(run, schema)


def _rows(rows, schema) -> pa.RecordBatch:
    types = [*[pa.int64()] * 4, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)
