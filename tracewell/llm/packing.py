"""Packing by Karmarkar-Karp multiway differencing.

Whole windows are cut from long documents first; what remains of a document is cut into pieces
of at most PIECE tokens. The pieces of a block of documents are then divided into k windows:
each piece begins as a partition of its own, and the two partitions of the largest imbalance
are merged again and again, the fullest window of one with the emptiest of the other. Should
a window exceed the capacity, k rises and the division starts anew.

Defined results: a null or empty text is a document of its end token only. Documents are packed
each for itself however often they repeat; null ids are kept. No documents give no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

CAPACITY = 2048
#: Longest piece that is divided among windows; whole windows are cut off before.
PIECE = 512
#: Documents that one division takes in; a block never outgrows it, so memory is bounded.
BLOCK = 512


def _merge(a, b, trees):
    """Sums in falling order of a against rising order of b; sums are above the least."""
    sums, nodes = a[0] + b[0][::-1], a[1].copy()
    other = b[1][::-1]
    both = (nodes >= 0) & (other >= 0)
    n = int(both.sum())
    if n:
        first = len(trees)
        trees.extend(zip(nodes[both].tolist(), other[both].tolist()))
        joined = np.arange(first, first + n)
    nodes = np.where(nodes >= 0, nodes, other)
    if n:
        nodes[both] = joined
    order = np.argsort(-sums, kind="stable")
    return sums[order], nodes[order]


def divide(sizes: list[int], k: int) -> list[list[int]]:
    """Positions of sizes in k windows of near-equal sums."""
    trees: list[tuple[int, int]] = [(-1, -1)] * len(sizes)
    heap = []
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], nodes[0] = size, i
        heap.append((-size, i, (sums, nodes)))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = _merge(a, b, trees)
        sums = merged[0] - merged[0][-1]
        heapq.heappush(heap, (-int(sums[0]), count, (sums, merged[1])))
        count += 1
    windows = []
    for node in heap[0][2][1].tolist():
        own, todo = [], [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < len(sizes):
                own.append(x)
            else:
                todo.extend(trees[x])
        windows.append(sorted(own))
    return windows


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Positions of sizes, each at most the capacity, in as few windows as differencing fits."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    while True:
        windows = divide(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += max(1, k // 400)


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


class _Packer:
    """Packs the documents that one task is given, block by block."""

    def __init__(self, first_sequence: int, with_ids: bool):
        self.sequence, self.with_ids = first_sequence, with_ids
        self.docs: list = []
        self.pieces: list[tuple[int, int, int, bytes | None, int]] = []  # document, start, length, ids, total
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % CAPACITY
        doc = len(self.docs)
        self.docs.append(doc_id)
        for start in range(0, whole, CAPACITY):
            self._row((doc, start, CAPACITY, ids[4 * start : 4 * (start + CAPACITY)], total), 0)
            self.sequence += 1
        for start in range(whole, total, PIECE):
            part = ids[4 * start : 4 * (start + PIECE)]
            self.pieces.append((doc, start, len(part) // 4, part, total))
        if len(self.docs) >= BLOCK:
            self.flush()

    def _row(self, piece, offset) -> None:
        doc, start, length, ids, total = piece
        own = (ids,) if self.with_ids else ()
        self.rows.append((self.docs[doc], start, length, zlib.crc32(ids), total, self.sequence, offset, *own))

    def flush(self) -> None:
        for window in pack([p[2] for p in self.pieces]):
            offset = 0
            for i in window:
                self._row(self.pieces[i], offset)
                offset += self.pieces[i][2]
            self.sequence += 1
        self.docs, self.pieces = [], []

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id`` and the columns of RESULT, and with ``with_ids`` the
    piece's ``ids`` as little-endian unsigned 32-bit integers.

    Documents are tokenized and packed by the task that reads them: no shuffle, and a task that
    is run again packs its own documents anew. A sequence's number begins with its task's.
    """
    schema = T.StructType([docs.schema["doc_id"], *RESULT.fields, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        packer = _Packer(TaskContext.get().partitionId() << 32, with_ids)
        kind = None
        for batch in common.steps(batches, chars=tokens.PART_BYTES):
            kind = batch.schema.field("doc_id").type
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(common.texts_of(batch)), strict=True):
                packer.add(doc_id, ids + end)
            if rows := packer.take():
                yield _table(rows, kind, schema)
        packer.flush()
        if rows := packer.take():
            yield _table(rows, kind, schema)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _table(rows: list[tuple], kind: pa.DataType, schema: T.StructType) -> pa.RecordBatch:
    types = [kind, *[pa.int64()] * len(RESULT.fields), pa.binary()][: len(schema)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)


def windows(pieces: DataFrame) -> DataFrame:
    """``sequence_id``, ``n_tokens`` and the window's ``ids`` (binary, unpadded) of pieces with ids.

    A window holds at most CAPACITY tokens, so each group is bounded."""
    return (
        pieces.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own"))
        .select("sequence_id", "n_tokens", F.expr("aggregate(own, cast('' as binary), (a, x) -> a || x.ids)").alias("ids"))
    )
