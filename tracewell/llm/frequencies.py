"""Words of texts with their frequencies, and per-document sums of values of distinct words.

A scan of texts takes words in steps of many documents. Words of a head, a table of bounded size
that all executors have, are summed on the spot. Any other word leaves a step once, with the list
of the step's documents that hold it and how often: so a word is spelt once for a step, not for a
document, and a word that all documents have is still no more rows than there are steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, tokens

#: Most words of a head, and most bytes of them in all.
HEAD_ROWS, HEAD_BYTES = 200_000, 16_000_000
#: Bytes of text that are split at a time.
STEP_BYTES = 8_000_000
#: Bytes of distinct words that a counting task holds before it hands them on.
HELD_BYTES = 24_000_000


def words_of(batch: pa.RecordBatch, lower: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of a step, the place of each word among them, and each text's number of words."""
    texts = common.texts_of(batch)
    found, number = tokens.words([x.lower() for x in texts] if lower else texts)
    coded = found.dictionary_encode()
    return coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), number


def word_counts(docs: DataFrame, lower: bool = False) -> DataFrame:
    """``word`` (binary), ``n``: how often each distinct word stands in docs' texts, and
    ``n_learn``, how often in those whose ``learn`` is true. Tasks count before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in common.steps(batches, chars=STEP_BYTES):
            words, place, number = words_of(batch, lower)
            learn = np.repeat(batch.column("learn").to_numpy(zero_copy_only=False).astype(bool), number)
            n = np.bincount(place, minlength=len(words))
            held.append(pa.table({"word": words, "n": n, "n_learn": np.bincount(place[learn], minlength=len(words))}))
            if len(held) > 1 and sum(t.nbytes for t in held) > HELD_BYTES:
                held = [_merged(held)]
                if held[0].nbytes > HELD_BYTES // 2:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from _merged(held).to_batches()

    counted = docs.select("text", "learn").mapInArrow(count, "word binary, n long, n_learn long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_learn").alias("n_learn"))


def _merged(held: list[pa.Table]) -> pa.Table:
    if len(held) == 1:
        return held[0]
    sums = pa.concat_tables(held).group_by("word").aggregate([("n", "sum"), ("n_learn", "sum")])
    return sums.rename_columns({"n_sum": "n", "n_learn_sum": "n_learn"}).select(["word", "n", "n_learn"])


def head(table: DataFrame, columns: list[str], rows: int = HEAD_ROWS) -> pa.Table:
    """``word`` and columns of the most frequent words, by ``n``: at most ``rows`` of them, and
    HEAD_BYTES in all.

    A histogram over frequencies (by twelfths of an octave) gives the least that fits."""
    step = F.floor(F.log2("n") * 12)
    left, room, least = rows, HEAD_BYTES, None
    sized = table.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.sum(F.length("word")).alias("bytes"))
    for row in sized.orderBy(F.desc("step")).collect():  # some hundreds
        left, room = left - row.rows, room - row.bytes
        if left < 0 or room < 0:
            break
        least = row.step
    return table.filter(F.lit(least is not None) & (step >= (least or 0))).select("word", *columns).toArrow()


def scan(docs: DataFrame, kept: list[str], words: pa.Array, values: np.ndarray, lower: bool = False) -> DataFrame:
    """A row for each of docs' rows, with the columns ``kept`` as ``__c0`` and so on, its number
    ``row``, and ``sums``: its words, and the sums of the ``values`` of its ``words`` of the head;
    and a row for each other ``word`` of a step, with ``hits``, each a document's number less
    ``row``, times 2^32, and the word's frequency in it. Rows of the first kind have a word with
    a space, which spreads them evenly."""
    known = docs.sparkSession.sparkContext.broadcast((_packed(words), values))
    fields = [T.StructField(f"__c{i}", docs.schema[c].dataType) for i, c in enumerate(kept)]
    kinds = {"row": T.LongType(), "word": T.BinaryType(), "hits": T.ArrayType(T.LongType()), "sums": T.ArrayType(T.DoubleType())}
    schema = T.StructType([*fields, *(T.StructField(c, k) for c, k in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, numbers = known.value
        held = _unpacked(held)
        table = np.vstack([numbers, np.zeros((1, numbers.shape[1]))])  # at place -1: no word of the head
        for batch in common.steps(batches, chars=STEP_BYTES):
            found, place, number = words_of(batch, lower)
            size = batch.num_rows
            in_head = pc.fill_null(pc.index_in(found, value_set=held), -1).to_numpy(zero_copy_only=False)
            doc, at = np.repeat(np.arange(size, dtype=np.int32), number), in_head[place].astype(np.int32)
            sums = [number.astype(float), *(np.bincount(doc, table[at, k], size) for k in range(numbers.shape[1]))]
            row = batch.column("row").to_numpy()
            rare = at < 0
            pairs, n = np.unique(place[rare].astype(np.int64) << 32 | doc[rare], return_counts=True)
            del place, doc, at, rare
            offset = row[pairs & 0xFFFFFFFF] - row[0] if len(pairs) else pairs
            first = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
            hits = pa.ListArray.from_arrays(np.append(first, len(pairs)).astype(np.int32), offset << 32 | n)
            words = found.take(pa.array((pairs >> 32)[first]))
            base = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*base, pa.array(row), pa.array([b" %d" % r for r in row.tolist()], pa.binary()), pa.nulls(size, pa.list_(pa.int64())),
                 pa.array(np.stack(sums, 1).tolist(), pa.list_(pa.float64()))],
                names=schema.names,
            )
            none = [pa.nulls(len(words), b.type) for b in base]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array(np.full(len(words), row[0] if size else 0)), words, hits, pa.nulls(len(words), pa.list_(pa.float64()))], names=schema.names
            )

    numbered = docs.select(*common.positional(kept), F.monotonically_increasing_id().alias("row"), "text")
    return numbered.mapInArrow(run, schema)


def _packed(words: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([words], names=["word"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column("word").combine_chunks()


def document_sums(docs: DataFrame, kept: list[str], table: DataFrame, columns: list[str], lower: bool = False, head_rows: int = HEAD_ROWS) -> DataFrame:
    """docs' columns ``kept``, ``n_words``, and the sums (doubles) of ``columns`` of ``table`` over each
    row's words. Sums of rows without words are zero."""
    top = head(table, columns, head_rows)
    words = top.column("word").combine_chunks()
    values = np.stack([top.column(c).to_numpy().astype(float) for c in columns], 1)
    rows = scan(docs, kept, words, values, lower)
    values = table.select(F.col("word").alias("of"), *(F.col(c).alias(f"v{k}") for k, c in enumerate(columns)))
    met = rows.join(values, F.col("word") == F.col("of"), "left").withColumn("hit", F.explode_outer("hits"))
    own = F.col("row") + F.coalesce(F.shiftright("hit", 32), F.lit(0))
    n = F.col("hit").bitwiseAND(F.lit(0xFFFFFFFF))
    parts = [F.coalesce(F.get("sums", F.lit(k + 1)), n * F.col(f"v{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(columns))]
    flat = met.select(own.alias("row"), *(f"__c{i}" for i in range(len(kept))), F.get("sums", F.lit(0)).alias("n_words"), *parts)
    return by_row(flat, kept, ["n_words", *(f"s{k}" for k in range(len(columns)))], ["n_words", *columns])


def by_row(flat: DataFrame, kept: list[str], sums: list[str], names: list[str]) -> DataFrame:
    """Rows of one number put together: the columns kept, under their own names, and sums."""
    out = flat.groupBy("row").agg(
        *(F.first(f"__c{i}", ignorenulls=True).alias(f"__c{i}") for i in range(len(kept))), *(F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in sums)
    )
    return out.select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(kept)), *(F.col(s).alias(n) for s, n in zip(sums, names, strict=True)))
