"""Token counts without ids: each distinct pre-token is counted once, and documents sum.

A pre-token is a run without ASCII white space, the widest text that a tokenizer which drops
white space never merges beyond, so counts of a document's pre-tokens add up to its own.

Pre-tokens that repeat in a sample of documents make a head of bounded size, counted once and sent
to all executors; the sample bears on speed only. Every other pre-token meets all documents that
hold it, with its frequencies, where it is sorted to: it is counted there, once, and what
leaves are numbers of tokens by document.

Defined results: null and empty texts have no bytes and no tokens. Repeated rows are counted
each for itself, null ids included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, frequencies, tokens

LIMIT = 2048
#: Documents, about, among which the head's pre-tokens are looked for.
SAMPLED = 10_000


def frequent(docs: DataFrame) -> pa.Array:
    """Pre-tokens that repeat in a sample of documents, the most frequent ones."""
    every = max(1, docs.count() // SAMPLED)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "text")
    sample = numbered.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("text", F.lit(False).alias("learn"))
    counted = common.cut(frequencies.word_counts(sample).filter("n > 1"))
    return frequencies.head(counted, []).column("word").combine_chunks()


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row."""
    own = tokens.encoder(vocabulary)
    if not own.drops_space:
        raise ValueError("the tokenizer keeps white space, so words' counts do not add up")
    head = frequent(docs)
    counts = own.counts(head.cast(pa.large_binary())).astype(float).reshape(-1, 1)
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kept = ["doc_id", "n_bytes"]
    rows = frequencies.scan(sized, kept, head, counts)
    fields = [T.StructField(f"__c{i}", sized.schema[c].dataType) for i, c in enumerate(kept)]
    schema = T.StructType([*fields, T.StructField("row", T.LongType()), T.StructField("n", T.DoubleType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last, n_last = tokens.encoder(vocabulary), None, 0
        for batch in batches:
            word, hits = batch.column("word"), batch.column("hits")
            base = hits.is_null()
            if base.true_count:
                part = batch.filter(base)
                n = part.column("sums").flatten().to_numpy().reshape(-1, 2)[:, 1]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept) + 1)), pa.array(n)], names=schema.names)
            if base.true_count < len(base):
                part = batch.filter(hits.is_valid())
                coded = part.column("word").cast(pa.large_binary()).dictionary_encode()
                first = coded.dictionary[0].as_py()
                new = coded.dictionary.slice(1) if first == last else coded.dictionary
                n = encoder.counts(new)
                n = np.concatenate([[n_last], n]) if first == last else n
                last, n_last = coded.dictionary[-1].as_py(), int(n[-1])
                hits = part.column("hits")
                size = np.diff(hits.offsets.to_numpy())
                hit = hits.flatten().to_numpy()
                row = np.repeat(part.column("row").to_numpy(), size) + (hit >> 32)
                found, place = np.unique(row, return_inverse=True)
                total = np.bincount(place, (hit & 0xFFFFFFFF) * np.repeat(n[coded.indices.to_numpy()], size))
                none = [pa.nulls(len(found), part.column(i).type) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*none, pa.array(found), pa.array(total)], names=schema.names)

    met = rows.repartition("word").sortWithinPartitions("word").mapInArrow(count, schema)
    sums = frequencies.by_row(met, kept, ["n"], ["n"]).withColumn("n_tokens", F.col("n").cast("long"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
