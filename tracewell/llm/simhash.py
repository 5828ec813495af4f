"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Fingerprints that differ in at most 3 bits agree in at least 5 of their 8 positional bytes. The
index is keyed by the bytes at 4 positions. Its 14 position sets are the complements of the
quadruples of positions whose numbers XOR to zero; any three positions lie in exactly one such
quadruple, so two fingerprints with at most three unequal bytes always meet under a key. The
shared bytes of each pair that meets are tallied, pairs with fewer than 5 dropped, and the rest
verified by their differing bits.

A key with more than HOT_KEY fingerprints is not paired within. Its fingerprints differ in the
32 bits outside the key only, and two of them link if some value lies within one bit of the one
and two bits of the other. All fingerprints within two bits of a value are tied to the least
one within one bit of it: no link is lost, and the rows grow in proportion.

Defined results: a null or empty text has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle. Repeated rows share a fingerprint and a component.
A null id never names a component unless all ids of it are null. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected_components

SEED, MAX_BITS = 42, 3
#: Fingerprints that a key may have to be paired within.
HOT_KEY = 256
_BYTES = range(8)
_QUADS = [q for q in combinations(_BYTES, 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, width: int) -> int:
    """64 bits, unsigned: each is 1 if set in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    ones = np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a signed long) of each row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches):
            found = np.array([fingerprint(x, width) for x in common.texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def links(prints: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of the distinct fingerprints ``fp`` whose components are those of all
    links of at most MAX_BITS bits. Outside hot keys the pairs are the links themselves."""
    keys = []
    for i, quad in enumerate(_QUADS):
        mask = sum(0xFF << 8 * p for p in _BYTES if p not in quad)
        keys.append(F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("part")))
    index = prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.*")
    shared = index.groupBy("block", "part").agg(F.count("*").alias("n")).filter("n > 1")
    members = common.cut(index.join(shared, ["block", "part"]))
    low = members.filter(F.col("n") <= HOT_KEY)
    one, two = low.select("block", "part", F.col("fp").alias("a")), low.select("block", "part", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum(F.shiftrightunsigned(differ, 8 * p).bitwiseAND(F.lit(0xFF)).eqNullSafe(0).cast("int") for p in _BYTES)
    meet = (
        (F.col("one.block") == F.col("two.block")) & (F.col("one.part") == F.col("two.part")) & (F.col("a") < F.col("b"))
        & (tally >= len(_BYTES) - MAX_BITS) & (F.bit_count(differ) <= MAX_BITS)
    )
    pairs = one.alias("one").join(two.alias("two"), meet).select("a", "b")
    return pairs.unionByName(_hot_links(members.filter(F.col("n") > HOT_KEY))).distinct()


def _hot_links(hot: DataFrame) -> DataFrame:
    flips = []
    for i, quad in enumerate(_QUADS):
        bits = [1 << 8 * p + k for p in quad for k in range(8)]
        near = [0, *bits]
        flips += [(i, _signed(x), True) for x in near] + [(i, _signed(x | y), False) for x, y in combinations(bits, 2)]
    table = hot.sparkSession.createDataFrame(flips, "block int, flip long, near boolean")  # a fixed number of rows
    moved = hot.join(F.broadcast(table), "block").select(
        "fp", "near", "block", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")
    )  # the value keeps the key's bytes, so block and value tell the key too
    least = moved.filter("near").groupBy("block", "value").agg(F.min("fp").alias("a"))
    return moved.join(least, ["block", "value"]).filter("a <> fp").select("a", F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``, the least id that
    is reachable by links, for each row. Only one fingerprint of equal ones is indexed."""
    rows = common.cut(fingerprints(docs, width))
    prints = common.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    label = common.cut(connected_components(links(prints.select("fp"))))
    linked = label.withColumnRenamed("node", "fp").join(prints, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("reached"), F.count("*").alias("members"))
    reached = common.lookup(linked.select("fp", "root"), least, ["root"], ["reached"], "members", label.count(), ["fp"])
    named = prints.join(reached.select("fp", "reached"), "fp", "left").select("fp", "n", F.coalesce("reached", "least").alias("component_id"))
    found = common.lookup(rows.withColumn("row", F.monotonically_increasing_id()), named, ["fp"], ["component_id"], "n", rows.count(), ["row"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
