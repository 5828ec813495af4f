"""Near-duplicates of word shingles by HyperMinHash sketches: banded registers, estimates, verification.

A set's shingles are dealt into REGISTERS buckets by a hash; a bucket keeps its least value, stored as the count of
leading zeros and MANTISSA further bits. A bucket that no shingle falls into takes the least value of all shingles under
a hash of its own, and a mark. So, whatever the sets' sizes, a register of two sets agrees with the probability of
their Jaccard index J, or by chance of the stored bits.

BAND registers in turn make a key. Sets of J = 0.8 share none of the 48 keys with a probability of 1e-11. The sets of a
key are compared by the collision-corrected estimate of J; one below MIN_ESTIMATE is dropped, which happens
to a pair of J = 0.8 with a probability of 2e-9. A key that over one in HEAVY_ONE_IN of a sample of sets has is
not gathered: its sets are tied to the least of them, and the classes that come of it are settled exactly, as are
all others (``set_links``), on the whole sets.

Defined results: words are runs without ASCII white space, A-Z lower-cased. Fewer words than a shingle are one shingle. Null
texts and those without words have no shingle, are linked with nothing, and are kept. Equal texts are one set.
A null id names a component, and is kept, only where the component has no other id. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from . import common, set_links
from .set_links import OF, SHARED

WIDTH = 4
REGISTERS, BAND = 192, 4
#: Bits of a value, and those stored after its leading zeros.
VALUE, MANTISSA = 40, 9
MIN_ESTIMATE = 0.6
#: Sets, about, whose keys are counted to find heavy ones, and the share that makes a key heavy.
COUNTED, HEAVY_ONE_IN = 10_000, 1000
#: Sets of a key that are compared in one task; those of a larger one that is not known as heavy are tied likewise.
MOST_OF_A_KEY = 2000


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every bit of x bears on every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mixed(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MASK = np.uint64((1 << VALUE) - 1)


def _stored(value: np.ndarray) -> np.ndarray:
    """Leading zeros of values, and the bits after the first that is set."""
    length = np.frexp(value.astype(float))[1].astype(np.uint64)
    zeros = np.uint64(VALUE) - length
    rest = (value << (zeros + np.uint64(1))) & _MASK
    return (zeros << np.uint64(MANTISSA)) | (rest >> np.uint64(VALUE - MANTISSA))


def registers(own: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes (uint64, at least one)."""
    h = _mixed(own)
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    np.minimum.at(least, ((h >> np.uint64(VALUE)) % np.uint64(REGISTERS)).astype(np.int64), h & _MASK)
    empty = np.flatnonzero(least > _MASK)
    for at in np.array_split(empty, -(-len(empty) * len(own) // 1_000_000) or 1):
        if len(at):
            least[at] = (_mixed(own[None, :] ^ _SEEDS[at][:, None]) & _MASK).min(1)
    out = _stored(least)
    out[empty] |= np.uint64(1 << 15)
    return out.astype("<u2")


def keys_of(sketch: np.ndarray) -> np.ndarray:
    """A key for each band: its registers, which are 64 bits, mixed with its number."""
    bands = sketch.view("<u8")
    return _mixed(bands ^ _SEEDS[: len(bands)]).view(np.int64)


def estimates(agree: np.ndarray, n: int, others: np.ndarray) -> np.ndarray:
    """Jaccard indexes from the number of equal registers of sets of n and of ``others`` shingles.

    Values of unlike sets fall into one cell of 2^-MANTISSA of their octave with the probability
    2^-MANTISSA n m / (n + m)^2 times the mean of 2^floor(log2 x) / x, 1 / (2 ln 2)."""
    chance = n * others.astype(float) / (n + others) ** 2 / (2 * np.log(2)) / (1 << MANTISSA)
    return (agree / REGISTERS - chance) / (1 - chance)


def _sketched(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in common.steps(batches):
        same, size, sketch, keys = [], [], [], []
        for text in common.texts_of(batch):
            words = text.lower().split()
            own = set_links.shingles(words, WIDTH) if words else set()
            size.append(len(own))
            same.append(xxhash.xxh3_128_digest(b" ".join(words)))
            regs = registers(np.fromiter(own, np.uint64, len(own))) if own else np.zeros(0, "<u2")
            sketch.append(regs.tobytes())
            keys.append(keys_of(regs) if own else np.zeros(0, np.int64))
        arrays = [pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *arrays], names=names)


def sketches(numbered: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``same`` (a digest of the words), ``size``, ``sketch`` and ``keys`` of rows with a text."""
    fields = [T.StructField("row", T.LongType()), numbered.schema["doc_id"], T.StructField("same", T.BinaryType()), T.StructField("size", T.LongType())]
    schema = T.StructType([*fields, T.StructField("sketch", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return numbered.select("row", "doc_id", "text").mapInArrow(partial(_sketched, names=schema.names), schema)


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, np.ndarray, bool]]:
    """Columns of rows sorted by key, where their runs begin (and end), and whether the first run is a long one's
    next rows, after its first."""
    rest, goes_on = None, False
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(c) for c in zip(rest, columns, strict=True)]
        key = columns[0]
        if not len(key):
            continue
        at = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        if len(at) > 1:
            yield columns, at, goes_on
            goes_on = False
        rest = [c[at[-1] :] for c in columns]
        if goes_on or len(rest[0]) > most:
            yield rest, np.array([0, len(rest[0])]), True
            rest, goes_on = [c[:1] for c in rest], True
    if rest is not None:
        yield rest, np.array([0, len(rest[0])]), goes_on


def _gather(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of the keys that two or more have, under a hash of these rows, as many keys have the same."""
    for columns, at, goes_on in _runs(batches, most):
        row, keys, rows, long_ = columns[1], [], [], []
        for k, (start, n) in enumerate(zip(at[:-1].tolist(), np.diff(at).tolist())):
            if n > 1:
                tied = n > most or goes_on and k == 0
                keys += [xxhash.xxh64_intdigest(row[start : start + n].tobytes()) >> 1 if not tied else int(row[start])] * n
                rows += row[start : start + n].tolist()
                long_ += [tied] * n
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.int64()), pa.array(long_, pa.bool_())], names=["key", "row", "tied"])


def _estimated(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by key whose estimates are high enough: a spanning tree for each class of a key."""
    for columns, at, _ in _runs(batches, most):
        row, size, sketch = columns[1:]
        a, b = [], []
        for start, n in zip(at[:-1].tolist(), np.diff(at).tolist()):
            held = np.frombuffer(b"".join(sketch[start : start + n]), "<u2").reshape(n, REGISTERS)
            own, rest = size[start : start + n], np.arange(n)
            while len(rest) > 1:
                reached, rest = [int(rest[0])], rest[1:]
                for x in reached:
                    if not len(rest):
                        break
                    agree = (held[rest] == held[x]).sum(1)
                    met = estimates(agree, int(own[x]), own[rest]) >= MIN_ESTIMATE
                    met &= OF * np.minimum(own[rest], own[x]) >= SHARED * np.maximum(own[rest], own[x])
                    found = rest[met].tolist()
                    a += [int(row[start + x])] * len(found)
                    b += row[start + rest[met]].tolist()
                    reached += found
                    rest = rest[~met]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _heads(batches: Iterator[pa.RecordBatch], heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The least row of each heavy key among a task's sets."""
    least = np.full(len(heavy), np.iinfo(np.int64).max)
    for batch in batches:
        keys, row = _flat(batch)
        at, met = _found(heavy, keys)
        np.minimum.at(least, at[met], row[met])
    seen = least < np.iinfo(np.int64).max
    yield pa.RecordBatch.from_arrays([pa.array(heavy[seen]), pa.array(least[seen])], names=["key", "row"])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    keys = batch.column("keys")
    return keys.flatten().to_numpy(), np.repeat(batch.column("row").to_numpy(), keys.value_lengths().to_numpy())


def _found(heavy: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys among the sorted heavy ones, and whether they are there."""
    if not len(heavy):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(heavy, keys), len(heavy) - 1)
    return at, heavy[at] == keys


def _indexed(batches: Iterator[pa.RecordBatch], heavy: np.ndarray, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each set's light keys, and its ties to the heads of its heavy keys, each head once."""
    for batch in batches:
        keys, row = _flat(batch)
        at, met = _found(heavy, keys)
        ties = np.unique(np.stack([heads[at[met]], row[met]]), axis=1) if met.any() else np.zeros((2, 0), np.int64)
        key, own = np.concatenate([keys[~met], ties[0]]), np.concatenate([row[~met], ties[1]])
        tied = np.repeat([False, True], [int((~met).sum()), ties.shape[1]])
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(tied)], names=["key", "row", "tied"])


def candidates(kinds: DataFrame) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of rows of ``row``, ``size``, ``sketch``, ``keys`` whose classes hold all that are similar
    enough, and ``check``, whether the pair itself is to be verified first."""
    every = max(1, kinds.count() // COUNTED)
    sample = kinds.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0)
    of_sample = sample.count()
    # Each set has 48 keys, so at most 48 times HEAVY_ONE_IN are heavy.
    heavy = sample.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    heavy = heavy.filter((F.col("n") > 2) & (F.col("n") * HEAVY_ONE_IN > F.lit(of_sample))).select("key").orderBy("key").toArrow()
    heavy = heavy.column("key").to_numpy()
    heads = kinds.select("row", "keys").mapInArrow(partial(_heads, heavy=heavy), "key long, row long").groupBy("key").agg(F.min("row").alias("row"))
    heads = heads.orderBy("key").toArrow().column("row").to_numpy()  # one for each heavy key
    index = kinds.select("row", "keys").mapInArrow(partial(_indexed, heavy=heavy, heads=heads), "key long, row long, tied boolean")
    light = index.filter("not tied").select("key", "row")
    met = common.cut(light.repartition("key").sortWithinPartitions("key", "row").mapInArrow(partial(_gather, most=MOST_OF_A_KEY), "key long, row long, tied boolean").distinct())
    near = met.filter("not tied").join(kinds.select("row", "size", "sketch"), "row").select("key", "row", "size", "sketch")
    near = near.repartition("key").sortWithinPartitions("key", "row").mapInArrow(partial(_estimated, most=MOST_OF_A_KEY), "a long, b long")
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).withColumn("check", F.lit(True))
    stars = index.filter("tied").unionByName(met.filter("tied")).select(F.col("key").alias("a"), F.col("row").alias("b")).filter("a < b").distinct()
    # Of a row's ties to heads only the first is verified at once.
    first = stars.groupBy("b").agg(F.min("a").alias("first"))
    stars = stars.join(first, "b").select("a", "b", (F.col("a") == F.col("first")).alias("check"))
    return near.unionByName(stars).groupBy("a", "b").agg(F.max("check").alias("check"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the least id reachable by links) and ``kept`` for each row.

    docs must be read from files or a checkpoint, so that its rows are numbered alike when read again."""
    ship(docs.sparkSession)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = common.cut(sketches(numbered))
    some = rows.filter("size > 0")
    # Equal words have equal sketches, so any of them will do.
    same = some.groupBy("same").agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("size", "sketch", "keys")))
    same = common.cut(same)
    kinds, held = same.select("same", "row", "least", "n"), same.select("row", "size", "sketch", "keys")
    groups = common.cut(set_links.settled(candidates(held), numbered.select("row", "text"), WIDTH))
    linked = kinds.join(groups.withColumnRenamed("node", "row"), "row").select("row", "root", "least")
    reached = linked.groupBy("root").agg(F.min("least").alias("reached"), F.count("*").alias("members"))
    named = common.lookup(linked.select("row", "root"), reached, ["root"], ["reached"], "members", linked.count(), ["row"])
    named = kinds.join(named.select("row", "reached"), "row", "left").select("same", "n", F.coalesce("reached", "least").alias("component"))
    found = common.lookup(rows.select("row", "doc_id", "size", "same"), named, ["same"], ["component"], "n", rows.count(), ["row"])
    component = F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
