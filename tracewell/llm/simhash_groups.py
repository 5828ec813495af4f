"""Near-duplicate groups: documents whose sets of 5-word shingles have a Jaccard index of 0.8.

Candidates come first from SimHash: fingerprints of each text's shingles meet in an inverted index of byte positions,
pairs are thinned out by counting the bytes that they share and verified by their differing bits
(``simhash.links``), and those that remain are verified on whole sets. That finds close copies, but sets of index 0.8 may
differ in many more bits than any such index allows for. So an exact search follows for all other pairs: an inverted
index of each document's rarest shingles (prefix filtering): sets of index 0.8 always share one of the first
len - ceil(len * 0.8) + 1 shingles of each in any common order, and the first they share leaves room for the overlap
they need. So no pair is lost, whatever the edit. Shingles are ordered by their count in a sample of
documents, then by hash; the counts bear on speed only, as every order gives the same pairs.
A pair under a key is dropped only where no overlap of 0.8 is possible: by its sizes and
positions, or because parities of hashed shingles differ in more places than the sets may. The
first pass knows 128 parities; the groups it leaves, once each, meet again with about as many
as shingles.

A key that over one in HEAVY_ONE_IN documents of the sample have is not gathered. Documents of
sizes that can link are tied to the least of those that have it early enough for a pair with a
larger one; a key that none has so early gives no pair. Where documents of a template differ in
more than the links allow, their own shingles come first, so the template's are such keys. A key of
more than HOT_KEY documents that the sample did not show is tied likewise.

These candidates leave as trees of pairs that were found possible, and ``set_links`` settles them, and those of SimHash, exactly.
Groups are the components of all links found.

Defined results: words are runs without ASCII white space, A-Z lower-cased. Documents with equal
words are one group; so are all without words. Texts of fewer words than a shingle are one
shingle. Null texts have no words; repeated rows and null ids are documents like others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import common, set_links, simhash
from .set_links import OF, SHARED

WIDTH = 5
HOT_KEY = 4000
#: Documents, about, whose shingles are counted.
COUNTED = 10_000
#: The share of the sample's documents that makes a shingle a heavy key.
HEAVY_ONE_IN = 1000


def shingles(words: list[bytes]) -> set[int]:
    return set_links.shingles(words, WIDTH)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.steps(batches):
        found = [s for text in common.texts_of(batch) for s in shingles(text.lower().split())]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64))], names=["shingle"])


def common_shingles(numbered: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles, sorted, that repeat in a sample of documents, their counts there, and the least count of a heavy one."""
    every = max(1, numbered.count() // COUNTED)
    sample = numbered.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0)
    known, counts = set_links.common_shingles(sample.mapInArrow(_shingled, "shingle long"))
    return known, counts, max(3, sample.count() // HEAVY_ONE_IN + 1)


def _prints(batches: Iterator[pa.RecordBatch], known: np.ndarray, counts: np.ndarray, heavy: int) -> Iterator[pa.RecordBatch]:
    names = ["row", "same", "size", "low", "high", "bits", "keys", "n_light"]
    for batch in common.steps(batches):
        rows = []
        for text in common.texts_of(batch):
            words = text.lower().split()
            own = shingles(words)
            own = np.fromiter(own, np.uint64, len(own))
            bits = set_links.parities(own)
            n_prefix = len(own) + -SHARED * len(own) // OF + 1
            keys, n = (x[:n_prefix] for x in set_links.ordered(own, known, counts))
            # Keys come by rising counts, so the heavy ones are the last.
            rows.append((xxhash.xxh3_128_digest(b" ".join(words)), len(own), *set_links.halves(bits), bits.tobytes(), keys.view(np.int64), int((n < heavy).sum())))
        same, size, low, high, bits, keys, light = zip(*rows) if rows else ((),) * 7
        columns = [pa.array(same, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, low, high)), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(light, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=names)


def near_prints(prints: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of rows of ``row``, ``fp`` that SimHash's index links, all to be verified on their sets. The least row of
    a fingerprint stands for it; the others are tied to that."""
    heads = common.cut(prints.groupBy("fp").agg(F.min("row").alias("head"), F.count("*").alias("n")))
    ends = simhash.links(heads.select("fp"))
    for end in ("a", "b"):
        ends = ends.join(heads.select(F.col("fp").alias(end), F.col("head").alias(f"row_{end}")), end)
    ends = ends.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))
    same = common.lookup(prints.select("row", "fp"), heads.filter("n > 1"), ["fp"], ["head"], "n", prints.count(), ["row"])
    return same.filter("head <> row").select(F.col("head").alias("a"), F.col("row").alias("b")).unionByName(ends).withColumn("check", F.lit(True))


def candidates(prints: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of rows of ``row``, ``size``, ``low``, ``high``, ``bits``, ``keys``, ``n_light``, whose classes hold all links,
    and ``check``, whether the pair itself is to be verified first."""
    every = prints.select("row", "size", "low", "high", "n_light", F.posexplode("keys").alias("pos", "key"))
    every = every.withColumn("pos", F.col("pos").cast("long"))
    index = every.filter("pos < n_light").select("key", "row", "size", "pos", "low", "high")
    met = index.repartition("key").sortWithinPartitions("key", "row").mapInArrow(partial(_meet, most=HOT_KEY), "key long, row long").distinct()
    again = met.join(prints.select("row", "size", "bits"), "row").select("key", "row", "size", "bits")
    pairs = common.cut(again.repartition("key").sortWithinPartitions("key", "row").mapInArrow(partial(_tie, most=HOT_KEY), "a long, b long, star boolean"))
    trees = pairs.filter("not star").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).withColumn("check", F.lit(True))
    stars = _stars(every.filter("pos >= n_light").select("key", "row", "size", "pos")).unionByName(pairs.filter("star").select("a", "b"))
    stars = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Of a row's ties only the first is verified at once: the others hold its class together.
    first = stars.groupBy("b").agg(F.min("a").alias("first"))
    stars = stars.join(first, "b").select("a", "b", (F.col("a") == F.col("first")).alias("check"))
    return trees.unionByName(stars).groupBy("a", "b").agg(F.max("check").alias("check"))


def _stars(rows: DataFrame) -> DataFrame:
    """Ties ``a``, ``b`` of the rows of heavy keys to the least row of the key that can be the smaller of a pair, by
    bands of size. Sizes of a pair are in one band or in two that follow each other; the smaller's names the tie."""
    band = F.floor(F.log("size") / F.lit(math.log(OF / SHARED) * 1.001)).cast("long")
    early = F.when((OF + SHARED) * F.col("pos") <= F.col("size"), F.col("row"))
    either = F.explode(F.array(F.struct(band.alias("band"), early.alias("smaller")), F.struct((band - 1).alias("band"), F.lit(None).cast("long").alias("smaller"))))
    dealt = rows.select("key", "row", either.alias("at")).select("key", "row", "at.*")
    heads = dealt.groupBy("key", "band").agg(F.min("smaller").alias("head"), F.count("*").alias("n")).filter("head is not null")
    met = common.lookup(dealt, heads, ["key", "band"], ["head"], "n", dealt.count(), ["row"])
    return met.filter("head <> row").select(F.col("head").alias("a"), F.col("row").alias("b"))


def _possible(x: list, y: list) -> np.ndarray:
    """Whether sets of (size, pos, low, high) that share the shingle at pos, and none before, can be similar enough."""
    both = x[0] + y[0]
    differ = np.bitwise_count(x[2] ^ y[2]).astype(np.int64) + np.bitwise_count(x[3] ^ y[3])
    room = np.minimum(x[0] - x[1], y[0] - y[1])
    return ((OF + SHARED) * room >= SHARED * both) & ((OF + SHARED) * differ <= (OF - SHARED) * both)


def _folded(bits: list[bytes], to: int) -> np.ndarray:
    """Parities of equal length as rows of to bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1, to), axis=1)


def _close(x: list, y: list) -> np.ndarray:
    """Whether a set of (size, bits) and each of others can be similar enough."""
    both = x[0] + y[0]
    out = (OF + SHARED) * np.minimum(x[0], y[0]) >= SHARED * both
    at = np.flatnonzero(out)
    widths = np.array([len(y[1][i]) for i in at.tolist()], np.int64)
    for width in np.unique(widths).tolist():
        own = at[widths == width]
        to = min(width, len(x[1]))
        differ = np.bitwise_count(_folded(y[1][own].tolist(), to) ^ _folded([x[1]], to)).sum(1, dtype=np.int64)
        out[own] = (OF + SHARED) * differ <= (OF - SHARED) * both[own]
    return out


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, bool]]:
    """Columns of rows sorted by key, where their runs begin (and end), and whether the first run is hot."""
    rest, hot = None, False
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(c) for c in zip(rest, columns)]
        key = columns[0]
        if not len(key):
            continue
        at = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        if len(at) > 1:
            yield columns, at, hot
            hot = False
        # The last run may go on. Of a hot one the least row is enough.
        rest = [c[at[-1] :] for c in columns]
        if hot or len(rest[0]) > most:
            yield rest, np.array([0, len(rest[0])]), True
            rest, hot = [c[:1] for c in rest], True
    if rest is not None:
        yield rest, np.array([0, len(rest[0])]), hot


def _meet(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of groups that each key's possible pairs make; a group's key is a hash of its rows."""
    for columns, at, hot in _runs(batches, most):
        key, row, own = columns[0], columns[1], columns[2:4] + [c.view(np.uint64) for c in columns[4:]]
        keys, rows = [], []
        size = np.diff(at)
        many = size > most
        many[:1] |= hot
        first = at[:-1][(size == 2) & ~many]
        first = first[_possible([c[first] for c in own], [c[first + 1] for c in own])]
        found = [row[i : i + 2] for i in first.tolist()]
        for start, n in zip(at[:-1][(size > 2) & ~many].tolist(), size[(size > 2) & ~many].tolist()):
            found += [row[start + np.sort(g)] for g, _ in _joined([c[start : start + n] for c in own], _possible)]
        for group in found:
            keys += [xxhash.xxh64_intdigest(group.tobytes()) >> 1] * len(group)
            rows += group.tolist()
        for start, n in zip(at[:-1][many].tolist(), size[many].tolist()):
            keys += [int(key[start])] * n
            rows += row[start : start + n].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.int64())], names=["key", "row"])


def _tie(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows sorted by key: of a key's possible pairs only a spanning tree leaves, each to be verified. A
    key that is not compared within is tied to its first row."""
    for columns, at, hot in _runs(batches, most):
        row, own = columns[1], columns[2:]
        a, b, star = [], [], []
        for k, (start, n) in enumerate(zip(at[:-1].tolist(), np.diff(at).tolist())):
            tied = n > most or hot and k == 0
            if tied:
                trees = [(np.arange(n), np.zeros(n, int))]
            else:
                trees = _joined([c[start : start + n] for c in own], _close)
            for members, parents in trees:
                a += row[start + parents[1:]].tolist()
                b += row[start + members[1:]].tolist()
                star += [tied] * (len(members) - 1)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(star, pa.bool_())], names=["a", "b", "star"])


def _joined(own: list[np.ndarray], near) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of two sets or more that near ties, with the set that each but the first was found near to,
    in memory linear in the sets."""
    rest, out = np.arange(len(own[0])), []
    while len(rest) > 1:
        reached, parents, rest = [int(rest[0])], [int(rest[0])], rest[1:]
        for x in reached:
            if not len(rest):
                break
            met = near([c[x] for c in own], [c[rest] for c in own])
            if met.any():
                found = rest[met].tolist()
                reached += found
                parents += [x] * len(found)
                rest = rest[~met]
        if len(reached) > 1:
            out.append((np.array(reached), np.array(parents)))
    return out


def groups(docs: DataFrame) -> DataFrame:
    """``row`` (docs' monotonically increasing id) and ``root``, the least row of its group.

    docs must be read from files or a checkpoint, so that its rows are numbered alike when read
    again."""
    ship(docs.sparkSession)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "text")
    known, counts, heavy = common_shingles(numbered)
    columns = "row long, same binary, size long, low long, high long, bits binary, keys array<long>, n_light long"
    prints = common.cut(numbered.mapInArrow(partial(_prints, known=known, counts=counts, heavy=heavy), columns))
    kinds = common.cut(prints.groupBy("same").agg(F.min("row").alias("row"), F.count("*").alias("n")))
    fps = simhash.fingerprints(numbered.withColumnRenamed("row", "doc_id"), WIDTH).withColumnRenamed("doc_id", "row")
    close = near_prints(common.cut(fps.join(kinds, "row", "left_semi")))
    pairs = close.unionByName(candidates(prints.join(kinds, "row", "left_semi"))).groupBy("a", "b").agg(F.max("check").alias("check"))
    linked = common.cut(set_links.settled(pairs, numbered, WIDTH))
    roots = kinds.join(linked, kinds["row"] == linked["node"], "left").select("same", "n", F.coalesce("root", "row").alias("root"))
    return common.lookup(prints.select("row", "same"), roots, ["same"], ["root"], "n", prints.count(), ["row"]).select("row", "root")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their group."""
    own = common.own_name(docs.columns, "__row")
    others = groups(docs).filter("row <> root").select(F.col("row").alias(own))
    return docs.withColumn(own, F.monotonically_increasing_id()).join(others, own, "left_anti").select(common.quoted(docs.columns))
