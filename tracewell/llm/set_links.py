"""Exact links between texts whose sets of word shingles have a Jaccard index of at least SHARED / OF.

``settled`` takes pairs of rows from any candidate search whose connected classes hold all links, a spanning
tree for each class being enough. The sets of rows that are in a class are written once, as sorted hashes, and the pairs
verified on them. A class that its verified pairs tie together needs nothing more, however large. In any other class
each pair of rows of different parts may still be a link; ``possible`` finds where by prefix filtering: shingles are
ordered by their count in about COUNTED of these sets, rarest first, and for sets y and x, y no larger, the first
shingle that they share is among the first |y| / 9 + 1 of y and |x| / 5 + 1 of x, in any common order. A shingle that no
y has so early gives no pairs, so rows of one template, which are alike in common shingles only, do not meet. The rows
of a shingle are compared in blocks of BLOCK, by sizes, positions and parities, and leave as a forest of the parts that
possible pairs tie. So pairs are never listed: the sets of each tree's rows go to one task, where pairs of
different parts are verified and what they tie becomes one part at once. Of a tree of more than a block, rows of its
largest part meet the others, by blocks, but not each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import connected_components

#: A Jaccard index of at least SHARED / OF.
SHARED, OF = 4, 5
#: Rows of a block, and shingles of all its sets, about.
BLOCK, BLOCK_SHINGLES = 2000, 1_000_000
#: Parities by which sets of a block are told apart, and pairs that are verified at once, at first.
FINE, FIRST_PAIRS = 1024, 16
#: Sets, about, whose shingles are counted for their order, and most shingles with counts.
COUNTED, COMMON = 10_000, 100_000
#: Parts in which the pairs of one document are dealt out for verification.
PARTS_OF_A_HUB = 4096


def shingles(words: list[bytes], width: int) -> set[int]:
    """Hashes of the runs of width words; of all words if there are fewer."""
    if len(words) < width:
        return {xxhash.xxh64_intdigest(b" ".join(words))}
    return set(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(width))))))


def similar(a: set[int], b: set[int]) -> bool:
    both = len(a & b)
    return OF * both >= SHARED * (len(a) + len(b) - both)


def parities(own: np.ndarray, least: int = 128) -> np.ndarray:
    """Packed parities of a set's shingles: sets differ in no fewer shingles than parities.

    There are ``least`` or the next power of two from the set's size; halves XORed are those of half as many."""
    width = max(least, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8))


def halves(bits: np.ndarray) -> tuple[int, int]:
    """Parities folded to 128, as two longs."""
    low, high = np.bitwise_xor.reduce(bits.reshape(-1, 16), axis=0).view("<i8").tolist()
    return low, high


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Each row's shingles as sorted hashes."""
    for batch in common.steps(batches):
        found = (shingles(t.lower().split(), width) for t in common.texts_of(batch))
        own = [np.sort(np.fromiter(s, np.uint64, len(s))).tobytes() for s in found]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(own, pa.binary())], names=["row", "own"])


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets, and whether they are similar enough."""
    for batch in common.steps(batches, "own_b"):
        good = []
        for s, t in zip(batch.column("own_a").to_pylist(), batch.column("own_b").to_pylist(), strict=True):
            one, two = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            few, many = (one, two) if len(one) < len(two) else (two, one)
            at = np.minimum(np.searchsorted(many, few), len(many) - 1)
            both = int((many[at] == few).sum())
            good.append(OF * both >= SHARED * (len(one) + len(two) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "good"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a``, ``b``, ``good`` of distinct pairs of rows of sets (``row``, ``own``). A row of very many pairs
    sends its set once to each of the parts that they are dealt out in."""
    dealt = F.pmod(F.xxhash64("b"), F.lit(PARTS_OF_A_HUB)).alias("deal")
    ends = pairs.select("a", "b", dealt)
    whole = ends.join(sets.select(F.col("row").alias("b"), F.col("own").alias("own_b")), "b")
    heads = ends.select("a", "deal").distinct().join(sets.select(F.col("row").alias("a"), F.col("own").alias("own_a")), "a")
    return whole.join(heads, ["a", "deal"]).select("a", "b", "own_a", "own_b").mapInArrow(_check, "a long, b long, good boolean")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column("own").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(flat)], names=["shingle"])


def ordered(own: np.ndarray, known: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's shingles, rarest first, and their counts; those that are not known come first, by hash."""
    n = np.zeros(len(own), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        n = np.where(known[at] == own, counts[at], 0)
    order = np.lexsort((own, n))
    return own[order], n[order]


def common_shingles(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of ``shingle``: those that repeat, sorted, and their counts."""
    counts = sample.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingle, n = (top.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(shingle.view(np.uint64))
    return shingle.view(np.uint64)[order], n[order]


def _prefixes(batches: Iterator[pa.RecordBatch], known: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Index rows of sets: their rarest shingles, as many as the larger of a pair needs."""
    names = ["key", "row", "part", "size", "pos", "low", "high"]
    for batch in common.steps(batches, "own"):
        at, rows = [], []
        for k, data in enumerate(batch.column("own").to_pylist()):
            own = np.frombuffer(data, np.uint64)
            low, high = halves(parities(own))
            n = len(own) // OF + 1
            keys = ordered(own, known, counts)[0][:n].view(np.int64)
            at += [k] * len(keys)
            rows.append(np.stack([keys, np.full(len(keys), len(own)), np.arange(len(keys)), np.full(len(keys), low), np.full(len(keys), high)]))
        key, size, pos, low, high = np.concatenate(rows, axis=1) if rows else np.zeros((5, 0), np.int64)
        of = {c: batch.column(c).take(pa.array(at, pa.int64())) for c in ("row", "part")}
        of |= {c: pa.array(np.ascontiguousarray(x)) for c, x in zip(("key", "size", "pos", "low", "high"), (key, size, pos, low, high), strict=True)}
        yield pa.RecordBatch.from_arrays([of[c] for c in names], names=names)


def _block(own: list[np.ndarray]) -> list[np.ndarray]:
    """A forest of the parts that possible pairs among a key's rows of one block or two tie."""
    row, part, size, pos, low, high, block = own
    out, label = [], np.unique(part, return_inverse=True)[1]
    two = block.min() != block.max()
    for y in np.flatnonzero(9 * pos <= size).tolist():
        both = size[y] + size
        larger = (size > size[y]) | (size == size[y]) & (row > row[y])
        room = np.minimum(size[y] - pos[y], size - pos)
        differ = np.bitwise_count(low[y] ^ low).astype(np.int64) + np.bitwise_count(high[y] ^ high)
        met = larger & (label != label[y]) & ((OF + SHARED) * room >= SHARED * both) & ((OF + SHARED) * differ <= (OF - SHARED) * both)
        if two:
            met &= block != block[y]
        x = np.flatnonzero(met)
        if len(x):
            labels, first = np.unique(label[x], return_index=True)
            out.append(np.stack([np.full(len(first), part[y]), part[x[first]]]))
            label[np.isin(label, labels)] = label[y]
    return out


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of rows sorted by their first three, with where each run of these begins, and the end."""
    rest = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            columns = [np.concatenate(c) for c in zip(rest, columns, strict=True)]
        if not len(columns[0]):
            continue
        new = np.zeros(len(columns[0]), bool)
        for c in columns[:3]:
            new[1:] |= c[1:] != c[:-1]
        starts = np.append(0, np.flatnonzero(new))
        if len(starts) > 1:
            yield columns, starts
        rest = [c[starts[-1] :] for c in columns]
    if rest is not None:
        yield rest, np.array([0, len(rest[0])])


def _ends(found: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(f(ends, axis=0))) for f in (np.min, np.max)], names=["a", "b"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties of parts by possible pairs of rows sorted by key and blocks."""
    for columns, starts in _places(batches):
        own = columns[3:7] + [c.view(np.uint64) for c in columns[7:9]] + columns[9:10]
        yield _ends([p for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()) if e > s + 1 for p in _block([c[s:e] for c in own])])


def possible(held: DataFrame) -> DataFrame:
    """Ties ``a`` < ``b`` of parts, whose connected classes hold all links between rows (``row``, ``own``) of different ``part``."""
    every = max(1, held.count() // COUNTED)
    known, counts = common_shingles(held.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("own").mapInArrow(_listed, "shingle long"))
    schema = "key long, row long, part long, size long, pos long, low long, high long"
    index = common.cut(held.select("row", "part", "own").mapInArrow(partial(_prefixes, known=known, counts=counts), schema))
    early = F.max((9 * F.col("pos") <= F.col("size")).cast("int"))
    keys = index.groupBy("key").agg(F.count("*").alias("n"), early.alias("early"), F.min("part").alias("least"), F.max("part").alias("most"))
    keys = keys.filter("early = 1 and least < most").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    met = common.lookup(index, keys.select("key", "n", "blocks"), ["key"], ["blocks"], "n", index.count(), ["row"]).filter("blocks is not null")
    met = met.withColumn("block", F.pmod(F.xxhash64("row"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["row", "part", "size", "pos", "low", "high", "block"]
    met = met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), *columns)
    place = ["key", "lo", "hi"]
    return met.repartition(*place).sortWithinPartitions(*place).mapInArrow(_meet, "a long, b long").distinct()


def _links_of(row: np.ndarray, part: np.ndarray, block: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
    """A forest of the links between rows of different parts, of one block (sorted by it) or across two."""
    out, n, label = [], len(row), np.unique(part, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    bits = np.stack([np.packbits(np.bincount((s & np.uint64(FINE - 1)).astype(np.int64), minlength=FINE) & 1) for s in sets]).view(np.uint64)
    second = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else 0
    for y in range(second or n - 1):
        x = np.arange(second or y + 1, n)
        x = x[(label[x] != label[y]) & ((OF + SHARED) * np.minimum(size[y], size[x]) >= SHARED * (size[y] + size[x]))]
        differ = np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64)
        near = (OF + SHARED) * differ <= (OF - SHARED) * (size[y] + size[x])
        x, some = x[near][np.argsort(differ[near], kind="stable")], FIRST_PAIRS
        while len(x):
            # The nearest first: what they tie to y need not be looked at again.
            some, few, x = 2 * some, x[:some], x[some:]
            flat = np.concatenate([sets[k] for k in few.tolist()])
            at = np.minimum(np.searchsorted(sets[y], flat), size[y] - 1)
            both = np.add.reduceat((sets[y][at] == flat).astype(np.int64), np.cumsum(size[few]) - size[few])
            good = few[OF * both >= SHARED * (size[y] + size[few] - both)]
            if len(good):
                labels, first = np.unique(label[good], return_index=True)
                out.append(np.stack([np.full(len(first), row[y]), row[good[first]]]))
                label[np.isin(label, labels)] = label[y]
                x = x[label[x] != label[y]]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest of the links in each class's blocks, from rows sorted by class and blocks."""
    for columns, starts in _places(batches):
        found = []
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            row, part, block, own = (c[s:e] for c in columns[3:])
            if part.min() < part.max():
                found += _links_of(row, part, block, [np.frombuffer(x, np.uint64) for x in own])
        yield _ends(found)


def _blocks(n: str, shingles: str):
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(shingles) / BLOCK_SHINGLES)).cast("long")


def links_within(held: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a`` < ``b`` between rows (``row``, ``own``) of different ``part``, enough to tie all that links do.
    classes: ``node``, a part, and ``root``, its class, of the parts that others may link with."""
    parts = held.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.length("own") / 8).alias("shingles"))
    parts = common.cut(parts.join(classes.select(F.col("node").alias("part"), F.col("root").alias("class")), "part"))
    tops = parts.groupBy("class").agg(F.max(F.struct("n", "part", "shingles")).alias("top"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    tops = tops.select("class", F.col("top.part").alias("top"), F.col("top.n").alias("n"), F.col("top.shingles").alias("shingles"), (F.col("n") - F.col("top.n")).alias("n_rest"), (F.col("shingles") - F.col("top.shingles")).alias("shingles_rest"))
    tops = tops.select("class", "top", _blocks("n", "shingles").alias("of_top"), _blocks("n_rest", "shingles_rest").alias("of_rest"))
    table = parts.select("part", "class", "n").join(tops, "class").withColumn("at", F.struct("class", (F.col("part") == F.col("top")).alias("top"), "of_top", "of_rest"))
    met = common.lookup(held.select("row", "part", "own"), table.select("part", "n", "at"), ["part"], ["at"], "n", held.count(), ["row"]).filter("at is not null")
    met = met.select("row", "part", "own", "at.*")
    deal = F.xxhash64("row")
    block = F.when(F.col("top"), F.col("of_rest") + F.pmod(deal, "of_top")).otherwise(F.pmod(deal, "of_rest"))
    last = F.when(F.col("top"), F.col("of_rest")).otherwise(F.col("of_rest") + F.col("of_top")) - 1
    met = met.select("class", "row", "part", "own", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    met = met.select("class", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "row", "part", "block", "own")
    return met.repartition("class", "lo", "hi").sortWithinPartitions("class", "lo", "hi", "block").mapInArrow(_verify, "a long, b long")


def settled(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``node``, ``root``: the least row of each group of rows that links make, for rows with a link.

    pairs: distinct ``a`` and ``b`` whose connected classes hold all links, and ``check``, whether to verify the pair
    at once; others hold a class together only. texts: ``row`` and ``text``, read alike each time."""
    pairs = common.cut(pairs)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row"))
    sets = texts.join(ends, "row", "left_semi").select("row", "text")
    sets = common.cut(sets.mapInArrow(partial(_sets, width=width), "row long, own binary"))
    checked = common.cut(verified(pairs.filter("check"), sets))
    tied = checked.filter("good").select("a", "b")
    part = common.cut(connected_components(tied))
    # Pairs that are not links hold classes together: a class has several parts where one of them joins two.
    held = pairs.join(checked.filter("good"), ["a", "b"], "left_anti").select("a", "b", "check")
    for end in ("a", "b"):
        held = held.join(part.select(F.col("node").alias(end), F.col("root").alias(f"part_{end}")), end, "left")
    held = held.select(F.coalesce("part_a", "a").alias("one"), F.coalesce("part_b", "b").alias("two"), "check", (F.col("part_a").isNull() & F.col("part_b").isNull()).alias("alone"))
    held = common.cut(held.filter("one <> two"))
    other = held.select(F.col("two").alias("one"), F.col("one").alias("two"), "check", "alone")
    parts = held.unionByName(other).groupBy("one").agg(F.min("two").alias("least"), F.max("two").alias("most"), F.min("alone").alias("alone"), F.min("check").alias("check"))
    # Two rows that only their own verified pair joins are settled.
    mutual = parts.select(F.col("one").alias("least"), (F.col("least") == F.col("most")).alias("only"))
    torn = parts.join(mutual, "least").filter("not (alone and check and least = most and only)").select(F.col("one").alias("part"))
    torn = common.cut(torn)
    if torn.isEmpty():
        return part
    members = part.select(F.col("node").alias("row"), F.col("root").alias("part"))
    alone = torn.select(F.col("part").alias("row"), "part").join(members.select("row"), "row", "left_anti")
    rows = common.cut(members.join(torn, "part", "left_semi").unionByName(alone, allowMissingColumns=True).select("row", "part"))
    held = common.cut(rows.join(sets, "row"))
    classes = common.cut(connected_components(possible(held)))
    if classes.isEmpty():
        return part
    links = links_within(held, classes)
    return connected_components(part.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))
