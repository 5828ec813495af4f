"""Trie of conversations' prefixes, by rolling fingerprints that are verified turn by turn.

A conversation's prefix of d turns has a polynomial fingerprint: the sum, over its turns, of the turn's
digest times a power of a base, modulo two primes. Fingerprints of all prefixes come from one numpy
scan along the sorted turns (``ranges.running_sums``), which a conversation of very many turns does not
hold in one task. Equal (depth, fingerprint) make a group. Each member's turn and the group that its
prefix without that turn is in are compared with those of the group's representative, the smallest id:
if they agree in all groups, these are the distinct prefixes, by induction over depth. Where any do not, every
prefix takes a further fingerprint with another base, which splits the collision, until all agree.

Turns are compared by SHA-256 of role and text. Values of subtrees need no pass for each level: a leaf
adds to the nodes on its smallest conversation's path; of the saved bytes, a conversation's own turns count for
each node on its path, less those turns whose node it represents, and both are sums along its turns.

Defined results: turns are ordered by turn, null first, equal ones by digest; a null role or text is
empty; rows without conv_id belong to no conversation. The remainder of a negative id is that of SQL.
Repeated rows are turns like others. No conversations give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranges import running_sums
from . import common

#: Two primes below 2^31, the moduli of fingerprints.
PRIMES = (2_147_483_647, 2_147_483_629)
#: Bits of the range of ids whose list is one row.
CHUNK_BITS = 12
#: Most turns that a conversation takes over from the first of its family, plus one; ids in a family.
HEADS, FAMILY = 9, 5
_WORDS = ("__d0", "__d1", "__d2", "__d3")


def digested(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``digest`` of role and text, and the text's UTF-8 ``bytes`` of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(said, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    )


def taken_over(conv_id: Column) -> Column:
    """Turns that a conversation takes over from the first of its family."""
    return F.crc32(conv_id.cast("string")) % HEADS


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (``conv_id``, ``depth`` from 1, ``digest``, ``bytes``), and all their ids."""
    placed = running_sums(turns.withColumn("one", F.lit(1).cast("long")), "conv_id", ["turn", "digest"], {"pos": "one"})
    sizes = common.cut(placed.groupBy("conv_id").agg(F.count("*").alias("n")))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    families = sizes.select("conv_id", "n", taken_over(F.col("conv_id")).alias("h"), base.alias("base"))
    firsts = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    plan = common.cut(families.join(firsts, "base", "left").withColumn("m", F.least("h", F.coalesce("of_base", F.lit(0)))))
    heads = placed.filter(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    before = plan.filter("m > 0").select("conv_id", "base", "m").join(heads, "base").filter("pos <= m")
    own = placed.filter(F.col("pos") > taken_over(F.col("conv_id")))
    after = common.lookup(own.select("conv_id", "pos", "digest", "bytes"), plan.select("conv_id", "m", "n"), ["conv_id"], ["m"], "n", turns.count(), ["pos"])
    depth = F.col("pos") - taken_over(F.col("conv_id")) + F.col("m")
    every = before.select("conv_id", F.col("pos").alias("depth"), "digest", "bytes").unionByName(after.select("conv_id", depth.alias("depth"), "digest", "bytes"))
    return every, sizes.select("conv_id")


def _powers(base: int, depth: np.ndarray, prime: int) -> np.ndarray:
    """base to each depth modulo prime, by squaring."""
    out, square, left = np.ones(len(depth), np.uint64), base % prime, depth.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * np.uint64(square) % np.uint64(prime)
        square, left = square * square % prime, left >> np.uint64(1)
    return out


def _terms(batch: pa.RecordBatch, bases: tuple[int, ...], primes: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Each turn's addend of its prefixes' fingerprints, by base and prime, and its digest as four longs."""
    depth = batch.column("depth").to_numpy()
    words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "<u8").reshape(-1, 4)
    out = {name: np.ascontiguousarray(words[:, k]).view(np.int64) for k, name in enumerate(_WORDS)}
    for b, base in enumerate(bases):
        for k, prime in enumerate(primes):
            value = words[:, 2 * (b % 2) + k] % np.uint64(prime)
            out[f"__t{b}_{k}"] = (value * _powers(base + k, depth, prime) % np.uint64(prime)).astype(np.int64)
    return out


def fingerprinted(turns: DataFrame, bases: tuple[int, ...], primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """turns with ``upto``, the bytes of the prefix, and arrays ``fp`` and ``before``, the fingerprints of the
    prefix with the turn and without it, one for each base."""
    names = [(b, k) for b in range(len(bases)) for k in range(len(primes))]
    added = dict.fromkeys((*_WORDS, *(f"__t{b}_{k}" for b, k in names)), T.LongType())
    sums = {f"__f{b}_{k}": f"__t{b}_{k}" for b, k in names}
    moduli = {f"__f{b}_{k}": primes[k] for b, k in names}
    found = running_sums(turns, "conv_id", ["depth"], sums | {"upto": "bytes"}, moduli, partial(_terms, bases=bases, primes=primes), added)

    def packed(value) -> Column:
        return F.array(*(sum((F.shiftleft(value(b, k), 31 * k) for k in range(len(primes))), F.lit(0).cast("long")) for b in range(len(bases))))

    now = packed(lambda b, k: F.col(f"__f{b}_{k}"))
    less = packed(lambda b, k: F.pmod(F.col(f"__f{b}_{k}") - F.col(f"__t{b}_{k}"), F.lit(primes[k])))
    return found.select("conv_id", "depth", "bytes", "upto", *_WORDS, now.alias("fp"), less.alias("before"))


def verified(turns: DataFrame, primes: tuple[int, ...] = PRIMES) -> tuple[DataFrame, DataFrame]:
    """Rows of turns with their fingerprints, and groups (``depth``, ``fp``) of equal prefixes, cut, with the
    representative ``rep`` (smallest id), its ``before``, ``n_convs``, ``bytes`` and ``upto``."""
    turns, bases = common.cut(turns), ()
    while True:
        bases = (*bases, 1_000_003 + 7_919 * len(bases))
        rows = fingerprinted(turns, bases, primes)
        # What the representative has, all have where the least and the largest of the members agree.
        same = [*_WORDS, *(f"__b{b}" for b in range(len(bases)))]
        parts = [F.get("before", F.lit(b)).alias(f"__b{b}") for b in range(len(bases))]
        agree = [x(c).alias(f"{x.__name__}_{c}") for c in same for x in (F.min, F.max)]
        groups = common.cut(
            rows.select("*", *parts).groupBy("depth", "fp")
            .agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.min("upto").alias("upto"), *agree)
        )
        if groups.filter(" or ".join(f"min_{c} <> max_{c}" for c in same)).isEmpty():
            before = F.array(*(F.col(f"min___b{b}") for b in range(len(bases)))).alias("before")
            return rows, groups.select("depth", "fp", "rep", "n_convs", "bytes", "upto", before)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each node's lists of ids, which come sorted."""

    def row(node, state) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*node, state.hexdigest()), kinds, strict=True)], names=["depth", "fp", "ends_sha256"])

    now, state = None, None
    for batch in batches:
        done = []
        for depth, fp, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "fp", "ids")), strict=True):
            if now != (depth, fp):
                if now is not None:
                    done.append(row(now, state))
                now, state = (depth, fp), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if now is not None:
        yield row(now, state)


def trie(conversations: DataFrame, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations, the root (depth 0) included: ``conv_id`` (smallest
    member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    every, ids = rebuilt(digested(conversations))
    rows, groups = verified(every, primes)
    return rolled_up(rows, groups, ids)


def rolled_up(rows: DataFrame, groups: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes' table, from rows with fingerprints, their groups, and all conversations' ids."""
    children = common.cut(groups.groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("fp")).agg(F.count("*").alias("n_children")))
    root_fp = rows.limit(1).select("before").first()
    root_fp = F.array(*[F.lit(0).cast("long")] * (len(root_fp[0]) if root_fp else 1))
    root = ids.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), root_fp.alias("fp"), "rep", "n_convs", zero.alias("bytes"), zero.alias("upto"), F.lit(None).cast("array<long>").alias("before"))
    nodes = common.cut(groups.unionByName(root).join(children, ["depth", "fp"], "left").withColumn("n_children", F.coalesce("n_children", zero)))
    # Per conversation: the bytes before the first turn that it represents, and whether it names a leaf.
    first = nodes.filter("depth > 0").groupBy(F.col("rep").alias("conv_id")).agg(
        F.min(F.col("upto") - F.col("bytes")).alias("shared"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).cast("long").alias("leaf")
    )
    lengths = rows.groupBy("conv_id").agg(F.max("depth").alias("length"), F.max("upto").alias("total"), F.count("*").alias("n"))
    convs = common.cut(lengths.join(first, "conv_id", "left").select("conv_id", "length", "n", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", zero).alias("leaf")))
    n_rows = convs.agg(F.sum("n")).first()[0] or 0
    known = common.lookup(rows.select("conv_id", "depth", "fp", "bytes", "upto"), convs, ["conv_id"], ["length", "shared", "leaf"], "n", n_rows, ["depth"])
    known = common.cut(known)
    saved = F.greatest(F.col("shared") - F.col("upto") + F.col("bytes"), zero)
    sums = known.groupBy("depth", "fp").agg(F.sum("leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    whole = convs.agg(F.sum("leaf").alias("n_leaves"), F.sum("shared").alias("saved_tokens"))
    sums = sums.unionByName(whole.select(zero.alias("depth"), root_fp.alias("fp"), F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), "saved_tokens"))
    ends = known.filter("depth = length").select("depth", "fp", "conv_id")
    ends = ends.unionByName(ids.join(convs, "conv_id", "left_anti").select(zero.alias("depth"), root_fp.alias("fp"), "conv_id"))
    lists = ends.groupBy("depth", "fp", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    digests = lists.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "chunk").mapInArrow(_hashed, "depth long, fp array<long>, ends_sha256 string")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("before"), F.col("rep").alias("parent_conv_id"), "n_children")
    named = common.lookup(nodes.withColumn("spread", F.xxhash64("fp")), above, ["depth", "before"], ["parent_conv_id"], "n_children", nodes.count(), ["spread"])
    out = named.join(sums, ["depth", "fp"], "left").join(digests, ["depth", "fp"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("rep").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
