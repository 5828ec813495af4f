"""Distributed connected components by alternating large and small stars, contracted within tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ONE_IN, cut

#: Edges, about, that a task contracts at a time, and at least in all where there are as many.
HELD_EDGES, EDGES_A_TASK = 200_000, 50_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root``: the least node of each node's component, for nodes with an edge.

    Ends are longs. Loops and edges with a null end say nothing; repeated edges count once. No
    edges give no rows. Tasks first replace their own edges by stars to the least node that these reach. Then
    nodes' neighbours are tied to the least of them, the larger and the smaller in turn, until only stars are left,
    in rounds that grow with the logarithm of the longest path. Minima of nodes of very many edges, HOT_ONE_IN nodes
    at most, are aggregated and broadcast to these edges, so that a hub does not gather in one task;
    rounds are cut by reliable checkpoints.
    """
    ends = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    state = cut(ends)
    total = state.count()
    state = cut(_contracted(state, total))
    while not _stars(state):
        total = state.count()
        state = cut(_contracted(_star(_star(state, 2 * total, True), total, False), total))
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()


def _stars(state: DataFrame) -> bool:
    """Whether each node is tied to one smaller node, which is tied to none."""
    none = F.lit(None).cast("long")
    nodes = state.select(F.col("u").alias("node"), F.col("v").alias("to"), F.lit(False).alias("root"))
    nodes = nodes.unionByName(state.select(F.col("v").alias("node"), none.alias("to"), F.lit(True).alias("root")))
    seen = nodes.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max(F.col("root").cast("int")).alias("root"))
    return seen.filter("low <> high or root = 1 and low is not null").isEmpty()


def _star(edges: DataFrame, total: int, large: bool) -> DataFrame:
    """Of edges (u, v) with u > v: larger neighbours of each node, or the node and its smaller ones, tied to the least of all."""
    rows = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    hot = rows.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).filter(F.col("n") * HOT_ONE_IN > F.lit(total))
    met = rows.join(F.broadcast(hot.select("u", F.least("u", "low").alias("low"))), "u", "left")
    hubs = met.filter("low is not null")
    dealt = met.filter("low is null").select("u", "v").repartition("u").sortWithinPartitions("u", "v")
    tied = dealt.mapInArrow(_large if large else _small, "u long, v long")
    if large:
        return tied.unionByName(hubs.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")))
    ends = hubs.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return tied.unionByName(ends).unionByName(hubs.filter("v = low").select("u", "v"))


def _batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows sorted by u and v, each with the least v of its u."""
    last, low = None, None
    for batch in batches:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(u):
            continue
        starts = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        first = v[starts].copy()
        if last is not None and u[0] == last:
            first[0] = low
        last, low = u[-1], first[-1]
        yield u, v, np.repeat(first, np.diff(np.append(starts, len(u))))


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for u, v, low in _least(batches):
        keep = v > u
        yield _batch(v[keep], np.minimum(low, u)[keep])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for u, v, low in _least(batches):
        other = v != low
        yield _batch(np.concatenate([v[other], u[~other]]), np.concatenate([low[other], low[~other]]))


def _contracted(edges: DataFrame, total: int) -> DataFrame:
    """Partitions of few edges are put together first: the more a task has, the more it can contract."""
    return edges.coalesce(1 + total // EDGES_A_TASK).mapInArrow(_contract, "u long, v long")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges, some at a time, as stars to the least node that these reach."""
    held, size = [], 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        size += batch.num_rows
        if size >= HELD_EDGES:
            yield _stars_of(np.concatenate(held, axis=1))
            held, size = [], 0
    if size:
        yield _stars_of(np.concatenate(held, axis=1))


def _stars_of(edges: np.ndarray) -> pa.RecordBatch:
    nodes, at = np.unique(edges, return_inverse=True)
    u, v = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        one, two = label[u], label[v]
        open_ = one != two
        if not open_.any():
            break
        np.minimum.at(label, np.maximum(one, two)[open_], np.minimum(one, two)[open_])
        while (label[label] != label).any():
            label = label[label]
        u, v = u[open_], v[open_]
    tied = label != np.arange(len(nodes))
    return _batch(nodes[tied], nodes[label[tied]])
