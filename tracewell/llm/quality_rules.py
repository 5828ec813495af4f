"""Quality rules: counts of a document, two hard limits, and gradient-boosted trees.

The trees are grown on document statistics with the logistic loss, then flattened into numpy
node arrays, by which whole batches are scored. Along the statistics of MONOTONE the chance of
good quality never rises: a text never gains by more symbols or repetition.

Defined results: a null text has no words, all counts zero, and fails the base rule, as does an
empty one. Repeated rows are judged each for itself. Of several labels of one id the
larger counts. Labels that are null, or neither 0 nor 1,
and null ids teach nothing; with labels of one class or none the trees are constant (1 without
labels) and the base rules alone decide. Other columns are passed through; result columns
replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, statistics
from .quality_qda import labelled_statistics

#: Most labelled rows that the fit reads: those least by a hash of the id.
SAMPLE_ROWS = 20_000
#: Statistics along which quality may only fall.
MONOTONE = ("symbols_per_word", "marks_per_word", "repeated_lines", "repeated_words", "upper_share")
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField(n, T.BooleanType()) for n in ("base_failed", "kept")]
    + [T.StructField("quality_score", T.DoubleType())]
)


@dataclass
class Trees:
    """Flattened trees: node i sends x left if x[feature[i]] <= cut[i]; a leaf leads to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


class _Grower:
    """Depth-wise growth over binned statistics; bounds keep monotone leaves in order."""

    def __init__(self, x, falling, depth, rate, ridge, bins, least):
        self.falling, self.depth, self.rate, self.ridge, self.least = falling, depth, rate, ridge, least
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        self.binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)], 1)
        self.bins = max(len(c) for c in self.cuts) + 1
        self.nodes: list[list[float]] = []

    def leaf_value(self, g, h, low, high):
        return float(np.clip(-g / (h + self.ridge), low, high))

    def grow(self, g, h) -> int:
        root = self._node()
        todo = [(root, np.arange(len(g)), 0, -np.inf, np.inf)]
        while todo:
            at, rows, level, low, high = todo.pop()
            sum_g, sum_h = g[rows].sum(), h[rows].sum()
            self.nodes[at][4] = self.rate * self.leaf_value(sum_g, sum_h, low, high)
            split = self._best(rows, g, h, sum_g, sum_h, low, high) if level < self.depth else None
            if split is None:
                continue
            f, b, left_value, right_value = split
            goes_left = self.binned[rows, f] <= b
            a, c = self._node(), self._node()
            self.nodes[at][:4] = [f, self.cuts[f][b], a, c]
            bounds = [(low, high), (low, high)]
            if self.falling[f]:
                middle = (left_value + right_value) / 2
                bounds = [(middle, high), (low, middle)]
            todo.append((a, rows[goes_left], level + 1, *bounds[0]))
            todo.append((c, rows[~goes_left], level + 1, *bounds[1]))
        return root

    def _node(self) -> int:
        i = len(self.nodes)
        self.nodes.append([0, np.inf, i, i, 0.0])
        return i

    def _best(self, rows, g, h, sum_g, sum_h, low, high):
        best, gain_of_best = None, 1e-6
        parent = sum_g**2 / (sum_h + self.ridge)
        for f, cuts in enumerate(self.cuts):
            own = self.binned[rows, f]
            gs = np.cumsum(np.bincount(own, g[rows], self.bins))[: len(cuts)]
            hs = np.cumsum(np.bincount(own, h[rows], self.bins))[: len(cuts)]
            right_g, right_h = sum_g - gs, sum_h - hs
            gain = gs**2 / (hs + self.ridge) + right_g**2 / (right_h + self.ridge) - parent
            lv, rv = np.clip(-gs / (hs + self.ridge), low, high), np.clip(-right_g / (right_h + self.ridge), low, high)
            allowed = (hs >= self.least) & (right_h >= self.least)
            if self.falling[f]:
                allowed &= lv >= rv
            gain = np.where(allowed, gain, 0)
            if len(gain) and gain.max() > gain_of_best:
                b = int(gain.argmax())
                best, gain_of_best = (f, b, lv[b], rv[b]), gain[b]
        return best


def grow(x: np.ndarray, y: np.ndarray, trees=60, depth=4, rate=0.2, ridge=1.0, bins=64, least=2.0, falling=None) -> Trees:
    """Fit trees; ``falling`` marks the columns along which the score may only fall."""
    if falling is None:
        falling = [n in MONOTONE for n in statistics.NAMES]
    if len(y) == 0 or y.min() == y.max():
        leaf = np.zeros(1)
        base = 500.0 if len(y) == 0 or y[0] else -500.0
        zero = np.zeros(1, int)
        return Trees(zero, leaf, zero, zero, leaf, zero, 0, base)
    share = y.mean()
    base = float(np.log(share / (1 - share)))
    grower, roots = _Grower(x, falling, depth, rate, ridge, bins, least), []
    margin = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grower.grow(p - y, p * (1 - p)))
        table = _flat(grower.nodes, roots[-1:], depth, 0.0)
        margin += table.margin(x)
    return _flat(grower.nodes, roots, depth, base)


def _flat(nodes, roots, depth, base) -> Trees:
    f, cut, left, right, value = zip(*nodes)
    ints = [np.array(v, int) for v in (f, left, right)]
    return Trees(ints[0], np.array(cut, float), ints[1], ints[2], np.array(value, float), np.array(roots, int), depth, base)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    return grow(*labelled_statistics(docs, labels, lambda c: F.lit(True), sample_rows))


def measure(text: bytes) -> tuple[list[int], list[float]]:
    """The base counts and the statistics of one text."""
    words = text.split()
    dup, lines = statistics.repeated_lines(text)
    repeated = statistics.repeated_words(words)
    chars = statistics.code_points(b"".join(words))
    symbols = len(text) - len(text.translate(None, statistics.SYMBOLS))
    return [len(words), chars, symbols, dup, repeated], statistics.features(text, words, repeated, dup, lines)


def judge(docs: DataFrame, model: Trees, columns: list[str] | None = None, threshold: float = 0.5, prefix: str = "") -> DataFrame:
    """``columns`` of docs (all by default) with the columns of RESULT, named after a prefix."""
    added = [T.StructField(f"{prefix}{f.name}", f.dataType) for f in RESULT]
    kept = common.without(columns or docs.columns, [f.name for f in added])
    out = T.StructType([*(docs.schema[c] for c in kept), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "__text"):
            measured = [measure(x) for x in common.texts_of(batch, "__text")]
            counts = np.array([m[0] for m in measured], np.int64).reshape(-1, 5)
            score = model.score(np.array([m[1] for m in measured]).reshape(-1, len(statistics.NAMES)))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED_PERCENT * counts[:, 0])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(kept))), *(pa.array(c) for c in counts.T),
                 pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)],
                names=out.names,
            )

    return docs.select(*common.positional(kept), F.col("text").alias("__text")).mapInArrow(run, out)
