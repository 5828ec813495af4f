"""Quality classifier: a regularised quadratic discriminant over document statistics.

Each class is a Gaussian over transformed statistics; its covariance is shrunk towards the
pooled one and its diagonal. A score is the logistic of the difference of the two
log-densities, each a Mahalanobis distance by a cached Cholesky factor.

Defined results: null and empty texts have all statistics zero and are scored like any other
text. Rows that repeat are scored each for itself, in any order. Of several labels of one id the
larger counts. Labels that are null, or neither
0 nor 1, and null ids teach nothing. With no label of a class, the other's is known: the
score is that class's share, 0.5 with no labels at all. Other columns are passed through;
``score`` and ``predicted`` replace columns of those names.
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

#: Most labelled rows that the fit reads: those least by a hash of the id.
SAMPLE_ROWS = 20_000
#: Weights of the pooled covariance, and of its diagonal, in each class's covariance.
POOLED, DIAGONAL = 0.3, 0.2
#: Least variance of a standardised statistic.
FLOOR = 0.02


def transform(x: np.ndarray) -> np.ndarray:
    """Square roots of the shares and ratios, which are skewed; logarithms stay."""
    keep = np.array([name.startswith(("log_", "line_words")) for name in statistics.NAMES])
    return np.where(keep, x, np.sqrt(np.maximum(x, 0)))


@dataclass
class Discriminant:
    """``chol[k]`` is the lower Cholesky factor of class k's covariance; ``offset[k]`` the log
    prior less half the log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    mean: np.ndarray
    chol: np.ndarray
    offset: np.ndarray
    share: float | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Discriminant:
        d = x.shape[1]
        if len(y) == 0 or y.min() == y.max():
            share = 0.5 if len(y) == 0 else float(y[0])
            return cls(np.zeros(d), np.ones(d), np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), share)
        z = transform(x)
        centre, scale = z.mean(0), z.std(0)
        scale[scale < 1e-6] = 1.0
        z = (z - centre) / scale
        means, covs, counts = [], [], []
        for k in (0, 1):
            own = z[y == k]
            means.append(own.mean(0))
            covs.append(np.cov(own.T, bias=True).reshape(d, d))
            counts.append(len(own))
        pooled = (counts[0] * covs[0] + counts[1] * covs[1]) / sum(counts)
        chol, offset = [], []
        for k in (0, 1):
            cov = (1 - POOLED - DIAGONAL) * covs[k] + POOLED * pooled + DIAGONAL * np.diag(np.diag(pooled))
            factor = np.linalg.cholesky(cov + FLOOR * np.eye(d))
            chol.append(factor)
            offset.append(np.log(counts[k] / sum(counts)) - np.log(np.diag(factor)).sum())
        return cls(centre, scale, np.array(means), np.array(chol), np.array(offset))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row of statistics."""
        if self.share is not None:
            return np.full(len(x), self.share)
        z = (transform(x) - self.centre) / self.scale
        logs = []
        for k in (0, 1):
            white = whitened(self.chol[k], z - self.mean[k])
            logs.append(self.offset[k] - 0.5 * (white**2).sum(1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def whitened(factor: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Rows of x by the inverse of a lower triangular factor, by forward substitution, all rows at once."""
    out = np.empty_like(x)
    for i in range(x.shape[1]):
        out[:, i] = (x[:, i] - out[:, :i] @ factor[i, :i]) / factor[i, i]
    return out


def statistics_of(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics.document_features(x) for x in texts]).reshape(-1, len(statistics.NAMES))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.steps(batches):
        x = statistics_of(common.texts_of(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["quality", "x"]
        )


def labelled_statistics(docs: DataFrame, labels: DataFrame, allowed, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample_rows`` labelled documents with ``allowed``.

    The sample is chosen among the labels first, so that only its texts are read by Python;
    being bounded, its ids may be broadcast.
    """
    few = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(allowed(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("quality", "text")
        .mapInArrow(_measure, "quality int, x array<double>").toArrow()
    )
    y = rows.column("quality").to_numpy()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(statistics.NAMES)) if len(y) else np.zeros((0, len(statistics.NAMES)))
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order in which rows arrive
    return x[order], y[order]


def fit(docs: DataFrame, labels: DataFrame, modulus: int | None = 3, sample_rows: int = SAMPLE_ROWS) -> Discriminant:
    """Fit on labelled documents; with a modulus, on those it does not hold out."""
    allowed = (lambda c: common.learnable(c, modulus)) if modulus else (lambda c: F.lit(True))
    return Discriminant.fit(*labelled_statistics(docs, labels, allowed, sample_rows))


def classify(docs: DataFrame, model: Discriminant, columns: list[str] | None = None, threshold: float = 0.5, prefix: str = "") -> DataFrame:
    """``columns`` of docs (all by default) with ``score`` and ``predicted``, named after a prefix."""
    names = [f"{prefix}score", f"{prefix}predicted"]
    kept = common.without(columns or docs.columns, names)
    fields = [docs.schema[c] for c in kept]
    out = T.StructType([*fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.steps(batches, "__text"):
            score = model.score(statistics_of(common.texts_of(batch, "__text")))
            own = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*kept, *names]
            )

    return docs.select(*common.positional(kept), F.col("text").alias("__text")).mapInArrow(run, out)
