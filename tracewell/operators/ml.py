"""Model training and scores over account features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import cut, sums_down
from ..session import ship
from ..sources.world import number
from .features import NAMES

#: Trees of the isolation forest, and accounts that each is grown on.
FOREST_TREES, TREE_ROWS = 200, 256
#: Most rounds of a one-class boundary, each over all accounts, and the share of its objective that may be left.
BOUNDARY_ROUNDS, BOUNDARY_GAP = 40, 0.02
#: Widths of the autoencoder's hidden layers; accounts, about, that a task trains on; rounds, and passes in each.
HIDDEN, SHARD_ROWS = (24, 6, 24), 20_000
AUTO_ROUNDS, AUTO_PASSES, AUTO_BATCH = 12, 25, 64


def stratified_split(labelled: DataFrame, fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """(account_id, label) with ``test``: int(n * fraction) of each class, those first by a number of the id.

    The last such number of each class comes from ranked numbers, dealt by ranges, so that no
    task holds a class."""
    drawn = labelled.withColumn("__at", number(F.col("account_id"), seed))
    each = drawn.groupBy("label").agg(F.floor(F.count("*") * fraction).alias("wanted")).collect()  # a row for each class
    test = F.lit(False)
    for label, wanted in each:
        own = drawn.filter(F.col("label") == label).groupBy((-F.col("__at")).alias("at")).agg(F.count("*").alias("n"))
        last = sums_down(own, "at", {"upto": "n"}).filter(F.col("upto") <= wanted).agg(F.min("at")).first()[0]
        test = F.when(F.col("label") == label, F.col("__at") <= (-last if last is not None else -1)).otherwise(test)
    return drawn.withColumn("test", test).drop("__at")


def standardised(features: DataFrame, fitted_on: DataFrame, names=NAMES) -> DataFrame:
    """features with vector ``scaled``; means and deviations come from ``fitted_on`` alone."""
    gather = VectorAssembler(inputCols=list(names), outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(gather.transform(fitted_on))
    return scaler.transform(gather.transform(features)).drop("raw")


def boosted_scores(features: DataFrame, split: DataFrame, rounds: int = 20, names: tuple[str, ...] = tuple(NAMES)) -> DataFrame:
    """``account_id``, ``score``, ``label`` of the test accounts, from trees boosted on the others."""
    rows = features.join(split, "account_id")
    scaled = standardised(rows, rows.filter("not test"), names)
    model = GBTClassifier(featuresCol="scaled", labelCol="label", maxIter=rounds, maxDepth=3, seed=7).fit(scaled.filter("not test"))
    return model.transform(scaled.filter("test")).select("account_id", vector_to_array("probability")[1].alias("score"), "label")


def reconstruction_errors(features: DataFrame, parts: int = 6) -> DataFrame:
    """``account_id``, ``raw``: mean squared error after projection on the leading components: a linear
    counterpart of ``autoencoder_errors``."""
    scaled = standardised(features, features)
    pca = PCA(k=parts, inputCol="scaled", outputCol="part").fit(scaled)
    pc = pca.pc.toArray()  # features by parts
    rebuilt = pc @ pc.T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist()).reshape(len(batch), -1)
            yield pd.DataFrame({"account_id": batch["account_id"], "raw": ((x - x @ rebuilt) ** 2).mean(1)})

    return scaled.select("account_id", vector_to_array("scaled").alias("x")).mapInPandas(run, "account_id string, raw double")


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, nodes: list[tuple]) -> int:
    """Grow a tree's nodes (feature, cut, left, right, rows); a leaf's feature is -1. The root's place is returned."""
    place = len(nodes)
    nodes.append((-1, 0.0, -1, -1, len(x)))
    spread = np.flatnonzero(x.max(0) > x.min(0)) if depth and len(x) > 1 else []
    if len(spread):
        f = int(rng.choice(spread))
        at = rng.uniform(x[:, f].min(), x[:, f].max())
        low = x[:, f] < at
        left = _grow(x[low], rng, depth - 1, nodes)
        nodes[place] = (f, float(at), left, _grow(x[~low], rng, depth - 1, nodes), len(x))
    return place


def _mean_depth(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def isolation_trees(features: DataFrame, trees: int = FOREST_TREES, seed: int = 7) -> DataFrame:
    """``tree``, ``node``, ``feature``, ``cut``, ``low``, ``high``, ``rows``: the forest's trees, each grown by one task on the TREE_ROWS
    accounts that are least by a hash of id and tree, whatever the partitioning.

    An account is a candidate for a tree only if its hash is below four times the share that is wanted, so few rows leave
    the scan; all are where there are few. The chance that fewer than TREE_ROWS are left is below 1e-200."""
    n = features.count()
    height = int(np.ceil(np.log2(max(2, min(TREE_ROWS, n)))))
    span = 1 << 40
    limit = min(span, 4 * TREE_ROWS * span // max(1, n) + 1)
    draw = lambda t: F.pmod(F.xxhash64("account_id", t, F.lit(seed)), F.lit(span))
    drawn = F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < limit))
    some = features.select("account_id", *NAMES).withColumn("tree", drawn)
    least = Window.partitionBy("tree").orderBy(draw(F.col("tree")), "account_id")
    some = some.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= TREE_ROWS)

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        own, nodes = rows.sort_values("place"), []
        tree = int(own["tree"].iloc[0])
        _grow(own[list(NAMES)].to_numpy(float), np.random.default_rng([seed, tree]), height, nodes)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "low", "high", "rows"])
        return out.assign(tree=tree, node=np.arange(len(nodes)))[["tree", "node", "feature", "cut", "low", "high", "rows"]]

    ship(features.sparkSession)
    return some.groupBy("tree").applyInPandas(grow, "tree int, node int, feature int, cut double, low int, high int, rows int")


def _mean_depths(x: np.ndarray, forest: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Each row's mean depth over trees of flat arrays, all rows a level at a time."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, at, low, high, size in forest:
        node, depth = np.zeros(len(x), int), np.zeros(len(x))
        while (inner := feature[node] >= 0).any():
            own = node[inner]
            left = x[rows[inner], feature[own]] < at[own]
            node[inner] = np.where(left, low[own], high[own])
            depth[inner] += 1
        total += depth + np.array([_mean_depth(n) for n in range(size.max() + 1)])[size[node]]
    return total / max(1, len(forest))


def isolation_scores(features: DataFrame, trees: int = FOREST_TREES, seed: int = 7) -> DataFrame:
    """``account_id``, ``raw``: 2 ^ -(mean depth / expected depth), near 1 for accounts that few cuts
    isolate. Only the trees of ``isolation_trees``, of some hundred nodes each, pass through the driver."""
    features = cut(features.select("account_id", *NAMES))
    grown = isolation_trees(features, trees, seed).toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
    columns = [grown.column(c).to_numpy() for c in ("feature", "cut", "low", "high", "rows")]
    starts = np.flatnonzero(grown.column("node").to_numpy() == 0)
    forest = [tuple(c[s:e] for c in columns) for s, e in zip(starts, np.append(starts[1:], grown.num_rows))]
    size = int(forest[0][4][0]) if forest else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            depth = _mean_depths(batch[list(NAMES)].to_numpy(float), forest)
            yield pd.DataFrame({"account_id": batch["account_id"], "raw": 2.0 ** (-depth / max(1e-9, _mean_depth(size)))})

    return features.mapInPandas(run, "account_id string, raw double")


def leaderboard(models: dict[str, DataFrame]) -> DataFrame:
    """``model``, ``average_precision``, ``roc_auc`` of (account_id, score, label) frames, best first."""
    from .scoring import average_precision, roc_auc

    out = None
    for name, df in models.items():
        ids = df.withColumnRenamed("account_id", "id")
        row = average_precision(ids).crossJoin(roc_auc(ids)).select(F.lit(name).alias("model"), "average_precision", "roc_auc")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("average_precision"), "model")


def _summed(df: DataFrame, of, width: int) -> np.ndarray:
    """The sum over all rows of ``of`` (a batch's rows of features to an array of width), by tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += of(np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES], 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["place", "value"])

    sums = df.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").toArrow()
    return sums.column("value").to_numpy() if sums.num_rows else np.zeros(width)


def one_class_scores(features: DataFrame, nu: float = 0.05, waves: int = 256, rounds: int = BOUNDARY_ROUNDS, seed: int = 7) -> DataFrame:
    """``account_id``, ``raw``: how far outside a one-class boundary an account lies.

    The radial kernel is approached by random cosine features z of the accounts, centred and scaled over all. The boundary is
    the point w nearest to the origin among the means of z in which no account weighs over 1 / (nu n): by Frank-Wolfe
    steps, each towards the mean over the share nu of all accounts that lie least along w, with an exact line
    search. Two aggregates over all rows make a step. Steps end when w . (w - that mean), which bounds what is left to
    gain, is below BOUNDARY_GAP of w . w, or after ``rounds``. The threshold rho is the quantile nu of
    w . z, so a share of nu lies outside."""
    features = cut(features.select("account_id", *NAMES))
    ship(features.sparkSession)
    rng = np.random.default_rng(seed)
    whole = features.agg(F.count("*").alias("n"), *(F.avg(n).alias(f"m_{n}") for n in NAMES), *(F.stddev_pop(n).alias(f"s_{n}") for n in NAMES)).first()
    centre, scale = (np.array([whole[f"{p}_{n}"] or 0.0 for n in NAMES], float) for p in ("m", "s"))
    scale = np.where(scale > 1e-9, scale, 1.0)
    lean = rng.normal(0, 1 / np.sqrt(len(NAMES)), (len(NAMES), waves))
    phase = rng.uniform(0, 2 * np.pi, waves)

    def lift(x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / waves) * np.cos((x - centre) / scale @ lean + phase)

    def along(w: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"account_id": batch["account_id"], "along": lift(batch[list(NAMES)].to_numpy(float)) @ w})

        return features.mapInPandas(run, "account_id string, along double")

    def threshold(w: np.ndarray) -> float:
        return along(w).agg(F.percentile_approx("along", nu, 10_000)).first()[0]

    w, rho = np.zeros(waves), 0.0
    if whole.n:
        w = _summed(features, lambda x: lift(x).sum(0), waves) / whole.n
        rho = threshold(w)
        for _ in range(rounds):
            least = _summed(features, lambda x, w=w, rho=rho: np.append((z := lift(x))[(below := z @ w <= rho)].sum(0), below.sum()), waves + 1)
            step = w - least[:waves] / max(1.0, least[waves])
            gap = float(w @ step)
            if gap <= BOUNDARY_GAP * float(w @ w):
                break
            w = w - min(1.0, gap / float(step @ step)) * step
            rho = threshold(w)
    return along(w).select("account_id", (F.lit(float(rho)) - F.col("along")).alias("raw"))


def _forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    out = [x]
    for k, (weight, bias) in enumerate(layers):
        x = x @ weight + bias
        x = x if k == len(layers) - 1 else np.maximum(x, 0.0)
        out.append(x)
    return out


def _trained(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], rng: np.random.Generator, passes: int, rate: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers after some passes of back-propagation with Adam's steps over small batches of x, which is its own target."""
    held = [p.copy() for layer in layers for p in layer]
    mean, square, t = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    for _ in range(passes):
        order = rng.permutation(len(x))
        for start in range(0, len(x), AUTO_BATCH):
            own = x[order[start : start + AUTO_BATCH]]
            seen = _forward(own, list(zip(held[::2], held[1::2])))
            slope = 2 * (seen[-1] - own) / own.size
            t += 1
            for k in range(len(layers) - 1, -1, -1):
                change = (seen[k].T @ slope, slope.sum(0))
                if k:
                    slope = (slope @ held[2 * k].T) * (seen[k] > 0)
                for j, g in zip((2 * k, 2 * k + 1), change):
                    mean[j] = 0.9 * mean[j] + 0.1 * g
                    square[j] = 0.999 * square[j] + 0.001 * g * g
                    held[j] = held[j] - rate * (mean[j] / (1 - 0.9**t)) / (np.sqrt(square[j] / (1 - 0.999**t)) + 1e-8)
    return list(zip(held[::2], held[1::2]))


def _shard_trainer(layers: list[tuple[np.ndarray, np.ndarray]], seed: tuple[int, int], passes: int, rate: float):
    def train(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values("account_id")
        x, shard = np.array(own["x"].tolist()), int(own["shard"].iloc[0])
        made = _trained(x, layers, np.random.default_rng([*seed, shard]), passes, rate)
        return pd.DataFrame({"shard": [shard], "n": [len(x)], "weights": [np.concatenate([p.ravel() for layer in made for p in layer])]})

    return train


def autoencoder(scaled: DataFrame, rounds: int = AUTO_ROUNDS, passes: int = AUTO_PASSES, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers of a network that passes each row's array ``x`` through HIDDEN rectified layers and rebuilds it.

    Rows are dealt by a hash of the id into shards of about SHARD_ROWS, which follow from the rows alone, and
    sorted, so the same seed gives the same weights. In each round every shard trains the shared weights on by itself, and
    their mean by rows is the next round's; only weights, of some thousand numbers, pass through the driver."""
    rng = np.random.default_rng(seed)
    width = len(scaled.select("x").first()[0])
    sizes = (width, *HIDDEN, width)
    layers = [(rng.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
    shards = max(1, scaled.count() // SHARD_ROWS)
    dealt = cut(scaled.select("account_id", "x", F.pmod(F.xxhash64("account_id"), F.lit(shards)).alias("shard")).repartition("shard"))
    ship(scaled.sparkSession)
    for k in range(rounds):
        rate = 0.01 * 0.5 * (1 + np.cos(np.pi * k / rounds))

        found = dealt.groupBy("shard").applyInPandas(_shard_trainer(layers, (seed, k), passes, rate), "shard long, n long, weights array<double>")
        flat = found.select("shard", "n", F.posexplode("weights").alias("place", "w")).groupBy("place")
        # Sums of decimals do not depend on the order in which tasks end.
        mean = F.sum((F.col("n") * F.col("w")).cast("decimal(38,12)")).cast("double") / F.sum("n")
        whole = flat.agg(mean.alias("w")).orderBy("place").toArrow().column("w").to_numpy()
        at, layers = 0, []
        for a, b in zip(sizes, sizes[1:]):
            layers.append((whole[at : at + a * b].reshape(a, b), whole[at + a * b : at + a * b + b]))
            at += a * b + b
    return layers


def autoencoder_errors(features: DataFrame, fitted_on: DataFrame | None = None, rounds: int = AUTO_ROUNDS, passes: int = AUTO_PASSES, seed: int = 7) -> DataFrame:
    """``account_id``, ``raw``: the mean squared error with which an autoencoder, trained on ``fitted_on`` (all accounts if
    None), rebuilds the account's standardised features. No accounts give no rows."""
    base = features if fitted_on is None else fitted_on
    if base.isEmpty():
        return features.sparkSession.createDataFrame([], "account_id string, raw double")
    as_array = lambda df: df.select("account_id", vector_to_array("scaled").alias("x"))
    layers = autoencoder(as_array(standardised(base, base)), rounds, passes, seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["x"].tolist()).reshape(len(batch), -1)
            yield pd.DataFrame({"account_id": batch["account_id"], "raw": ((x - _forward(x, layers)[-1]) ** 2).mean(1) if len(batch) else np.zeros(0)})

    return as_array(standardised(features, base)).mapInPandas(run, "account_id string, raw double")


def adjacency(edges: DataFrame, split: DataFrame) -> DataFrame:
    """``account``, ``other``, ``weight``: distinct undirected neighbours with both ends in one side of a
    split (account, test), each account's weights summing to one."""
    both = edges.select(F.col("src").alias("account"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
    side = split.select("account", "test")
    inside = both.join(side, "account").join(side.select(F.col("account").alias("other"), F.col("test").alias("test2")), "other").filter("test = test2")
    return inside.select("account", "other", (1.0 / F.count("*").over(Window.partitionBy("account"))).alias("weight"))


def with_neighbours(features: DataFrame, weights: DataFrame, names=NAMES) -> DataFrame:
    """features (account, names) with each name's weighted mean over neighbours as ``near_<name>``; 0 without."""
    other = features.select(F.col("account").alias("other"), *names)
    near = weights.join(other, "other").groupBy("account").agg(*(F.sum(F.col("weight") * F.col(n)).alias(f"near_{n}") for n in names))
    return features.join(near, "account", "left").fillna(0.0, [f"near_{n}" for n in names])
