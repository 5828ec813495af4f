"""Forest, boundary and autoencoder over all accounts, against plain versions, on any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.operators import ml
from tracewell.operators.features import NAMES


def accounts(spark, n, parts, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 4)) @ rng.normal(size=(4, len(NAMES)))
    x = np.tanh(base) * 3 + rng.normal(0, 0.05, (n, len(NAMES)))
    x[: n // 50] += rng.normal(0, 8, (n // 50, len(NAMES)))
    rows = [(f"A{i}", *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "account_id string, " + ", ".join(f"{c} double" for c in NAMES)).repartition(parts), x


def test_trees_do_not_depend_on_partitions(spark):
    one, x = accounts(spark, 700, 1)
    many, _ = accounts(spark, 700, 5)
    trees = [sorted(map(tuple, ml.isolation_trees(df, 6).collect())) for df in (one, many)]
    assert trees[0] == trees[1]
    by = {}
    for tree, node, feature, at, low, high, rows in trees[0]:
        by.setdefault(tree, {})[node] = (feature, at, low, high, rows)
    assert len(by) == 6 and all(t[0][4] == ml.TREE_ROWS for t in by.values())

    def depth(tree, row):
        node, level = 0, 0
        while tree[node][0] >= 0:
            feature, at, low, high, _ = tree[node]
            node, level = (low if row[feature] < at else high), level + 1
        return level + ml._mean_depth(tree[node][4])

    want = {f"A{i}": 2 ** (-np.mean([depth(t, x[i]) for t in by.values()]) / ml._mean_depth(ml.TREE_ROWS)) for i in range(700)}
    got = {r.account_id: r.raw for r in ml.isolation_scores(many, 6).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    odd = np.mean([got[f"A{i}"] for i in range(14)])
    assert odd > np.mean(list(got.values())) + 0.05


def test_forest_of_few_accounts(spark):
    few, _ = accounts(spark, 3, 2)
    assert ml.isolation_scores(few, 4).count() == 3
    assert ml.isolation_scores(few.limit(0), 4).count() == 0


def test_boundary_leaves_its_share_outside(spark):
    df, x = accounts(spark, 1500, 4)
    got = {r.account_id: r.raw for r in ml.one_class_scores(df, nu=0.08, waves=64).collect()}
    assert abs(np.mean([v > 0 for v in got.values()]) - 0.08) <= 0.01
    odd = np.mean([got[f"A{i}"] for i in range(30)])
    assert odd > np.quantile(list(got.values()), 0.8)
    assert ml.one_class_scores(df.limit(0)).count() == 0


def test_autoencoder_beats_the_projection(spark):
    df, _ = accounts(spark, 900, 3)
    held = F.pmod(F.xxhash64("account_id"), F.lit(4)) == 0
    fit, rest = df.filter(~held), df.filter(held)
    error = lambda rows: rows.agg(F.percentile_approx("raw", 0.5)).first()[0]  # noqa: E731  (odd accounts are no one's to rebuild)
    scaled = ml.standardised(rest, fit)
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    pc = PCA(k=6, inputCol="scaled", outputCol="part").fit(ml.standardised(fit, fit)).pc.toArray()
    x = np.array([r.x for r in scaled.select(vector_to_array("scaled").alias("x")).collect()])
    linear = np.median(((x - x @ pc @ pc.T) ** 2).mean(1))
    assert error(ml.autoencoder_errors(rest, fit)) < linear


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_weights_follow_from_the_seed(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(ml, "SHARD_ROWS", shard_rows)
    one, many = (accounts(spark, 120, parts)[0] for parts in (1, 4))
    errors = [sorted((r.account_id, r.raw) for r in ml.autoencoder_errors(df, rounds=2, passes=2).collect()) for df in (one, many)]
    assert [a for a, _ in errors[0]] == [a for a, _ in errors[1]]
    assert max(abs(a - b) for (_, a), (_, b) in zip(*errors)) < 1e-6
    assert ml.autoencoder_errors(one.limit(0)).count() == 0


def test_back_propagation_is_the_gradient():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(8, 5))
    layers = [(rng.normal(size=(5, 4)), rng.normal(size=4)), (rng.normal(size=(4, 5)), rng.normal(size=5))]
    loss = lambda ls: ((ml._forward(x, ls)[-1] - x) ** 2).mean()
    before = loss(layers)
    # The first of Adam's steps is as long as its rate in each weight, against the sign of the gradient.
    rate, step = 1e-6, 1e-5
    made = ml._trained(x, layers, np.random.default_rng(0), 1, rate)
    for (old, bias), (new, _) in zip(layers, made):
        for at in np.ndindex(*old.shape):
            kept = old[at]
            old[at] = kept + step
            high = loss(layers)
            old[at] = kept - step
            slope = (high - loss(layers)) / (2 * step)
            old[at] = kept
            assert abs(slope) < 1e-6 or np.sign(old[at] - new[at]) == np.sign(slope)
    assert loss(ml._trained(x, layers, np.random.default_rng(0), 400, 0.01)) < before / 4
