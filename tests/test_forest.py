"""Forests grown on the executors, and the surrogate of permutation importance over them."""
import numpy as np
import pytest

from tabtune.operators import forest as FR
from tabtune.operators import importance as I
from tabtune.operators import models as M


def _rows(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 20, (n, 3)).astype(float)
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.integers(0, 8, n) > 18).astype(int) + (x[:, 2] > 15)
    return x, y


@pytest.mark.parametrize("kind,depth,leaf", [("gini", 30, 1), ("entropy", 5, 3), ("variance", 4, 2)])
def test_tree_without_chance_is_spark_mls(spark, kind, depth, leaf):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    x, y = _rows()
    if kind == "variance":      # no two splits alike
        y = x @ [1.0, 0.37, -0.11] + np.random.default_rng(2).normal(size=len(x))
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.coalesce(1))
    kw = dict(labelCol="y", numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=depth, minInstancesPerNode=leaf)
    model = (RandomForestRegressor(**kw) if kind == "variance" else RandomForestClassifier(impurity=kind, **kw)).fit(df)
    cuts = [FR.thresholds(x[:, f]) for f in range(3)]
    bins = FR.binned(x, cuts)
    stats = np.stack([np.ones(len(y)), y, y * y], 1) if kind == "variance" else np.eye(3)[y]
    tree = FR.grow(bins, stats, kind, depth, leaf, 3, np.random.default_rng(0))
    assert len(tree.feature) == model.trees[0].numNodes
    got = tree.stats[FR.walk(tree, bins)]
    if kind == "variance":
        assert got[:, 1] / got[:, 0] == pytest.approx([r.prediction for r in model.transform(df).collect()])
    else:
        share = np.array([r.probability.toArray() for r in model.transform(df).collect()])
        assert got / got.sum(1, keepdims=True) == pytest.approx(share)


def test_thresholds_of_many_values_cut_equal_shares():
    cuts = FR.thresholds(np.append(np.arange(1000.0), np.nan))
    assert len(cuts) == 31
    counts = np.bincount(FR.binned(np.arange(1000.0)[:, None], [cuts])[:, 0])
    assert counts.min() >= 31 and counts.max() <= 32
    assert FR.binned(np.array([[np.nan]]), [cuts])[0, 0] == 31
    assert len(FR.thresholds(np.array([5.0, 5.0]))) == 0


def test_large_surrogate_is_grown_outside_the_driver(spark, monkeypatch):
    """Importances by hand from the same trees; Spark ML's fit, which keeps all nodes in the driver, is not run."""
    from pyspark.sql import functions as F
    from tabtune.operators.split import key_text, train_test_split
    x, y = _rows(500, 2)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))],
                               "id int, a double, b double, c double, Cluster int").repartition(3)
    feats, seen = ["a", "b", "c"], {}
    monkeypatch.setattr(I, "DRIVER_NODES", 1000)
    monkeypatch.setattr(I, "SURROGATE_TREES", 7)
    monkeypatch.setattr(I, "BLOCK_ROWS", 40)
    monkeypatch.setattr(M, "fit_forest_classifier", lambda *a, **k: pytest.fail("grown in the driver"))
    made = FR.classifier_trees

    def kept(*args):
        trees, cuts = made(*args)
        seen.update(trees=[FR.unpacked(r.asDict(), 3) for r in trees.orderBy("tree").collect()], cuts=cuts)
        return trees, cuts
    monkeypatch.setattr(FR, "classifier_trees", kept)
    got = [I.permutation_importance(d, feats, key="id", n_repeats=3).orderBy("Feature").collect()
           for d in (df, df.repartition(5))]
    assert got[0] == got[1]        # whatever the layout of the input is
    test = (train_test_split(df, "id").where("split = 'test'").withColumn("h", F.xxhash64(key_text(df, "id"), F.lit(42)))
            .orderBy("h").collect())
    base, truth = np.array([[r.a, r.b, r.c] for r in test]), np.array([r.Cluster for r in test])
    n, blocks = len(test), -(-len(test) // 40)
    block = np.array([i * blocks // n for i in range(n)])
    assert blocks > 1 and len(seen["trees"]) == 7 and len({len(t.feature) for t, _, _ in seen["trees"]}) > 1

    def accuracy(m):
        bins = FR.binned(m, seen["cuts"])
        votes = sum(shares[at[FR.walk(tree, bins)]] for tree, at, shares in seen["trees"])
        return (votes.argmax(1) == truth).mean()
    assert accuracy(base) > 0.7
    for f, name in enumerate(feats):
        drops = []
        for r in range(3):
            m = base.copy()
            for b in range(blocks):
                own = np.flatnonzero(block == b)
                m[own, f] = base[own, f][I.permutation(42, f, r, b, len(own))]
            drops.append(accuracy(base) - accuracy(m))
        assert got[0][f]["Feature"] == name
        assert got[0][f]["Importance Mean"] == pytest.approx(np.mean(drops), abs=1e-12)
        assert got[0][f]["Importance Std"] == pytest.approx(np.std(drops), abs=1e-12)
