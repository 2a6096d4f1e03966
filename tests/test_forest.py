"""The forest for large tables: splits against brute force, whole trees against a walk, errors
against Spark's own trainer."""

import numpy as np
import pytest

from wearline.operators import forest as FO
from wearline.operators import ml as ML
from wearline.schema import FEATURE_COLUMNS


@pytest.fixture(scope="module")
def rows(spark):
    """Units of ten cycles; two sensors tell the cycle roughly, the others nothing."""
    rng = np.random.default_rng(5)
    made = []
    for u in range(120):
        for c in range(1, 11):
            x = {f: float(rng.integers(0, 50)) for f in FEATURE_COLUMNS}
            x |= {"sensor_1": 7.0, "sensor_2": c + float(rng.normal()), "sensor_9": -c * c + float(rng.normal()) * 3}
            made.append(("FD001", "train", u, c, *[x[f] for f in FEATURE_COLUMNS]))
    schema = "dataset_id string, dataset_type string, unit_number int, time_cycles int, " + ", ".join(f"{f} double" for f in FEATURE_COLUMNS)
    return spark.createDataFrame(made, schema).cache()


def nodes(spark, model, path):
    found = {}
    for n in ML.forest_nodes(spark, ML.save_model(model, str(path))).collect():
        found.setdefault(n.tree, {})[n.node] = n
    return found


def test_large_tables_are_not_given_to_sparks_trainer(spark, rows, tmp_path, monkeypatch):
    """Beyond the bound the rows never reach Spark's trainer, and the model is as good: the same
    parameters, errors and importances near to those of Spark's, predictions by its nodes."""
    params = {"num_trees": 20, "max_depth": 4, "seed": 3}
    model, found = ML.train_with_holdout(rows, **params)
    monkeypatch.setattr(ML, "SPARK_WEIGHTS", 100)
    fit = FO.Pipeline.fit
    monkeypatch.setattr(FO.Pipeline, "fit", lambda self, data: fit(self, data) if data.count() == 2 else pytest.fail("all rows"))
    own, errors = ML.train_with_holdout(rows, **params)
    a, b = found.first(), errors.first()
    assert (a.training_rows, a.unseen_rows, a.mean_label_rmse) == (b.training_rows, b.unseen_rows, b.mean_label_rmse)
    assert b.rmse == pytest.approx(a.rmse, rel=0.05) and b.mae == pytest.approx(a.mae, rel=0.05) and b.rmse < 0.6 * b.mean_label_rmse
    near = np.abs(model.stages[-1].featureImportances.toArray() - own.stages[-1].featureImportances.toArray())
    assert near.max() < 0.1
    assert own.stages[-1].getNumTrees == 20 and own.stages[-1].numFeatures == 24 and own.stages[-1].getMaxDepth() == 4
    trees = nodes(spark, own, tmp_path / "m")
    assert len(trees) == 20 and all(len(t) <= 31 for t in trees.values())

    def walk(tree, values):
        n = tree[0]
        while n.left >= 0:
            n = tree[n.left if values[n.feature] <= n.threshold else n.right]
        return n.prediction

    some = rows.limit(50).collect()
    got = {(r.unit_number, r.time_cycles): r.prediction for r in ML.predict_rul(own, rows, "FD001", "train").collect()}
    for r in some:
        mean = sum(walk(t, [r[f] for f in FEATURE_COLUMNS]) for t in trees.values()) / 20
        assert got[r.unit_number, r.time_cycles] == pytest.approx(mean, abs=1e-9)


def test_forest_is_the_same_however_the_work_is_dealt(spark, rows, tmp_path, monkeypatch):
    """Blocks of rows, groups of trees and passes over nodes do not change a tree."""
    monkeypatch.setattr(ML, "SPARK_WEIGHTS", 0)
    params = {"num_trees": 5, "max_depth": 5, "seed": 8}
    whole = nodes(spark, ML.train_rul_model(rows, **params), tmp_path / "a")
    for name, value in (("BLOCK_ROWS", 300), ("GROUP_TREES", 2), ("GROUP_NODES", 3)):
        monkeypatch.setattr(FO, name, value)
    parts = nodes(spark, ML.train_rul_model(rows, **params), tmp_path / "b")

    def shape(tree, k=0):
        n = tree[k]
        return (n.prediction,) if n.left < 0 else (n.feature, n.threshold, shape(tree, n.left), shape(tree, n.right))

    assert [shape(whole[t]) for t in sorted(whole)] == [shape(parts[t]) for t in sorted(parts)]
    root = whole[0][0]
    weights = sum(FO.row_weights(8, 0, 0, 0, 1000).tolist())
    assert root.left > 0 and 850 < weights < 1150


def test_best_split_against_every_split():
    rng = np.random.default_rng(2)
    features, size, bins = 3, 4, 6
    x, at = rng.integers(0, bins, (features, 200)), rng.integers(0, size, 200)
    w, y = rng.poisson(1.0, 200), rng.integers(0, 30, 200)
    x[0] = 2  # no split
    sums = np.zeros((2, features, size, bins))
    for f in range(features):
        np.add.at(sums[0, f], (at, x[f]), w)
        np.add.at(sums[1, f], (at, x[f]), w * y)
    flat = np.concatenate([sums.ravel(), np.bincount(at, w * y * y, size)])
    got = FO.best_splits(flat, features, bins)
    for k in range(size):
        def spread(m):
            v = np.repeat(y[m], w[m])
            return ((v - v.mean()) ** 2).sum() if len(v) else 0.0
        here = at == k
        tries = [(spread(here) - spread(here & (x[f] <= c)) - spread(here & (x[f] > c)), -f, -c) for f in range(features) for c in range(bins - 1)]
        best = max(tries)
        assert got["gain"][k] * got["weight"][k] == pytest.approx(best[0])
        m = here & (x[got["feature"][k]] <= got["cut"][k])
        assert spread(here) - spread(m) - spread(here & ~m) == pytest.approx(best[0])
        assert (got["left_weight"][k], got["left_total"][k]) == (w[m].sum(), (w * y)[m].sum())


def test_bins_and_weights():
    assert FO.bin_cuts(np.array([3.0, 1.0, 1.0, 2.0]), 32).tolist() == [1.5, 2.5]
    assert FO.bin_cuts(np.array([4.0, 4.0]), 32).tolist() == []
    cuts = FO.bin_cuts(np.arange(1000.0), 32)
    assert len(cuts) == 31 and np.bincount(np.searchsorted(cuts, np.arange(1000.0))).min() >= 30
    w = FO.row_weights(1, 2, 3, 4, 200_000)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    assert (w == FO.row_weights(1, 2, 3, 4, 200_000)).all() and (w != FO.row_weights(1, 3, 3, 4, 200_000)).any()
