"""Model invariants (rows-only in the driver check)."""

import pytest
from pyspark.sql import functions as F

from wearline.operators import ml as ML


def test_label_zero_at_last_cycle(readings):
    lab = ML.rul_label(readings, "FD001", "train")
    bad = lab.groupBy("unit_number").agg({"rul": "min"}).where("`min(rul)` <> 0").count()
    assert bad == 0


def test_train_predict_latest(spark, readings, tmp_path):
    model = ML.train_rul_model(readings, "FD001", "train", num_trees=5, max_depth=4, seed=42)
    path = ML.save_model(model, str(tmp_path / "m"))
    model = ML.load_model(path)
    p1 = ML.predict_rul(model, readings, "FD001", "test")
    p2 = ML.predict_rul(ML.load_model(path), readings, "FD001", "test")
    assert p1.count() == readings.where("dataset_id='FD001' AND dataset_type='test'").count()
    assert sorted(p1.collect()) == sorted(p2.collect())  # same model, same result
    lab = ML.rul_label(readings, "FD001", "train")
    lo, hi = lab.agg({"rul": "min"}).first()[0], lab.agg({"rul": "max"}).first()[0]
    pr = p1.agg({"prediction": "min"}).first()[0], p1.agg({"prediction": "max"}).first()[0]
    assert lo <= pr[0] <= pr[1] <= hi
    latest = ML.rul_latest(p1)
    assert latest.count() == p1.select("unit_number").distinct().count()


def test_empty_training_input_raises(readings):
    with pytest.raises(ValueError):
        ML.train_rul_model(readings, "FD009", "train", num_trees=2)


def test_missing_model_raises(spark, tmp_path):
    with pytest.raises(Exception):
        ML.load_model(str(tmp_path / "none"))


def test_feature_importances_cover_all_features(spark, readings):
    from wearline.schema import FEATURE_COLUMNS

    model = ML.train_rul_model(readings, "FD001", "train", num_trees=3, max_depth=3, seed=1)
    imp = ML.feature_importances(model, spark).collect()
    assert [r["feature"] for r in imp] == FEATURE_COLUMNS
    assert abs(sum(r["importance"] for r in imp) - 1.0) < 1e-9


def halves(spark, units=40):
    """Units of four cycles; one sensor tells only in which half of its life a unit is.  The best
    prediction is the half's mean label (2.5 or 0.5), half a cycle off: rmse 0.5, r2 0.8."""
    from wearline.schema import FEATURE_COLUMNS

    rows = [("FD001", "train", u, c, *[float(c <= 2) if f == "sensor_2" else 1.0 for f in FEATURE_COLUMNS])
            for u in range(units) for c in range(1, 5)]
    schema = "dataset_id string, dataset_type string, unit_number int, time_cycles int, " + ", ".join(f"{f} double" for f in FEATURE_COLUMNS)
    return spark.createDataFrame(rows, schema)


def test_errors_on_unseen_units(spark):
    model, found = ML.train_with_holdout(halves(spark), num_trees=3, max_depth=3, seed=1)
    r = found.first()
    assert r.training_units + r.unseen_units == 40 and 1 <= r.unseen_units <= 20
    assert (r.training_rows, r.unseen_rows) == (4 * r.training_units, 4 * r.unseen_units)
    assert r.rmse == pytest.approx(0.5, abs=0.1) and r.r2 == pytest.approx(0.8, abs=0.08)
    assert r.mae == pytest.approx(0.5, abs=0.1) and r.mean_label_rmse == pytest.approx(1.25 ** 0.5, abs=0.01)
    assert model.stages[-1].getNumTrees == 3


def test_folds_hold_out_each_unit_once(spark):
    rows = ML.cross_validate(halves(spark), folds=3, num_trees=2, max_depth=2, seed=1).collect()
    assert [r.fold for r in rows] == [0, 1, 2]
    assert sum(r.unseen_units for r in rows) == 40
    assert all(r.rmse == pytest.approx(0.5, abs=0.2) for r in rows)


def test_predictions_equal_a_walk_through_the_nodes(spark, readings, tmp_path):
    """Every prediction, and the latest per unit, against trees walked in plain Python."""
    from wearline.schema import FEATURE_COLUMNS

    path = ML.save_model(ML.train_rul_model(readings, "FD001", "train", num_trees=6, max_depth=6, seed=3), str(tmp_path / "m"))
    trees = {}
    for n in ML.forest_nodes(spark, path).collect():
        trees.setdefault(n.tree, {})[n.node] = n
    assert len(trees) == 6

    def walk(nodes, values):
        n = nodes[0]
        while n.left >= 0:
            n = nodes[n.left if values[n.feature] <= n.threshold else n.right]
        return n.prediction

    rows = {(r.unit_number, r.time_cycles): [r[f] for f in FEATURE_COLUMNS]
            for r in readings.where("dataset_id = 'FD001' AND dataset_type = 'test'").collect()}
    expected = {k: sum(walk(t, v) for t in trees.values()) / len(trees) for k, v in rows.items()}
    scored = ML.predict_rul(ML.load_model(path), readings, "FD001", "test")
    got = {(r.unit_number, r.time_cycles): r.prediction for r in scored.collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    for r in ML.rul_latest(scored).collect():
        last = max(c for u, c in rows if u == r.unit_number)
        assert r.current_cycle == last and abs(r.predicted_rul - expected[r.unit_number, last]) < 1e-9
        assert abs(r.total_predicted_life - last - expected[r.unit_number, last]) < 1e-9


def test_training_rows_are_dealt_in_bounded_tasks(spark, readings):
    """One file of many rows is dealt over tasks of bounded size, no row lost; the forest sees those."""
    rows = ML.training_rows(readings).where("usable").drop("usable").coalesce(1)
    n = rows.count()
    dealt = ML.dealt_rows(rows, rows_per_task=20)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and len(sizes) > n / 40 and max(sizes) < 60
    assert dealt.exceptAll(rows).count() == 0
    with pytest.raises(ValueError, match="no training rows"):
        ML.dealt_rows(rows.where("false"))


def test_prediction_query_keeps_the_label_range(spark, sf, monkeypatch):
    """Predictions, and whether each lies in the range of the training labels."""
    from wearline.plans import catalog

    monkeypatch.setattr(catalog, "MODEL", {"num_trees": 3, "max_depth": 3, "seed": 42})
    rows = catalog.QUERIES["predict_rul"](spark, sf).collect()
    top = catalog.QUERIES["rul_label"](spark, sf).agg(F.max("rul")).first()[0]
    assert rows and all(r.in_range == (0 <= r.prediction <= top) for r in rows)
    assert all(r.reason is None and r.in_range for r in rows)
