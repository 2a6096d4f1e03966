"""Remaining-useful-life labels, model training, scoring and the latest prediction per unit.

Training is Spark ML: a ``VectorAssembler`` and a ``RandomForestRegressor`` in one
``Pipeline``; trees are grown by distributed histogram aggregation over the partitions, so
the training set is never pulled into one process.  Large tables are trained by
``operators.forest``, which grows the same model from packed rows.  Hyper-parameters are arguments; the
defaults follow the reference's model (100 trees, seed 42, every feature considered at each
split).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.functions.series import attach_series_aggregates
from wearline.operators.common import subset
from wearline.operators.forest import fit_forest
from wearline.schema import FEATURE_COLUMNS, SERIES_KEY

LABEL = "rul"
# Share of the units held out for the error, and folds of the cross-validation.
TEST_SHARE = 0.2
FOLDS = 5
# Training rows of one task.  The forest keeps them in memory with a weight per tree (about 400
# bytes a row for 100 trees) and reads them once a pass; every task adds its own statistics of
# all nodes to the shuffle, so tasks are not made smaller than need be.
TRAINING_ROWS = 600_000
# Weights (one per row and tree) that Spark's own trainer is given: it holds all of them, with the
# rows, and reads them some 40 times.
SPARK_WEIGHTS = 50_000_000


def rul_label(readings: DataFrame, dataset_id: str | None = "FD001",
              dataset_type: str | None = "train",
              features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """``rul = last cycle of the unit - cycle`` for every reading, with the feature columns.

    The last cycle is a grouped maximum per series (partially aggregated on the map side)
    joined back on the series key, not a window that would hold a whole series in a task.
    """
    rows = subset(readings, dataset_id, dataset_type).select(
        *SERIES_KEY, "time_cycles", *features)
    df = attach_series_aggregates(rows, SERIES_KEY, F.max("time_cycles").alias("_last"))
    return df.select(*SERIES_KEY, "time_cycles", *features,
                     (F.col("_last") - F.col("time_cycles")).cast("double").alias(LABEL))


def rul_pipeline(features: Sequence[str] = FEATURE_COLUMNS, num_trees: int = 100,
                 max_depth: int = 10, seed: int = 42, feature_subset: str = "all",
                 max_bins: int = 32, max_memory_mb: int = 64) -> Pipeline:
    """Assembler + forest.  ``max_memory_mb`` bounds the split statistics each task
    aggregates per pass (more passes, but a fixed memory footprint per executor core)."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features",
                                handleInvalid="error")
    forest = RandomForestRegressor(featuresCol="features", labelCol=LABEL,
                                   predictionCol="prediction", numTrees=num_trees,
                                   maxDepth=max_depth, seed=seed, maxBins=max_bins,
                                   featureSubsetStrategy=feature_subset,
                                   maxMemoryInMB=max_memory_mb,
                                   # the trees are walked anew each pass: node ids kept per
                                   # row and tree would double what a task reads a pass
                                   cacheNodeIds=False)
    return Pipeline(stages=[assembler, forest])


def complete(features: Sequence[str]) -> Column:
    """Whether a row has a value in every feature."""
    ok = F.lit(True)
    for c in features:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return ok


def training_rows(readings: DataFrame, dataset_id: str = "FD001", dataset_type: str = "train",
                  features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Labelled rows, with ``usable`` telling those that training takes: every feature and
    the label present."""
    return rul_label(readings, dataset_id, dataset_type, features).withColumn(
        "usable", complete(features) & F.col(LABEL).isNotNull())


def training_report(readings: DataFrame, dataset_id: str = "FD001", dataset_type: str = "train",
                    features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """One row: rows that training takes, and rows it leaves out for a missing value."""
    return training_rows(readings, dataset_id, dataset_type, features).agg(
        F.count_if("usable").alias("training_rows"), F.count_if(~F.col("usable")).alias("left_out"))


def unit_share(seed: int = 42, parts: int = 1000) -> Column:
    """Number from 0 to ``parts - 1`` of the row's unit: all rows of a unit have the same."""
    return F.pmod(F.xxhash64(*SERIES_KEY, F.lit(seed)), F.lit(parts))


def dealt_rows(data: DataFrame, rows_per_task: int = TRAINING_ROWS, rows: int | None = None) -> DataFrame:
    """Training rows dealt by row key over tasks of about ``rows_per_task`` rows, at least one
    per core, each sorted by that key: what a task holds does not grow with the table, whatever
    the files' sizes.  Empty input is an error."""
    rows = data.count() if rows is None else rows
    if rows == 0:
        raise ValueError("no training rows")
    key = [*SERIES_KEY, "time_cycles"]
    tasks = max(data.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_task))
    return data.repartition(tasks, *key).sortWithinPartitions(*key)


def _fit(data: DataFrame, features: Sequence[str], params: dict) -> PipelineModel:
    """The forest of ``data``: by Spark's own trainer up to ``SPARK_WEIGHTS``, or if features are
    drawn per node; else by ``fit_forest``, by the same rules with other random weights."""
    pipeline, rows = rul_pipeline(features, **params), data.count()
    dealt = dealt_rows(data, rows=rows)
    forest = pipeline.getStages()[-1]
    if rows * forest.getNumTrees() <= SPARK_WEIGHTS or forest.getFeatureSubsetStrategy() != "all":
        return pipeline.fit(dealt)
    return fit_forest(data, dealt, rows, pipeline, features, LABEL, [*SERIES_KEY, "time_cycles"])


def train_rul_model(readings: DataFrame, dataset_id: str = "FD001",
                    dataset_type: str = "train", features: Sequence[str] = FEATURE_COLUMNS,
                    **params) -> PipelineModel:
    """Fit the forest on the labelled readings of one data set (``training_rows`` with every
    value present; ``training_report`` counts the others); empty input is an error."""
    return _fit(training_rows(readings, dataset_id, dataset_type, features).where("usable").drop("usable"), features, params)


def errors(scored: DataFrame, mean_label: float) -> DataFrame:
    """One row: scored rows and units, root mean square and mean absolute error, r2 (share of
    the labels' variance that the predictions explain), and the root mean square error of
    always giving ``mean_label``."""
    error, label = F.col("prediction") - F.col(LABEL), F.col(LABEL)
    return scored.agg(
        F.count_distinct(*SERIES_KEY).alias("units"), F.count(F.lit(1)).alias("rows"),
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.avg(error * error), F.var_pop(label))).alias("r2"),
        F.sqrt(F.avg((label - F.lit(mean_label)) * (label - F.lit(mean_label)))).alias("mean_label_rmse"))


def _trained_apart(rows: DataFrame, apart: Column, features: Sequence[str], params: dict) -> tuple[PipelineModel, DataFrame]:
    """The model of the rows that are not ``apart``, and its errors on those that are, next to
    the counts of the training rows (one row)."""
    known = rows.where(~apart)
    model = _fit(known, features, params)
    seen = known.agg(F.count_distinct(*SERIES_KEY).alias("units"), F.count(F.lit(1)).alias("rows"), F.avg(LABEL).alias("mean")).first()
    found = errors(model.transform(rows.where(apart)), seen["mean"]).select(
        F.lit(seen["units"]).alias("training_units"), F.lit(seen["rows"]).alias("training_rows"),
        F.col("units").alias("unseen_units"), F.col("rows").alias("unseen_rows"), "rmse", "mae", "r2", "mean_label_rmse")
    return model, found


def train_with_holdout(readings: DataFrame, dataset_id: str = "FD001", dataset_type: str = "train",
                       features: Sequence[str] = FEATURE_COLUMNS, test_share: float = TEST_SHARE, split_seed: int = 42,
                       **params) -> tuple[PipelineModel, DataFrame]:
    """The forest of the readings of about ``1 - test_share`` of the units, and one row of its
    errors on the other units.

    Whole units are held out (by a hash of the unit): readings of one unit are alike, and a
    model that has seen some would be judged too well on the others."""
    rows = training_rows(readings, dataset_id, dataset_type, features).where("usable").drop("usable")
    return _trained_apart(rows, unit_share(split_seed) < int(test_share * 1000), features, params)


def cross_validate(readings: DataFrame, dataset_id: str = "FD001", dataset_type: str = "train",
                   features: Sequence[str] = FEATURE_COLUMNS, folds: int = FOLDS, split_seed: int = 42, **params) -> DataFrame:
    """One row per fold of the units: errors of a model that has seen only the other folds."""
    rows = training_rows(readings, dataset_id, dataset_type, features).where("usable").drop("usable")
    out = None
    for fold in range(folds):
        _, found = _trained_apart(rows, unit_share(split_seed, folds) == fold, features, params)
        found = found.select(F.lit(fold).alias("fold"), *found.columns)
        out = found if out is None else out.unionAll(found)
    return out


def predict_rul(model: PipelineModel, readings: DataFrame, dataset_id: str = "FD001",
                dataset_type: str = "test", unit_number: int | None = None,
                features: Sequence[str] = FEATURE_COLUMNS) -> DataFrame:
    """Score readings; returns the series key, cycle, predicted RUL and ``reason``.

    Every reading gives a row.  One with a missing feature has a NULL prediction and the
    reason ``missing feature``.  Scoring is a narrow transformation (no shuffle): every task
    applies the broadcast trees."""
    rows = subset(readings, dataset_id, dataset_type)
    if unit_number is not None:
        rows = rows.where(F.col("unit_number") == unit_number)
    whole = rows.select(*SERIES_KEY, "time_cycles", complete(features).alias("_ok"),
                        *[F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)).alias(c) for c in features])
    return model.transform(whole).select(
        *SERIES_KEY, "time_cycles", F.when(F.col("_ok"), F.col("prediction")).alias("prediction"),
        F.when(~F.col("_ok"), "missing feature").alias("reason"))


def rul_latest(predictions: DataFrame) -> DataFrame:
    """Per unit: the last cycle seen, the RUL predicted there (NULL if that reading could not
    be scored) and the total predicted life (``max_by`` in a grouped aggregate: no sort of
    the series)."""
    return predictions.groupBy(*SERIES_KEY).agg(
        F.max("time_cycles").alias("current_cycle"),
        F.max_by("prediction", "time_cycles").alias("predicted_rul"),
    ).withColumn("total_predicted_life", F.col("current_cycle") + F.col("predicted_rul"))


def feature_importances(model: PipelineModel, spark, features: Sequence[str] = FEATURE_COLUMNS
                        ) -> DataFrame:
    """(feature, importance) of the fitted forest; the vector has one entry per feature,
    a fixed size independent of the data."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, imp)), "feature string, importance double")


def forest_nodes(spark, path: str) -> DataFrame:
    """The saved forest as a table of nodes: ``tree, node, feature`` (its place in the feature
    list, -1 in a leaf), ``threshold`` (left if the value is not above it), ``left``, ``right``
    and ``prediction``.  The forest predicts the mean of its trees' leaves."""
    data = spark.read.parquet(f"{path.rstrip('/')}/stages/1_*/data")
    return data.select(F.col("treeID").alias("tree"), "nodeData.*").select(
        "tree", F.col("id").alias("node"), F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"), "prediction")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """Load a saved model; a missing path raises (as scoring without a model must)."""
    return PipelineModel.load(path)
