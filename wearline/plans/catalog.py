"""The query catalogue: every operator bound to the tables of one scale-factor folder.

``QUERIES[name](spark, sf_dir) -> DataFrame``.  Comparison settings follow the fixture
rules: aggregates rounded to 4 decimals, row-level values unrounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.functions.joins import attach_one_row
from wearline.operators import pipelines as P
from wearline.operators import jobs as J
from wearline.operators import ml as ML
from wearline.operators import reads as RD
from wearline.operators import warehouse as W
from wearline.plans import tables
from wearline.schema import READING_COLUMNS, SERIES_KEY, dataset_dim
from wearline.session import join_path, own_splits, path_exists, publish, remove_path
from wearline.sources import files as FS
from wearline.sources import ingest as IN
from wearline.sources import text as TX

DIGITS = 4

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def R(spark: SparkSession, sf: str) -> DataFrame:
    return tables.readings(spark, sf)


# ----------------------------------------------------------------------------- warehouse
@query("q01_filter")
def _q01(spark, sf):
    return W.q01_filter(R(spark, sf))


@query("q02_group_by_unit")
def _q02(spark, sf):
    return W.q02_group_by_unit(R(spark, sf))


@query("q03_avg_sensors")
def _q03(spark, sf):
    return W.q03_avg_sensors(R(spark, sf), digits=DIGITS)


@query("q04_variability")
def _q04(spark, sf):
    return W.q04_variability(R(spark, sf), digits=DIGITS)


@query("q05_lifecycle_stage")
def _q05(spark, sf):
    return W.q05_lifecycle_stage(R(spark, sf), digits=DIGITS)


@query("q06_operating_conditions")
def _q06(spark, sf):
    return W.q06_operating_conditions(R(spark, sf), digits=DIGITS)


@query("q07_similar_profiles")
def _q07(spark, sf):
    return W.q07_similar_profiles(R(spark, sf), digits=DIGITS)


@query("q08_correlation")
def _q08(spark, sf):
    return W.q08_correlation(R(spark, sf), digits=DIGITS)


@query("q09_anomalies")
def _q09(spark, sf):
    return W.q09_anomalies(R(spark, sf), digits=DIGITS)


@query("q10_rul_stats")
def _q10(spark, sf):
    return W.q10_rul_stats(tables.rul(spark, sf), digits=DIGITS)


@query("q11_cycle_windows")
def _q11(spark, sf):
    return W.q11_cycle_windows(R(spark, sf), digits=DIGITS)


@query("q12_drift")
def _q12(spark, sf):
    return W.q12_drift(R(spark, sf))


@query("q13_threshold_alert")
def _q13(spark, sf):
    return W.q13_threshold_alert(R(spark, sf), digits=DIGITS)


@query("q13_threshold_alert_mid")
def _q13m(spark, sf):
    return W.q13_threshold_alert(R(spark, sf), temp_quantile=0.55, pressure_quantile=0.45,
                                 digits=DIGITS)


@query("q14_dataset_comparison")
def _q14(spark, sf):
    return W.q14_dataset_comparison(R(spark, sf), digits=DIGITS)


@query("q15_efficiency")
def _q15(spark, sf):
    return W.q15_efficiency(R(spark, sf), digits=DIGITS)


@query("q16_sensor_criticality")
def _q16(spark, sf):
    return W.q16_sensor_criticality(R(spark, sf), digits=DIGITS)


@query("q16_sensor_criticality_union")
def _q16u(spark, sf):
    return W.q16_sensor_criticality_union(R(spark, sf), digits=DIGITS)


@query("q17_train_test_join")
def _q17(spark, sf):
    return W.q17_train_test_join(R(spark, sf), digits=DIGITS)


@query("q18_ml_features")
def _q18(spark, sf):
    return W.q18_ml_features(R(spark, sf))


@query("q19_dashboard")
def _q19(spark, sf):
    return W.q19_dashboard(R(spark, sf), digits=DIGITS)


@query("q19_dashboard_train")
def _q19t(spark, sf):
    return W.q19_dashboard(R(spark, sf), dataset_type="train",
                           digits=DIGITS)


@query("q20_report")
def _q20(spark, sf):
    return W.q20_report(R(spark, sf), digits=DIGITS)


# ----------------------------------------------------------------------------- pipelines
@query("fleet_summary")
def _fleet(spark, sf):
    return P.fleet_summary(R(spark, sf), dataset_dim(spark))


@query("avg_sensors_per_unit")
def _avgs(spark, sf):
    return P.avg_sensors_per_unit(R(spark, sf), digits=DIGITS)


@query("unit_health_scores")
def _health(spark, sf):
    return P.unit_health_scores(R(spark, sf), digits=DIGITS)


@query("health_top20")
def _health20(spark, sf):
    return P.health_top20(R(spark, sf), digits=DIGITS)


@query("sensor_statistics")
def _sstats(spark, sf):
    return P.sensor_statistics(R(spark, sf), digits=DIGITS)


@query("sensor_stats_table")
def _sstable(spark, sf):
    return P.sensor_stats_table(R(spark, sf))


@query("degradation_trend")
def _trend(spark, sf):
    return P.degradation_trend(R(spark, sf), digits=DIGITS)


@query("fleet_size_at_start")
def _start(spark, sf):
    return P.fleet_size_at_start(R(spark, sf))


@query("failure_features")
def _ff(spark, sf):
    return P.failure_features(R(spark, sf), digits=DIGITS)


@query("condition_metrics")
def _cond(spark, sf):
    return P.condition_metrics(R(spark, sf), digits=DIGITS)


@query("condition_metrics_top15")
def _cond15(spark, sf):
    return P.condition_metrics_top15(R(spark, sf), dataset_dim(spark), digits=DIGITS)


@query("unit_profile")
def _profile(spark, sf):
    return P.unit_profile(R(spark, sf))


@query("avg_sensor_corr_matrix")
def _corrm(spark, sf):
    per_unit = P.avg_sensors_per_unit(R(spark, sf), ordered=False)
    return P.avg_sensor_corr_matrix(per_unit, digits=DIGITS)


# ----------------------------------------------------------------------------- jobs
def _lines(spark, sf, style="mixed"):
    return tables.lines(spark, sf, style)


@query("line_count")
def _lc(spark, sf):
    return J.line_count(_lines(spark, sf))


@query("op_count")
def _opc(spark, sf):
    return J.op_count(_lines(spark, sf))


@query("cycle_counter")
def _cc(spark, sf):
    return J.cycle_counter(_lines(spark, sf))


@query("lifetime_distribution")
def _ld(spark, sf):
    return J.lifetime_distribution(J.cycle_counter(_lines(spark, sf)),
                                   digits=DIGITS)


@query("lifetime_histogram")
def _lh(spark, sf):
    return J.lifetime_histogram(J.cycle_counter(_lines(spark, sf)), bins=4)


@query("sensor11_stats")
def _s11(spark, sf):
    return J.sensor11_stats(_lines(spark, sf), digits=DIGITS)


@query("feature_summary")
def _fs(spark, sf):
    return J.feature_summary(_lines(spark, sf, "comma"), digits=DIGITS)


@query("avg_sensor4_by_setting")
def _s4(spark, sf):
    return J.avg_sensor4_by_setting(_lines(spark, sf), digits=DIGITS)


@query("degradation_metrics")
def _dm(spark, sf):
    return J.degradation_metrics(_lines(spark, sf, "comma"))


@query("degradation_json")
def _dj(spark, sf):
    """The degradation job's output text, its nested values read back from the JSON."""
    text = J.degradation_json(J.degradation_metrics(_lines(spark, sf, "comma")))
    paths = {"total_cycles": ("$.total_cycles", "int"), "health_index": ("$.health_index", "double"),
             "temp_hpc_pct_change": ("$.degradation.temp_hpc_pct_change", "double")}
    return text.select("dataset_id", "dataset_type", "unit_number", *[
        F.get_json_object("value", path).cast(kind).alias(c) for c, (path, kind) in paths.items()])


@query("job_result_filter")
def _jrf(spark, sf):
    """Result lines of two jobs over the same text, of which one has the fields wanted."""
    stats = J.job_output_text(J.sensor11_stats(_lines(spark, sf), digits=DIGITS),
                              ["key", "dataset_id", "dataset_type"], ["min", "max", "avg", "count"])
    summary = J.job_output_text(J.feature_summary(_lines(spark, sf), features=["sensor_11"], digits=DIGITS, dual=True),
                                ["feature", "dataset_id", "dataset_type"],
                                ["count", "min", "max", "mean", "std", "variance", "range"])
    return J.job_result_filter(stats.unionByName(summary), k=15)


# ----------------------------------------------------------------------------- reads, changes
@query("get_dataset")
def _getds(spark, sf):
    return RD.get_dataset(R(spark, sf), "FD001")


@query("sample_rows")
def _sample(spark, sf):
    return RD.sample_rows(R(spark, sf), "FD001", "train", limit=5)


@query("unit_series")
def _series(spark, sf):
    return RD.unit_series(R(spark, sf), None, "FD001", "train")


@query("unit_series_one")
def _series1(spark, sf):
    return RD.unit_series(R(spark, sf), 1, "FD001", "train")


@query("get_dataset_limit")
def _getds_limit(spark, sf):
    return RD.get_dataset(R(spark, sf), "FD001", "test", limit=25)


@query("training_scan")
def _tscan(spark, sf):
    return RD.training_scan(R(spark, sf), "FD001", "train")


def _last_cycle_fix(readings: DataFrame) -> DataFrame:
    """Updates derived from the data: the last reading of every series gets the series'
    highest sensor_11 value."""
    per = readings.groupBy(*SERIES_KEY).agg(
        F.max("time_cycles").alias("time_cycles"), F.max("sensor_11").alias("sensor_11"))
    return per.select("dataset_id", "dataset_type", "unit_number", "time_cycles", "sensor_11")


@query("update_readings")
def _upd(spark, sf):
    r = R(spark, sf)
    return RD.apply_updates(r, _last_cycle_fix(r))


@query("update_report")
def _updrep(spark, sf):
    r = R(spark, sf)
    return RD.update_report(r, _last_cycle_fix(r))


@query("update_sensor_data")
def _upd1(spark, sf):
    return RD.update_sensor_data(R(spark, sf), "FD001", 1, 1, {"sensor_11": 0.0})


@query("delete_dataset")
def _del(spark, sf):
    return RD.delete_dataset(R(spark, sf), "FD002", "test")


@query("deleted_count")
def _delc(spark, sf):
    return RD.deleted_count(R(spark, sf), "FD002", "test")


# ----------------------------------------------------------------------------- sources, sinks
@query("parse_readings")
def _parse(spark, sf):
    parsed = TX.parse_readings(tables.lines(spark, sf, "blank"))
    return parsed.select(*READING_COLUMNS, "parse_ok")


@query("parse_rul")
def _prul(spark, sf):
    return TX.parse_rul(tables.rul_text(spark, sf))


def _raw_files(spark, sf) -> list[str]:
    tables.lines(spark, sf, "blank")
    tables.rul_text(spark, sf)
    return [tables.lines_path(spark, sf, "blank", plain=False), tables.rul_lines_path(spark, sf)]


@query("ingest_report")
def _irep(spark, sf):
    paths = _raw_files(spark, sf)
    parsed = TX.parse_readings(tables.lines(spark, sf, "blank"))
    labels = TX.parse_rul(tables.rul_text(spark, sf)).select(
        "dataset_id", "dataset_type", F.lit(True).alias("parse_ok"))
    return IN.ingest_report(IN.deliveries(spark, paths), IN.report_counts(
        parsed.unionByName(labels, allowMissingColumns=True)))


@contextmanager
def own_folder(spark, sf, name: str):
    """A folder for one call, removed when the call is done."""
    path = tables.scratch(spark, sf, f"{name}/{uuid.uuid4().hex}")
    try:
        yield path
    finally:
        remove_path(spark, path)


@query("ingest_files")
def _ingest(spark, sf):
    """The raw files (readings and labels) ingested in one go into a fresh folder."""
    with own_folder(spark, sf, "ingest") as out:
        return IN.ingest_files(spark, _raw_files(spark, sf), f"{out}/readings", f"{out}/labels",
                               report_path=tables.scratch(spark, sf, "ingest-reports"))


@query("ingest_deliveries")
def _deliveries(spark, sf):
    """Two deliveries of one file (the first with every other unit only) and a file of
    another name: the newest one is loaded; rows and bad rows by status, next to the rows
    stored."""
    lines = tables.lines(spark, sf, "blank").where(F.col("source").contains("train_FD001.txt")).select("value")
    half = F.pmod(F.regexp_extract("value", "^([0-9]+)", 1).cast("int"), F.lit(2)) == 0
    with own_folder(spark, sf, "deliveries") as out:
        with own_splits(spark):  # a part of a delivery holds lines that lie together
            lines.where(half).write.option("compression", "gzip").text(f"{out}/raw/first/train_FD001.txt")
            lines.limit(3).write.text(f"{out}/raw/first/train_FD001.txt.bak")
            lines.write.option("compression", "gzip").text(f"{out}/raw/second/train_FD001.txt")
        report = IN.ingest_files(spark, f"{out}/raw", f"{out}/readings", f"{out}/labels",
                                 report_path=f"{out}/reports")
        stored = spark.read.parquet(f"{out}/readings").count()
        return IN.kept_rows(report.groupBy("dataset_id", "dataset_type", "status").agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("bad_rows"), F.lit(0)).alias("bad_rows"))
            .withColumn("stored_rows", F.lit(stored).cast("long")))


@query("csv_round_trip")
def _csv(spark, sf):
    """Written each time (over the files of the call before), read back."""
    path = tables.scratch(spark, sf, "csv-round-trip")
    with tables.BUILD_LOCK:
        TX.csv_write(R(spark, sf), path)
    return TX.csv_read(spark, path).select(*READING_COLUMNS)


@query("replace_ingest")
def _repl(spark, sf):
    with own_folder(spark, sf, "replace-ingest") as path, own_splits(spark):
        r = R(spark, sf)
        ranged = IN.in_unit_ranges(r)  # rows that lie in ranges are sorted where they are
        IN.data_layout(r, path, ranged=ranged)
        part = r.where((F.col("dataset_id") == "FD001") & (F.col("dataset_type") == "train"))
        IN.replace_ingest(part, path, ranged=ranged)  # first load of the same partition (the write is eager)
        IN.replace_ingest(part, path, ranged=ranged)  # reloading must not duplicate
        return IN.kept_rows(spark.read.parquet(path).groupBy("dataset_id", "dataset_type")
                            .agg(F.count(F.lit(1)).alias("row_count")))


@query("update_stored")
def _upd_stored(spark, sf):
    """One reading changed in the stored table, read back: rows and sum per data set."""
    with own_folder(spark, sf, "update-stored") as path:
        r = R(spark, sf)
        with own_splits(spark):
            IN.data_layout(r, path, ranged=IN.in_unit_ranges(r))
        stored = spark.read.parquet(path)
        RD.write_changes(RD.update_sensor_data(stored, "FD001", 1, 1, {"sensor_11": 0.0}, "train"), path, "FD001", "train")
        back = spark.read.parquet(path)
        return IN.kept_rows(back.groupBy("dataset_id", "dataset_type").agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("sensor_11") == 0).alias("zeros")))


@query("delete_stored")
def _del_stored(spark, sf):
    """A data set deleted from the stored table, read back; with the number of rows removed."""
    with own_folder(spark, sf, "delete-stored") as path:
        r = R(spark, sf)
        with own_splits(spark):
            IN.data_layout(r, path, ranged=IN.in_unit_ranges(r))
        gone = IN.delete_partitions(spark, path, "FD002", "test")
        return IN.kept_rows(spark.read.parquet(path).groupBy("dataset_id", "dataset_type").agg(
            F.count(F.lit(1)).alias("row_count")).withColumn("deleted_rows", F.lit(gone).cast("long")))


@query("table_views")
def _views(spark, sf):
    IN.table_views(spark, R(spark, sf), tables.rul(spark, sf))
    return IN.view_counts(spark, ["cmapss_train", "cmapss_test", "cmapss_rul"])


CUSTOM_SQL = """
SELECT t.dataset_id, COUNT(*) AS row_count, MAX(t.time_cycles) AS max_cycle,
       ROUND(AVG(t.sensor_11), 4) AS avg_sensor_11
FROM cmapss_train t
WHERE t.op_setting_3 <= 4 OR t.sensor_2 > 230
GROUP BY t.dataset_id
HAVING COUNT(*) > 0
ORDER BY t.dataset_id"""


@query("custom_sql")
def _csql(spark, sf):
    IN.table_views(spark, R(spark, sf), tables.rul(spark, sf))
    return W.custom_sql(spark, CUSTOM_SQL)


@query("dataset_dim")
def _ddim(spark, sf):
    """The metadata rows of the data sets present in the readings (semi join)."""
    present = R(spark, sf).select("dataset_id").distinct()
    return dataset_dim(spark).join(present, "dataset_id", "left_semi")


@query("dataset_overview")
def _dov(spark, sf):
    return P.dataset_overview(R(spark, sf), dataset_dim(spark))


def _raw_roots(spark, sf) -> list[str]:
    tables.lines(spark, sf, "mixed", plain=True)
    tables.rul_text(spark, sf)
    return [tables.lines_path(spark, sf, "mixed"), tables.rul_lines_path(spark, sf)]


@query("file_inventory")
def _finv(spark, sf):
    """Every raw file (train, test, labels) with size and date, rolled up by area and in total."""
    return FS.file_inventory(FS.raw_files(FS.list_files(spark, _raw_roots(spark, sf), "*.txt")))


@query("storage_summary")
def _ssum(spark, sf):
    """Files and bytes of all raw text (train, test, labels) by area and in total."""
    return FS.storage_summary(FS.raw_files(FS.list_files(spark, _raw_roots(spark, sf), "*.txt")))


# ----------------------------------------------------------------------------- model
@query("rul_label")
def _rlab(spark, sf):
    return ML.rul_label(R(spark, sf), "FD001", "train")


MODEL = {"num_trees": 100, "max_depth": 10, "seed": 42}


def _model_folder(spark, sf) -> str:
    """The FD001 model and its own predictions of the training rows, made once per table
    folder and set of parameters, and published complete."""
    key = "-".join(str(MODEL[k]) for k in sorted(MODEL))
    path = tables.scratch(spark, sf, f"models/FD001-{key}")
    with tables.BUILD_LOCK:
        if not path_exists(spark, path):
            made = f"{path}-{uuid.uuid4().hex[:12]}"
            model = ML.train_rul_model(R(spark, sf), "FD001", "train", **MODEL)
            ML.save_model(model, join_path(made, "model"))
            ML.predict_rul(model, R(spark, sf), "FD001", "train").write.parquet(join_path(made, "fresh"))
            publish(spark, made, path)
    return path


def _model(spark, sf):
    return ML.load_model(join_path(_model_folder(spark, sf), "model"))


@query("train_rul_model")
def _train(spark, sf):
    """Trained on four fifths of the units each time; counts, and errors on the other units."""
    model, found = ML.train_with_holdout(R(spark, sf), "FD001", "train", **MODEL)
    forest = model.stages[-1]
    return found.select(F.lit(forest.getNumTrees).alias("trees"), F.lit(forest.numFeatures).alias("features"), *found.columns)


@query("model_folds")
def _folds(spark, sf):
    """Cross-validation by units, with a small forest."""
    return ML.cross_validate(R(spark, sf), "FD001", "train", num_trees=10, max_depth=5, seed=42)


@query("training_report")
def _treport(spark, sf):
    return ML.training_report(R(spark, sf), "FD001", "train")


@query("model_io")
def _mio(spark, sf):
    """The saved model loaded back against the predictions of the fresh one, row by row."""
    fresh = spark.read.parquet(join_path(_model_folder(spark, sf), "fresh")).withColumnRenamed("prediction", "fresh")
    loaded = ML.predict_rul(_model(spark, sf), R(spark, sf), "FD001", "train")
    key = [*SERIES_KEY, "time_cycles"]
    return loaded.select(*key, "prediction").join(fresh.select(*key, "fresh"), key).select(
        *key, (F.abs(F.col("prediction") - F.col("fresh")) < 1e-9).alias("agree"))


@query("predict_rul")
def _pred(spark, sf):
    """Every test reading with its prediction, and whether that lies in the range of the labels."""
    labels = ML.rul_label(R(spark, sf), "FD001", "train").agg(F.min("rul").alias("lo"), F.max("rul").alias("hi"))
    scored = ML.predict_rul(_model(spark, sf), R(spark, sf), "FD001", "test")
    return attach_one_row(scored, labels).select(
        *scored.columns, F.col("prediction").between(F.col("lo"), F.col("hi")).alias("in_range"))


@query("rul_latest")
def _latest(spark, sf):
    return ML.rul_latest(ML.predict_rul(_model(spark, sf), R(spark, sf), "FD001", "test"))


# ----------------------------------------------------------------------------- more sources
@query("parse_lines_dual")
def _pld(spark, sf):
    """Lines kept by the tolerant job parser (>= 2 fields) by file and field count."""
    p = TX.parse_lines_dual(tables.lines(spark, sf, "mixed"), 2)
    ds, ty = TX.file_metadata(F.col("source"))
    return (p.select(ds.alias("dataset_id"), ty.alias("dataset_type"), "n_fields")
            .groupBy("dataset_id", "dataset_type", "n_fields")
            .agg(F.count(F.lit(1)).alias("lines")))


@query("parse_quality")
def _pq(spark, sf):
    return TX.parse_quality(tables.lines(spark, sf, "mixed"))


@query("file_metadata")
def _fmeta(spark, sf):
    """Data set and type of every stored raw file, from its name alone."""
    src = tables.lines(spark, sf, "blank").unionByName(tables.rul_text(spark, sf))
    ds, ty = TX.file_metadata(F.col("source"))
    name = F.regexp_extract(F.col("source"), TX.FILE_NAME_PATTERN, 1)
    return (src.select(name.alias("file_name"), ds.alias("dataset_id"),
                       ty.alias("dataset_type")).distinct())


@query("data_layout")
def _layout(spark, sf):
    """The stored layout read back: rows, units and cycle range per table partition."""
    return (spark.read.parquet(tables.build_readings(spark, sf))
            .groupBy("dataset_id", "dataset_type")
            .agg(F.count(F.lit(1)).alias("row_count"),
                 F.count_distinct("unit_number").alias("units"),
                 F.min("time_cycles").alias("min_cycle"), F.max("time_cycles").alias("max_cycle")))


@query("degradation_metrics_literal")
def _dml(spark, sf):
    from wearline.schema import DEGRADATION_SENSORS_LITERAL

    return J.degradation_metrics(_lines(spark, sf, "comma"), sensors=DEGRADATION_SENSORS_LITERAL)
