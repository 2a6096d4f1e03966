"""The twenty warehouse queries, as DataFrame operators.

Each function takes the readings table (all data sets and types), applies its own
data-set filter, and returns a lazy DataFrame.  Top-k queries always end in a total order
(aggregate, then the unit as tie-break), so ``limit`` is deterministic.  ``digits`` rounds
aggregate columns for display or comparison; ``None`` keeps full precision.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.functions.distinct import distinct_numbers
from wearline.functions.joins import attach_one_row
from wearline.functions.safe import (coef_variation, cycle_bucket, half_up, lifecycle_stage,
                                     safe_corr, safe_ratio)
from wearline.functions.quantiles import attach_groups, exact_quantiles
from wearline.functions.series import attach_series_aggregates, first_by
from wearline.operators.common import finish, subset



def q01_filter(readings: DataFrame, dataset_id: str = "FD001", dataset_type: str = "train",
               limit: int | None = None) -> DataFrame:
    """All columns of one data set; a preview of ``limit`` rows is taken in (unit, cycle)
    order, the whole is not sorted."""
    return finish(subset(readings, dataset_id, dataset_type),
                  ["unit_number", "time_cycles"] if limit is not None else None, limit)


def q02_group_by_unit(readings: DataFrame, dataset_id: str = "FD001", k: int | None = 20,
                      dataset_type: str = "train") -> DataFrame:
    """Rows and last cycle per unit, the k longest-lived units."""
    df = subset(readings, dataset_id, dataset_type).groupBy("unit_number").agg(
        F.count(F.lit(1)).alias("cycle_count"), F.max("time_cycles").alias("max_cycle"))
    return finish(df, [F.desc("max_cycle"), "unit_number"], k)


def q03_avg_sensors(readings: DataFrame, dataset_id: str = "FD001", k: int | None = 50,
                    dataset_type: str = "train", digits: int | None = None) -> DataFrame:
    df = subset(readings, dataset_id, dataset_type).groupBy("unit_number").agg(
        F.avg("sensor_2").alias("avg_temp_lpc"),
        F.avg("sensor_3").alias("avg_temp_hpc"),
        F.avg("sensor_11").alias("avg_pressure_hpc"),
        F.avg("sensor_12").alias("avg_fuel_ratio"),
        F.max("time_cycles").alias("total_cycles"))
    return finish(df, [F.desc("total_cycles"), "unit_number"], k, digits,
                  ["avg_temp_lpc", "avg_temp_hpc", "avg_pressure_hpc", "avg_fuel_ratio"])


def q04_variability(readings: DataFrame, dataset_id: str = "FD001", k: int | None = 10,
                    dataset_type: str = "train", digits: int | None = None) -> DataFrame:
    """Units with the most variable pressure (population std > 0)."""
    df = (subset(readings, dataset_id, dataset_type).groupBy("unit_number").agg(
        F.stddev_pop("sensor_11").alias("std_pressure"),
        F.stddev_pop("sensor_8").alias("std_fan_speed"),
        F.stddev_pop("sensor_9").alias("std_core_speed"),
        F.max("time_cycles").alias("lifecycle"))
        .where(F.col("std_pressure") > 0))
    return finish(df, [F.desc("std_pressure"), "unit_number"], k, digits,
                  ["std_pressure", "std_fan_speed", "std_core_speed"])


def q05_lifecycle_stage(readings: DataFrame, dataset_id: str = "FD001",
                        dataset_type: str = "train", early: int = 50, mid: int = 100,
                        digits: int | None = None) -> DataFrame:
    df = (subset(readings, dataset_id, dataset_type)
          .groupBy(lifecycle_stage("time_cycles", early, mid).alias("lifecycle_stage"))
          .agg(F.avg("sensor_3").alias("avg_hpc_temp"),
               F.avg("sensor_11").alias("avg_hpc_pressure"),
               F.avg("sensor_14").alias("avg_core_speed"),
               F.count(F.lit(1)).alias("observation_count")))
    return finish(df, ["lifecycle_stage"], None, digits,
                  ["avg_hpc_temp", "avg_hpc_pressure", "avg_core_speed"])


def q06_operating_conditions(readings: DataFrame, dataset_id: str = "FD002",
                             k: int | None = 20, dataset_type: str = "train",
                             digits: int | None = None) -> DataFrame:
    """Groups of rounded altitude and Mach (warehouse ROUND: half up)."""
    df = (subset(readings, dataset_id, dataset_type)
          .groupBy(half_up("op_setting_1", 0).alias("altitude_group"),
                   half_up("op_setting_2", 1).alias("mach_group"))
          .agg(F.count_distinct("unit_number").alias("engine_count"),
               F.avg("sensor_11").alias("avg_pressure"),
               F.avg("sensor_12").alias("avg_fuel_ratio")))
    return finish(df, [F.desc("engine_count"), "altitude_group", "mach_group"], k, digits,
                  ["avg_pressure", "avg_fuel_ratio"])


def q07_similar_profiles(readings: DataFrame, dataset_id: str = "FD002", k: int | None = 30,
                         low: float = 0.0, high: float = 10.0, dataset_type: str = "train",
                         digits: int | None = None) -> DataFrame:
    df = (subset(readings, dataset_id, dataset_type).groupBy("unit_number").agg(
        F.avg("op_setting_1").alias("avg_altitude"),
        F.avg("op_setting_2").alias("avg_mach"),
        F.avg("op_setting_3").alias("avg_tra"),
        F.max("time_cycles").alias("lifecycle"))
        .where(F.col("avg_altitude").between(low, high)))
    return finish(df, ["avg_altitude", "avg_mach", "unit_number"], k, digits,
                  ["avg_altitude", "avg_mach", "avg_tra"])


def q08_correlation(readings: DataFrame, dataset_type: str = "train",
                    digits: int | None = None) -> DataFrame:
    """Pearson correlations per data set; NULL where a sensor is constant."""
    df = subset(readings, None, dataset_type).groupBy("dataset_id").agg(
        safe_corr("sensor_8", "sensor_9").alias("fan_core_speed_corr"),
        safe_corr("sensor_2", "sensor_3").alias("lpc_hpc_temp_corr"),
        safe_corr("sensor_11", "sensor_12").alias("pressure_fuel_corr"))
    return finish(df, ["dataset_id"], None, digits,
                  ["fan_core_speed_corr", "lpc_hpc_temp_corr", "pressure_fuel_corr"])


def q09_anomalies(readings: DataFrame, dataset_id: str = "FD001", k: int | None = 50,
                  n_std: float = 2.0, sensor: str = "sensor_11", dataset_type: str = "train",
                  digits: int | None = None) -> DataFrame:
    """Readings more than ``n_std`` population deviations from the data-set mean.

    The statistics are a one-row aggregate attached as a scalar subquery (computed once,
    no join), never collected to the driver.
    """
    rows = subset(readings, dataset_id, dataset_type)
    stats = rows.agg(F.avg(sensor).alias("mean_pressure"),
                     F.stddev_pop(sensor).alias("std_pressure"))
    dev = F.abs(F.col(sensor) - F.col("mean_pressure"))
    df = (attach_one_row(rows.select("unit_number", "time_cycles", sensor), stats)
          .where(dev > F.col("std_pressure") * n_std)
          .select("unit_number", "time_cycles", sensor, "mean_pressure",
                  safe_ratio(dev, F.col("std_pressure")).alias("z_score")))
    return finish(df, [F.desc("z_score"), "unit_number", "time_cycles"], k, digits,
                  ["mean_pressure", "z_score"])


def q10_rul_stats(rul: DataFrame, digits: int | None = None) -> DataFrame:
    """Label statistics per data set; the median is exact (``functions.quantiles``)."""
    df = rul.groupBy("dataset_id").agg(
        F.count(F.lit(1)).alias("engine_count"),
        F.avg("rul").alias("avg_rul"),
        F.min("rul").alias("min_rul"),
        F.max("rul").alias("max_rul"),
        F.stddev_pop("rul").alias("std_rul"))
    median = exact_quantiles(rul, ["dataset_id"], {"median_rul": ("rul", 0.5)})
    df = attach_groups(df, median, ["dataset_id"]).select(
        "dataset_id", "engine_count", "avg_rul", "min_rul", "max_rul", "median_rul", "std_rul")
    return finish(df, ["dataset_id"], None, digits, ["avg_rul", "std_rul"])


def q11_cycle_windows(readings: DataFrame, dataset_id: str = "FD001", width: int = 25,
                      max_unit: int | None = None, dataset_type: str = "train",
                      digits: int | None = None) -> DataFrame:
    """Integer tumbling windows of ``width`` cycles (``max_unit`` restricts to units <= n)."""
    rows = subset(readings, dataset_id, dataset_type)
    if max_unit is not None:
        rows = rows.where(F.col("unit_number") <= max_unit)
    df = rows.groupBy(cycle_bucket("time_cycles", width).alias("cycle_window")).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.avg("sensor_3").alias("avg_hpc_temp"),
        F.avg("sensor_11").alias("avg_hpc_pressure"),
        F.avg("sensor_14").alias("avg_core_speed"))
    return finish(df, ["cycle_window"], None, digits,
                  ["avg_hpc_temp", "avg_hpc_pressure", "avg_core_speed"])


def q12_drift(readings: DataFrame, dataset_id: str = "FD001", unit_number: int | None = None,
              sensor: str = "sensor_11", limit: int | None = None,
              dataset_type: str = "train") -> DataFrame:
    """Change of a sensor since the unit's first cycle (``FIRST_VALUE`` over the unit).

    The first value is a partially aggregated grouped aggregate joined back: no task ever
    holds a whole unit, and rows without a unit form a series of their own.
    """
    rows = subset(readings, dataset_id, dataset_type)
    if unit_number is not None:
        rows = rows.where(F.col("unit_number") == unit_number)
    rows = rows.select("unit_number", "time_cycles", sensor)
    df = attach_series_aggregates(
        rows, ["unit_number"], first_by(sensor, "time_cycles").alias("_first"))
    df = df.select("unit_number", "time_cycles", sensor,
                   (F.col(sensor) - F.col("_first")).alias("pressure_drift"))
    return finish(df, ["unit_number", "time_cycles"], limit)


def q13_threshold_alert(readings: DataFrame, dataset_id: str = "FD001",
                        temp_quantile: float = 0.95, pressure_quantile: float = 0.05,
                        k: int | None = 20,
                        dataset_type: str = "train", digits: int | None = None) -> DataFrame:
    """Units whose mean temperature is above its data-set quantile or whose mean pressure is
    below its quantile.  Units are aggregated first, then compared with the one-row
    thresholds (same result as grouping the crossed rows, far fewer rows joined)."""
    rows = subset(readings, dataset_id, dataset_type)
    th = exact_quantiles(rows, [], {"temp_threshold": ("sensor_3", temp_quantile),
                                    "pressure_threshold": ("sensor_11", pressure_quantile)})
    units = rows.groupBy("unit_number").agg(
        F.max("time_cycles").alias("current_cycle"),
        F.avg("sensor_3").alias("avg_temp"),
        F.avg("sensor_11").alias("avg_pressure"))
    df = (attach_one_row(units, th)
          .where((F.col("avg_temp") > F.col("temp_threshold"))
                 | (F.col("avg_pressure") < F.col("pressure_threshold")))
          .select("unit_number", "current_cycle", "avg_temp", "avg_pressure",
                  "temp_threshold", "pressure_threshold"))
    return finish(df, [F.desc("avg_temp"), "unit_number"], k, digits,
                  ["avg_temp", "avg_pressure"])


def q14_dataset_comparison(readings: DataFrame, dataset_type: str = "train",
                           digits: int | None = None) -> DataFrame:
    df = subset(readings, None, dataset_type).groupBy("dataset_id").agg(
        distinct_numbers("unit_number").alias("engines"),
        F.avg("sensor_2").alias("avg_lpc_temp"),
        F.avg("sensor_3").alias("avg_hpc_temp"),
        F.avg("sensor_11").alias("avg_pressure"),
        F.avg("sensor_14").alias("avg_core_speed"),
        F.stddev_pop("sensor_11").alias("pressure_variability"))
    return finish(df, ["dataset_id"], None, digits,
                  ["avg_lpc_temp", "avg_hpc_temp", "avg_pressure", "avg_core_speed",
                   "pressure_variability"])


def q15_efficiency(readings: DataFrame, dataset_id: str = "FD001", k: int | None = 30,
                   dataset_type: str = "train", digits: int | None = None) -> DataFrame:
    df = subset(readings, dataset_id, dataset_type).groupBy("unit_number").agg(
        F.avg("sensor_10").alias("avg_epr"),
        F.avg("sensor_12").alias("avg_fuel_ratio"),
        F.avg("sensor_15").alias("avg_bypass_ratio"),
        F.avg(safe_ratio("sensor_3", "sensor_2")).alias("temp_ratio_hpc_lpc"),
        F.max("time_cycles").alias("lifecycle"))
    return finish(df, [F.desc("avg_epr"), "unit_number"], k, digits,
                  ["avg_epr", "avg_fuel_ratio", "avg_bypass_ratio", "temp_ratio_hpc_lpc"])


def q16_sensor_criticality(readings: DataFrame, dataset_id: str = "FD001",
                           sensors: Sequence[str] = ("sensor_2", "sensor_3", "sensor_11"),
                           dataset_type: str = "train", digits: int | None = None) -> DataFrame:
    """Coefficient of variation per sensor, most variable first.

    One scan computes all sensors in a single wide aggregate; only the one-row result is
    unpivoted (no row multiplication before the aggregate).
    """
    wide = subset(readings, dataset_id, dataset_type).agg(
        *[coef_variation(s).alias(s) for s in sensors])
    long = wide.unpivot([], list(sensors), "sensor_name", "coef_variation")
    return finish(long, [F.desc("coef_variation"), "sensor_name"], None, digits,
                  ["coef_variation"])


def q16_sensor_criticality_union(readings: DataFrame, dataset_id: str = "FD001",
                                 sensors: Sequence[str] = ("sensor_2", "sensor_3", "sensor_11"),
                                 dataset_type: str = "train",
                                 digits: int | None = None) -> DataFrame:
    """The literal form: one aggregate per sensor, combined by UNION ALL."""
    rows = subset(readings, dataset_id, dataset_type)
    parts = [rows.agg(F.lit(s).alias("sensor_name"), coef_variation(s).alias("coef_variation"))
             for s in sensors]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return finish(out, [F.desc("coef_variation"), "sensor_name"], None, digits,
                  ["coef_variation"])


def q17_train_test_join(readings: DataFrame, dataset_id: str = "FD001",
                        limit: int | None = None, digits: int | None = None) -> DataFrame:
    """Train and test behaviour of the same units.

    Both sides are aggregated per unit before the join: averages and maxima over the
    many-to-many join equal the per-side values (every row of a side repeats equally
    often within a unit), and the join then sees one row per unit and side.
    """
    def side(t: str, avg_name: str, max_name: str) -> DataFrame:
        return subset(readings, dataset_id, t).groupBy("dataset_id", "unit_number").agg(
            F.avg("sensor_11").alias(avg_name), F.max("time_cycles").alias(max_name))

    df = (side("train", "avg_train_pressure", "train_cycles")
          .join(side("test", "avg_test_pressure", "test_cycles"),
                ["dataset_id", "unit_number"], "inner")
          .select("unit_number", "avg_train_pressure", "avg_test_pressure", "train_cycles",
                  "test_cycles"))
    return finish(df, ["unit_number"], limit, digits,
                  ["avg_train_pressure", "avg_test_pressure"])


def q18_ml_features(readings: DataFrame, dataset_id: str = "FD001",
                    max_unit: int | None = None, limit: int | None = None,
                    dataset_type: str = "train") -> DataFrame:
    """Row-level derived features (pure projections: no shuffle until the final sort)."""
    rows = subset(readings, dataset_id, dataset_type)
    if max_unit is not None:
        rows = rows.where(F.col("unit_number") <= max_unit)
    df = rows.select(
        "unit_number", "time_cycles",
        safe_ratio("sensor_8", "sensor_9").alias("fan_core_ratio"),
        (F.col("sensor_3") - F.col("sensor_2")).alias("temp_diff"),
        F.col("sensor_10").alias("pressure_ratio"),
        ((F.col("sensor_8") + F.col("sensor_9")) / 2).alias("avg_speed"),
        # x * x is the correctly rounded square (StrictMath.pow may be 1 ulp off).
        F.sqrt(F.col("sensor_11") * F.col("sensor_11") + F.col("sensor_12") * F.col("sensor_12"))
        .alias("combined_metric"))
    return finish(df, ["unit_number", "time_cycles"], limit)


def q19_dashboard(readings: DataFrame, dataset_type: str | None = None,
                  digits: int | None = None) -> DataFrame:
    """Per data set: engines, mean cycle, train/test row counts, means and median.

    ``dataset_type=None`` runs over train and test together, so both counts are real.
    The distinct engine count is a bitmap next to the other aggregates, which keeps them one
    aggregate by data set; the exact median is joined on it.
    """
    rows = subset(readings, None, dataset_type)
    stats = rows.groupBy("dataset_id").agg(
        distinct_numbers("unit_number").alias("total_engines"),
        F.avg("time_cycles").alias("avg_cycles_per_observation"),
        F.count_if(F.col("dataset_type") == "train").alias("train_records"),
        F.count_if(F.col("dataset_type") == "test").alias("test_records"),
        F.avg("sensor_3").alias("avg_hpc_temp"),
        F.avg("sensor_11").alias("avg_hpc_pressure"))
    median = exact_quantiles(rows, ["dataset_id"], {"median_core_speed": ("sensor_14", 0.5)})
    df = attach_groups(stats, median, ["dataset_id"]).select(
        "dataset_id", "total_engines", "avg_cycles_per_observation", "train_records",
        "test_records", "avg_hpc_temp", "avg_hpc_pressure", "median_core_speed")
    return finish(df, ["dataset_id"], None, digits,
                  ["avg_cycles_per_observation", "avg_hpc_temp", "avg_hpc_pressure"])


def q20_report(readings: DataFrame, dataset_type: str | None = "train",
               digits: int | None = None) -> DataFrame:
    """Per data set and type: engines, observations, cycle range and mean, seven sensor
    means and two standard deviations (over the train table, as the report is defined;
    ``dataset_type=None`` reports every type)."""
    df = subset(readings, None, dataset_type).groupBy("dataset_id", "dataset_type").agg(
        distinct_numbers("unit_number").alias("engines"),
        F.count(F.lit(1)).alias("total_observations"),
        F.min("time_cycles").alias("min_cycle"),
        F.max("time_cycles").alias("max_cycle"),
        F.avg("time_cycles").alias("avg_cycle"),
        F.avg("sensor_2").alias("avg_lpc_temp"),
        F.avg("sensor_3").alias("avg_hpc_temp"),
        F.avg("sensor_7").alias("avg_hpc_total_pressure"),
        F.avg("sensor_8").alias("avg_fan_speed"),
        F.avg("sensor_9").alias("avg_core_speed"),
        F.avg("sensor_11").alias("avg_static_pressure"),
        F.avg("sensor_12").alias("avg_fuel_flow_ratio"),
        F.stddev_pop("sensor_11").alias("pressure_std"),
        F.stddev_pop("sensor_14").alias("core_speed_std"))
    rc = [c for c in df.columns if c.startswith(("avg_", "pressure_std", "core_speed_std"))]
    return finish(df, ["dataset_id", "dataset_type"], None, digits, rc)


def custom_sql(spark: SparkSession, text: str) -> DataFrame:
    """Free SQL over the registered views (``table_views``); Catalyst plans it like the rest."""
    return spark.sql(text)
