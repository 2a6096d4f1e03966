"""The document-store aggregation pipelines and their dashboard derivations.

Stage lists map one-to-one: ``$match`` -> ``where`` (partition pruning), ``$group`` ->
``groupBy.agg`` (partial + final hash aggregate), ``$project`` -> ``select``,
``$sort`` -> ``orderBy``.  Rounding follows the document store: half to even.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.functions.distinct import number_bits, other_numbers
from wearline.functions.joins import attach_one_row
from wearline.functions.safe import safe_corr, condition_key, half_even, safe_ratio
from wearline.functions.sums import mean_text, with_parts
from wearline.operators.common import finish, subset
from wearline.schema import CRITICAL_SENSORS, SENSOR_COLUMNS


def fleet_summary(readings: DataFrame, dim: DataFrame) -> DataFrame:
    """Per data set: train and test rows plus metadata (``N/A`` when unknown), with the
    fleet totals repeated on every row.

    One scan and one aggregate by data set and type, with a bitmap of the unit numbers; every
    figure follows from its few rows.  ``distinct_unit_numbers`` is the reference's
    ``total_units`` (unit numbers restart per data set); ``engines`` counts true engines (rows
    without a unit number are one of each data set and type).
    """
    parts = readings.groupBy("dataset_id", "dataset_type").agg(
        F.count(F.lit(1)).alias("n"), number_bits("unit_number").alias("bits"), other_numbers("unit_number").alias("others"),
        F.max(F.col("unit_number").isNull().cast("int")).alias("unnamed"))
    fleet = parts.agg(
        F.sum("n").cast("bigint").alias("total_records"),
        (F.bitmap_count(F.bitmap_or_agg("bits")) + F.size(F.array_distinct(F.flatten(F.collect_list("others")))))
        .alias("distinct_unit_numbers"),
        F.sum(F.bitmap_count("bits") + F.size("others") + F.col("unnamed")).alias("engines"),
        F.concat_ws(",", F.array_sort(F.collect_set("dataset_id"))).alias("dataset_ids"),
        F.concat_ws(",", F.array_sort(F.collect_set("dataset_type"))).alias("dataset_types"),
        F.collect_list(F.struct("dataset_id", "dataset_type", "n")).alias("parts"))
    totals = [c for c in fleet.columns if c != "parts"]
    rows = fleet.select(*totals, F.inline("parts"))

    def of(kind: str):
        return F.coalesce(F.sum(F.when(F.col("dataset_type") == kind, F.col("n"))), F.lit(0)).cast("bigint")

    per_ds = rows.groupBy("dataset_id", *totals).agg(of("train").alias("train_count"), of("test").alias("test_count"))
    meta = F.broadcast(dim.select(  # four fixed rows
        "dataset_id", "description",
        F.col("operating_conditions").cast("string").alias("conditions"),
        F.col("fault_modes").cast("string").alias("faults")))
    return (per_ds.join(meta, "dataset_id", "left")
            .select("dataset_id", "train_count", "test_count",
                    F.coalesce("description", F.lit("N/A")).alias("description"),
                    F.coalesce("conditions", F.lit("N/A")).alias("conditions"),
                    F.coalesce("faults", F.lit("N/A")).alias("faults"), *totals)
            .orderBy("dataset_id"))


def avg_sensors_per_unit(readings: DataFrame, dataset_id: str = "FD001",
                         dataset_type: str = "train", sensors: Sequence[str] = SENSOR_COLUMNS,
                         digits: int | None = None, ordered: bool = True) -> DataFrame:
    """Per unit: last cycle and the mean of every sensor (``ordered=False`` skips the final
    sort when the table feeds another aggregate)."""
    df = subset(readings, dataset_id, dataset_type).groupBy("unit_number").agg(
        F.max("time_cycles").alias("max_life"),
        *[F.avg(s).alias(f"avg_{s}") for s in sensors])
    return finish(df, ["unit_number"] if ordered else None, None, digits,
                  [f"avg_{s}" for s in sensors])


def unit_health_scores(readings: DataFrame, dataset_id: str = "FD001",
                       dataset_type: str = "train", digits: int | None = None) -> DataFrame:
    """Per unit: life, mean temperatures and pressure, and
    ``health_index = mean(s11) / (population std(s11) + 1)``; shortest-lived first."""
    df = (subset(readings, dataset_id, dataset_type).groupBy("unit_number").agg(
        F.max("time_cycles").alias("max_life"),
        F.avg("sensor_2").alias("avg_temp_lpc"),
        F.avg("sensor_3").alias("avg_temp_hpc"),
        F.avg("sensor_11").alias("avg_pressure_hpc"),
        F.stddev_pop("sensor_11").alias("_std"))
        .select("unit_number", "max_life", "avg_temp_lpc", "avg_temp_hpc", "avg_pressure_hpc",
                safe_ratio(F.col("avg_pressure_hpc"), F.col("_std") + 1).alias("health_index")))
    return finish(df, ["max_life", "unit_number"], None, digits,
                  ["avg_temp_lpc", "avg_temp_hpc", "avg_pressure_hpc", "health_index"])


def health_top20(readings: DataFrame, dataset_id: str = "FD001", k: int = 20,
                 digits: int | None = None) -> DataFrame:
    """First rows of the health table, as the dashboard shows them."""
    return unit_health_scores(readings, dataset_id, digits=digits).limit(k)


# Partial state of a sensor's four aggregates: seven fields of the 100 that Spark compiles.
SENSORS_AT_ONCE = 14


def sensor_statistics_long(readings: DataFrame, dataset_id: str = "FD001", dataset_type: str = "train",
                           sensors: Sequence[str] | None = None) -> DataFrame:
    """``sensor, pos, min, max, avg, std``, one row per sensor.

    Global aggregates of at most SENSORS_AT_ONCE sensors, each over its own columns of the scan,
    so that every one is compiled and they run side by side; only their one-row results are
    turned to a row per sensor."""
    sensors = list(sensors or SENSOR_COLUMNS)
    rows = subset(readings, dataset_id, dataset_type)
    functions = {"min": "min", "max": "max", "avg": "avg", "std": "stddev_pop"}
    parts = []
    for i in range(0, len(sensors), SENSORS_AT_ONCE):
        some = sensors[i:i + SENSORS_AT_ONCE]
        wide = rows.selectExpr(*[f"{fn}(`{s}`) AS `{s}_{name}`" for s in some for name, fn in functions.items()])
        structs = ", ".join(f"named_struct('sensor', '{s}', 'pos', {sensors.index(s)}, "
                            + ", ".join(f"'{name}', `{s}_{name}`" for name in functions) + ")" for s in some)
        parts.append(wide.selectExpr(f"inline(array({structs}))"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def sensor_statistics(readings: DataFrame, dataset_id: str = "FD001",
                      dataset_type: str = "train", sensors: Sequence[str] | None = None,
                      digits: int | None = None) -> DataFrame:
    """One wide row: ``<sensor>_min/_max/_avg/_std`` for every sensor."""
    sensors = list(sensors or SENSOR_COLUMNS)
    long = sensor_statistics_long(readings, dataset_id, dataset_type, sensors)
    one = long.selectExpr("sensor", "struct(min, max, avg, std) AS v").agg(
        F.map_from_entries(F.collect_list(F.struct("sensor", "v"))).alias("m"))
    df = one.selectExpr(*[f"m['{s}'].{name} AS `{s}_{name}`" for s in sensors for name in ("min", "max", "avg", "std")])
    return finish(df, None, None, digits,
                  [f"{s}_{k}" for s in sensors for k in ("avg", "std")])


def sensor_stats_table(readings: DataFrame, dataset_id: str = "FD001",
                       dataset_type: str = "train",
                       sensors: Sequence[str] = CRITICAL_SENSORS, digits: int = 2) -> DataFrame:
    """Long table (Sensor, Min, Max, Mean, Std Dev) rounded half-even to ``digits``.
    """
    long = sensor_statistics_long(readings, dataset_id, dataset_type, sensors)
    return (long.select(
        "sensor", half_even("min", digits).alias("min"), half_even("max", digits).alias("max"),
        half_even("avg", digits).alias("mean"), half_even("std", digits).alias("std_dev"), "pos")
        .orderBy("pos").drop("pos"))


# Digits beyond those shown that exact means are first rounded to.
GUARD = 6


def degradation_trend(readings: DataFrame, dataset_id: str = "FD001",
                      dataset_type: str = "train", sensors: Sequence[str] = SENSOR_COLUMNS,
                      digits: int | None = None) -> DataFrame:
    """Fleet mean of each sensor per cycle and the number of readings at that cycle; the means
    do not depend on the order of the rows."""
    rows = with_parts(subset(readings, dataset_id, dataset_type), ["time_cycles"], sensors)
    df = rows.groupBy("time_cycles").agg(
        F.count(F.lit(1)).alias("unit_count"), *[F.expr(f"{mean_text(s)} AS `{s}`") for s in sensors])
    return finish(df, ["time_cycles"], None, digits, list(sensors), guard=GUARD)


def fleet_size_at_start(readings: DataFrame, dataset_id: str = "FD001",
                        dataset_type: str = "train") -> DataFrame:
    """Units reporting at the first cycle of the trend (first row of the trend table)."""
    per_cycle = subset(readings, dataset_id, dataset_type).groupBy("time_cycles").agg(
        F.count(F.lit(1)).alias("unit_count"))
    return per_cycle.agg(F.min("time_cycles").alias("time_cycles"),
                         F.min_by("unit_count", "time_cycles").alias("unit_count"))


def failure_features(readings: DataFrame, dataset_id: str = "FD001",
                     dataset_type: str = "train", digits: int | None = None) -> DataFrame:
    df = (subset(readings, dataset_id, dataset_type).groupBy("unit_number").agg(
        F.max("time_cycles").alias("total_cycles"),
        F.avg(safe_ratio(F.col("sensor_3"), F.col("sensor_2") + 1)).alias("avg_temp_ratio"),
        F.avg("sensor_10").alias("avg_pressure_ratio"),
        F.avg("sensor_8").alias("_fan"), F.avg("sensor_9").alias("_core"),
        F.stddev_pop("sensor_8").alias("_sfan"), F.stddev_pop("sensor_9").alias("_score"),
        F.avg("sensor_12").alias("avg_fuel_ratio"))
        .select("unit_number", "total_cycles", "avg_temp_ratio", "avg_pressure_ratio",
                safe_ratio(F.col("_core"), F.col("_fan") + 1).alias("speed_ratio"),
                (F.col("_sfan") + F.col("_score")).alias("speed_variability"),
                "avg_fuel_ratio"))
    return finish(df, ["unit_number"], None, digits,
                  ["avg_temp_ratio", "avg_pressure_ratio", "speed_ratio", "speed_variability",
                   "avg_fuel_ratio"])


def condition_metrics(readings: DataFrame, dataset_id: str = "FD002",
                      dataset_type: str = "train", k: int | None = None,
                      digits: int | None = None, approx_distinct: bool = False) -> DataFrame:
    """Per operating condition ``round(op1,0)-round(op2,1)-round(op3,0)``: distinct units,
    mean pressure, fuel ratio and core speed (independent of the order of the rows), readings;
    most engines first.

    ``approx_distinct`` counts units with a HyperLogLog++ sketch (one pass, fixed memory)
    instead of the exact distinct count, which Spark plans as an extra aggregation level on
    (condition, unit).
    """
    distinct = (F.approx_count_distinct("unit_number") if approx_distinct
                else F.count_distinct("unit_number"))
    means = {"sensor_11": "avg_pressure", "sensor_12": "avg_fuel_ratio", "sensor_14": "avg_core_speed"}
    rows = subset(readings, dataset_id, dataset_type).withColumn("operational_condition", condition_key())
    df = (with_parts(rows, ["operational_condition", "unit_number"], list(means))
          .groupBy("operational_condition").agg(
              distinct.alias("unique_engines"),
              *[F.expr(f"{mean_text(c)} AS {name}") for c, name in means.items()],
              F.count(F.lit(1)).alias("total_observations")))
    return finish(df, [F.desc("unique_engines"), "operational_condition"], k, digits,
                  ["avg_pressure", "avg_fuel_ratio", "avg_core_speed"], guard=GUARD)


def condition_metrics_top15(readings: DataFrame, dim: DataFrame, dataset_id: str = "FD002",
                            k: int = 15, digits: int | None = None) -> DataFrame:
    """Top conditions for the chart, only for multi-condition data sets: the metadata gate
    is an ``EXISTS`` subquery over the (four-row) dimension, no join."""
    gate = dim.where((F.col("dataset_id") == dataset_id)
                     & (F.col("operating_conditions") > 1)).exists()
    df = condition_metrics(readings, dataset_id, digits=digits).where(gate)
    return df.orderBy(F.desc("unique_engines"), "operational_condition").limit(k)


def unit_profile(readings: DataFrame, dataset_id: str = "FD001", dataset_type: str = "train",
                 unit_number: int | None = None, digits: int = 2) -> DataFrame:
    """Unit deep dive: total cycles, mean HPC temperature and pressure (half-even rounded).
    ``unit_number=None`` profiles every unit."""
    rows = subset(readings, dataset_id, dataset_type)
    if unit_number is not None:
        rows = rows.where(F.col("unit_number") == unit_number)
    return rows.groupBy("unit_number").agg(
        F.max("time_cycles").alias("total_cycles"),
        half_even(F.avg("sensor_3"), digits).alias("avg_hpc_temp"),
        half_even(F.avg("sensor_11"), digits).alias("avg_hpc_pressure"),
    ).orderBy("unit_number")


def avg_sensor_corr_matrix(per_unit: DataFrame, columns: Sequence[str] | None = None,
                           digits: int | None = None) -> DataFrame:
    """Pearson matrix of per-unit mean columns in long form ``(column_i, column_j, r)``.

    Each unit's row is turned into its c(c+1)/2 value pairs inside the task, and one small
    aggregate per pair (partial sums, so a task sends one row per pair) gives both cells of
    the pair.  A constant column gives NULL instead of an error.
    """
    cols = list(columns or [c for c in per_unit.columns if c.startswith("avg_sensor_")])
    names = F.array(*[F.lit(c) for c in cols])
    values = F.array(*[F.col(c).cast("double") for c in cols])
    pairs = per_unit.select(values.alias("v")).selectExpr("v", f"explode(sequence(0, {len(cols) - 1})) AS i").selectExpr(
        "v", "i", f"explode(sequence(i, {len(cols) - 1})) AS j").selectExpr("i", "j", "v[i] AS x", "v[j] AS y")
    cells = pairs.groupBy("i", "j").agg(safe_corr("x", "y").alias("r"))
    both = cells.select(F.explode(F.array_distinct(F.array(
        F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("at"), "r")
    df = both.select(names[F.col("at.i")].alias("column_i"), names[F.col("at.j")].alias("column_j"), "r")
    return finish(df, ["column_i", "column_j"], None, digits, ["r"])


def dataset_overview(readings: DataFrame, dim: DataFrame) -> DataFrame:
    """Data-set metadata next to the engine counts found in the data, with mismatch flags.

    Counts come from the data (distinct units per data set and type); the fixed metadata
    is kept as descriptive columns.  A full outer join shows data sets missing on either
    side.  The dimension has four rows, so it is broadcast.
    """
    engines = readings.select("dataset_id", "dataset_type", "unit_number").distinct()
    found = engines.groupBy("dataset_id").agg(
        F.count(F.when(F.col("dataset_type") == "train", F.col("unit_number"))).alias("train_engines_found"),
        F.count(F.when(F.col("dataset_type") == "test", F.col("unit_number"))).alias("test_engines_found"))
    meta = F.broadcast(dim.select("dataset_id", "train_engines", "test_engines",
                                  "operating_conditions", "fault_modes"))
    out = found.join(meta, "dataset_id", "full")
    return out.select(
        "dataset_id", "train_engines", "test_engines", "operating_conditions", "fault_modes",
        F.coalesce("train_engines_found", F.lit(0)).alias("train_engines_found"),
        F.coalesce("test_engines_found", F.lit(0)).alias("test_engines_found"),
        (~F.coalesce("train_engines", F.lit(-1)).eqNullSafe(
            F.coalesce("train_engines_found", F.lit(0)))).alias("train_mismatch"),
        (~F.coalesce("test_engines", F.lit(-1)).eqNullSafe(
            F.coalesce("test_engines_found", F.lit(0)))).alias("test_mismatch"),
    ).orderBy("dataset_id")
