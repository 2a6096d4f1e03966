"""The batch jobs over raw text lines, as Spark jobs.

Input is a DataFrame of lines ``(source, value)`` (``sources.text.read_lines`` or a rendered
frame); ``source`` names the file, whose name gives the data set and type.  Every job keys
its groups by (dataset_id, dataset_type) so that unit numbers of different data sets never
mix; the map-side combine of the original jobs is Spark's partial aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.functions.quantiles import attach_groups, exact_quantiles
from wearline.functions.safe import half_even
from wearline.functions.series import first_last_candidates
from wearline.schema import DEGRADATION_SENSORS, FEATURE_COLUMNS, RAW_COLUMNS
from wearline.session import scratch_dir
from wearline.sources.text import (field, file_metadata, number, parse_head, parse_lines_dual,
                                   whole_number)

ID = ["dataset_id", "dataset_type"]
POS = {c: i for i, c in enumerate(RAW_COLUMNS)}


def _with_ids(df: DataFrame) -> DataFrame:
    dsid, dtype = file_metadata(F.col("source"))
    return df.withColumn("dataset_id", dsid).withColumn("dataset_type", dtype)


def line_count(lines: DataFrame) -> DataFrame:
    """Total number of input lines."""
    return lines.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit("total_lines").alias("key"), "total")


def op_count(lines: DataFrame) -> DataFrame:
    """Lines per first field; the key is the unparsed text ``Unit_<field>``."""
    p = _with_ids(parse_head(lines, 1))
    return (p.groupBy(*ID, F.concat(F.lit("Unit_"), field(F.col("fields"), 0)).alias("key"))
            .agg(F.count(F.lit(1)).alias("count")))


def cycle_counter(lines: DataFrame) -> DataFrame:
    """Last cycle per unit: ``int(float(field))`` of the first two fields; bad lines skipped.

    ``max`` ignores a NULL cycle and a NULL unit forms its own group, which is dropped after
    the aggregate: same result as dropping bad lines first, without a row filter that
    Catalyst would push below the parse (and so parse each field twice).
    """
    p = _with_ids(parse_head(lines, 2)).select(
        *ID, whole_number(F.col("fields"), 0).alias("unit_number"),
        whole_number(F.col("fields"), 1).alias("time_cycles"))
    return (p.groupBy(*ID, "unit_number").agg(F.max("time_cycles").alias("max_cycle"))
            .where(F.col("unit_number").isNotNull() & F.col("max_cycle").isNotNull()))


def _first_reduce(cycle_counts: DataFrame) -> DataFrame:
    """The first reduce's result (a row per unit) checkpointed in the shared folder: the second
    reads it several times, the lines are parsed once."""
    scratch_dir(cycle_counts.sparkSession)  # names the checkpoint folder
    return cycle_counts.checkpoint()


def lifetime_distribution(cycle_counts: DataFrame, digits: int | None = None) -> DataFrame:
    """Second reduce over the per-unit lifetimes: their distribution per data set."""
    cycle_counts = _first_reduce(cycle_counts)
    out = cycle_counts.groupBy(*ID).agg(
        F.count(F.lit(1)).alias("units"),
        F.min("max_cycle").alias("min_life"),
        F.max("max_cycle").alias("max_life"),
        F.avg("max_cycle").alias("avg_life"),
        F.stddev_pop("max_cycle").alias("std_life"))
    median = exact_quantiles(cycle_counts, ID, {"median_life": ("max_cycle", 0.5)})
    out = attach_groups(out, median, ID)
    if digits is not None:
        out = out.withColumn("avg_life", F.round("avg_life", digits)).withColumn(
            "std_life", F.round("std_life", digits))
    return out


def lifetime_histogram(cycle_counts: DataFrame, bins: int = 4) -> DataFrame:
    """Equi-depth histogram of the lifetimes per data set: ``bin`` (from 1), its bounds
    (``lower_life`` excluded, but included in the first bin) and the ``units`` in it.

    Bounds are the exact quantiles ``i / bins``, so every bin holds as equal a share of the
    units as ties allow; of bins with the same upper bound only the first has units."""
    cycle_counts = _first_reduce(cycle_counts)
    ends = exact_quantiles(cycle_counts, ID, {f"q{i}": ("max_cycle", i / bins) for i in range(bins + 1)})
    ends = ends.select(*ID, F.array(*[f"q{i}" for i in range(bins + 1)]).alias("_ends"))
    # the first upper bound that is not below the lifetime
    at = F.expr(f"1 + size(filter(slice(_ends, 2, {bins}), b -> b < max_cycle))")
    units = attach_groups(cycle_counts, F.broadcast(ends), ID).groupBy(*ID, at.alias("bin")).agg(F.count(F.lit(1)).alias("units"))
    all_bins = ends.select(*ID, "_ends", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return attach_groups(all_bins, units, [*ID, "bin"]).select(
        *ID, "bin", F.get("_ends", F.col("bin") - 1).alias("lower_life"), F.get("_ends", F.col("bin")).alias("upper_life"),
        F.coalesce("units", F.lit(0)).alias("units"))


def sensor11_stats(lines: DataFrame, column: str = "sensor_11",
                   digits: int | None = None) -> DataFrame:
    """min, max, mean and count of one sensor over well-formed lines (>= 26 fields);
    ``digits`` rounds the mean (half up)."""
    p = _with_ids(parse_lines_dual(lines, 26)).select(
        *ID, number(F.col("fields"), POS[column]).alias("v"))
    key = "Sensor_" + column.split("_")[-1]
    avg = F.avg("v") if digits is None else F.round(F.avg("v"), digits)
    # the aggregates skip NULL (unparsable) values; a group without any value is dropped
    return (p.groupBy(*ID).agg(
        F.min("v").alias("min"), F.max("v").alias("max"), avg.alias("avg"),
        F.count("v").alias("count")).where(F.col("count") > 0)
        .select(F.lit(key).alias("key"), *ID, "min", "max", "avg", "count"))


# Partial state of a feature's five aggregates: eight fields; with three keys 99 of the 100 that
# Spark compiles.
FEATURES_AT_ONCE = 12


def feature_summary(lines: DataFrame, features=FEATURE_COLUMNS, digits: int = 4,
                    dual: bool = False) -> DataFrame:
    """count, min, max, mean, std, variance, range of each feature over comma-separated
    lines with at least 26 fields (``dual=True`` also accepts blank-separated lines);
    unparsable values are skipped per feature.  Variance is the numerically stable
    population variance."""
    p = _with_ids(parse_lines_dual(lines, 26, dual)).select(
        *ID, *[number(F.col("fields"), POS[f]).alias(f) for f in features])
    # A parsed line becomes a row per group of features, few enough that the aggregate's fields
    # stay below the limit of code generation; features are told apart again in its result, one
    # row per data set, type and group.  The deviation is the root of the variance.
    aggs = {"count": F.count, "min": F.min, "max": F.max, "mean": F.avg, "variance": F.var_pop}
    groups = [features[i:i + FEATURES_AT_ONCE] for i in range(0, len(features), FEATURES_AT_ONCE)]
    width = max(map(len, groups))
    by_group = F.inline(F.array(*[F.struct(F.lit(g).alias("g"), *[
        (F.col(fs[i]) if i < len(fs) else F.lit(None).cast("double")).alias(f"v{i}") for i in range(width)]) for g, fs in enumerate(groups)]))
    wide = p.select(*ID, by_group).groupBy(*ID, "g").agg(*[fn(f"v{i}").alias(f"v{i}__{name}") for i in range(width) for name, fn in aggs.items()])
    names = F.array(*[F.array(*[F.lit(f) for f in fs]) for fs in groups])
    rows = wide.select(*ID, names[F.col("g")].alias("fs"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), *[F.col(f"v{i}__{name}").alias(name) for name in aggs]) for i in range(width)])))
    rows = rows.withColumn("feature", F.get("fs", F.col("i"))).where(F.col("feature").isNotNull())
    return rows.select(
        *ID, "feature", "count", "min", "max", half_even("mean", digits).alias("mean"),
        half_even(F.sqrt("variance"), digits).alias("std"), half_even("variance", digits).alias("variance"),
        half_even(F.col("max") - F.col("min"), digits).alias("range"))


def avg_sensor4_by_setting(lines: DataFrame, digits: int = 4) -> DataFrame:
    """Mean of sensor_4 per setting-1 cluster ``OpSet1_<round(op1, 1)>`` (half even)."""
    p = _with_ids(parse_lines_dual(lines, 26)).select(
        *ID, number(F.col("fields"), POS["op_setting_1"]).alias("op1"),
        number(F.col("fields"), POS["sensor_4"]).alias("s4"))
    # A line counts only when both values parse: NULL op1 gives a NULL key (dropped after
    # the aggregate), NULL s4 is skipped by avg; no row filter to push below the parse.
    key = F.concat(F.lit("OpSet1_"), half_even("op1", 1).cast("string")).alias("key")
    return (p.groupBy(*ID, key).agg(
        half_even(F.avg(F.when(F.col("op1").isNotNull(), F.col("s4"))), digits)
        .alias("avg_sensor_4"))
        .where(F.col("key").isNotNull() & F.col("avg_sensor_4").isNotNull()))


def degradation_metrics(lines: DataFrame, sensors: Mapping[str, str] = DEGRADATION_SENSORS,
                        k_max: int = 10, min_fields: int = 15,
                        digits: int = 2, dual: bool = False) -> DataFrame:
    """Per unit with at least 2 readings, in cycle order: mean of the first and the last
    k = min(10, n div 4) readings of five sensors, percent change relative to |early|
    (0 when early is 0), health index = -temperature change + pressure change.

    With k = 0 (2 or 3 readings) the early means are 0 and the late means cover all
    readings.  Input lines are comma-separated with at least ``min_fields`` fields
    (``dual=True`` also accepts blank-separated lines); unparsable sensor fields count as
    0.0.  Only the first and last ``k_max`` rows of a unit leave an input split, so a very long
    series never sits in one task.
    """
    p = _with_ids(parse_lines_dual(lines, min_fields, dual)).select(
        *ID, whole_number(F.col("fields"), 0).alias("unit_number"),
        whole_number(F.col("fields"), 1).alias("time_cycles"),
        *[F.coalesce(number(F.col("fields"), POS[c]), F.lit(0.0)).alias(name)
          for name, c in sensors.items()])
    p = p.where(F.col("unit_number").isNotNull() & F.col("time_cycles").isNotNull())
    key = ID + ["unit_number"]
    cand = first_last_candidates(p, key, ["time_cycles"], k_max)
    n = F.col("series_rows")
    k = F.least(F.lit(k_max), F.floor(n / 4).cast("int"))
    cand = cand.withColumn("_k", k)
    early = (F.col("asc_rank") <= F.col("_k"))
    late = (F.col("desc_rank") <= F.col("_k")) | (F.col("_k") == 0)
    aggs = [F.max("series_rows").alias("_n"),
            F.max(F.when(F.col("desc_rank") == 1, F.col("time_cycles"))).alias("total_cycles")]
    for name in sensors:
        aggs += [F.coalesce(F.avg(F.when(early, F.col(name))), F.lit(0.0)).alias(f"_e_{name}"),
                 F.coalesce(F.avg(F.when(late, F.col(name))), F.lit(0.0)).alias(f"_l_{name}")]
    g = cand.groupBy(*key).agg(*aggs).where(F.col("_n") >= 2)
    pct = {}
    for name in sensors:
        e, l_ = F.col(f"_e_{name}"), F.col(f"_l_{name}")
        pct[name] = half_even(
            F.when(e != 0, (l_ - e) / F.abs(e) * 100).otherwise(F.lit(0.0)), digits)
    names = list(sensors)
    temp, press = names[0], names[1]
    return g.select(
        *key, "total_cycles",
        *[pct[nm].alias(f"{nm}_pct_change") for nm in names],
        half_even(-pct[temp] + pct[press], digits).alias("health_index"),
        half_even(f"_e_{temp}", digits).alias("early_avg_temp"),
        half_even(f"_l_{temp}", digits).alias("late_avg_temp"),
        half_even(f"_e_{press}", digits).alias("early_avg_pressure"),
        half_even(f"_l_{press}", digits).alias("late_avg_pressure"))


def degradation_json(metrics: DataFrame, sensors: Mapping[str, str] = DEGRADATION_SENSORS
                     ) -> DataFrame:
    """The job's output form: unit key and a JSON value with a nested ``degradation``."""
    deg = F.struct(*[F.col(f"{n}_pct_change") for n in sensors]).alias("degradation")
    value = F.to_json(F.struct(
        F.col("unit_number").alias("unit"), "total_cycles", deg, "health_index",
        "early_avg_temp", "late_avg_temp", "early_avg_pressure", "late_avg_pressure"))
    return metrics.select(*ID, "unit_number", value.alias("value"))


def job_output_text(df: DataFrame, key_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Render a job result as tab-separated ``key<TAB>json`` lines."""
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in key_cols])
    return df.select(F.concat(key, F.lit("\t"), F.to_json(F.struct(*value_cols))).alias("value"))


JOB_STATS_SCHEMA = "avg double, min double, max double, count bigint"


def job_result_filter(text: DataFrame, k: int | None = 15) -> DataFrame:
    """Keep result lines whose JSON value has avg, min, max and count; first ``k`` by key."""
    parts = F.split(F.col("value"), "\t", 2)
    parsed = text.select(F.get(parts, 0).alias("key"),
                         F.from_json(F.get(parts, 1), JOB_STATS_SCHEMA).alias("j"))
    out = (parsed.where(F.col("j.avg").isNotNull() & F.col("j.min").isNotNull()
                        & F.col("j.max").isNotNull() & F.col("j.count").isNotNull())
           .select("key", "j.avg", "j.min", "j.max", "j.count").orderBy("key"))
    return out.limit(k) if k is not None else out
