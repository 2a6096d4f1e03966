"""DuckDB oracle SQL for the catalogue: an independent second implementation.

Each string runs on the driver's Parquet tables (registered as views) and starts from the
same fixture CTEs (``oracle_base``).  Aggregates are rounded to 4 decimals, row values are
left as they are; medians and quantiles use ``quantile_disc``.
"""

from __future__ import annotations

from wearline.plans.oracle_base import BAD_SQL, CUT_SQL, with_fixtures

# Fixed values, stated a second time so that a wrong list in the code under test shows.
SENSOR_COLUMNS = [
    "sensor_1", "sensor_2", "sensor_3", "sensor_4", "sensor_5", "sensor_6", "sensor_7", "sensor_8", "sensor_9", "sensor_10", "sensor_11",
    "sensor_12", "sensor_13", "sensor_14", "sensor_15", "sensor_16", "sensor_17", "sensor_18", "sensor_19", "sensor_20", "sensor_21",
]
RAW_COLUMNS = ["unit_number", "time_cycles", "op_setting_1", "op_setting_2", "op_setting_3"] + SENSOR_COLUMNS
READING_COLUMNS = RAW_COLUMNS + ["dataset_id", "dataset_type"]
CRITICAL_SENSORS = [
    "sensor_2", "sensor_3", "sensor_4", "sensor_7", "sensor_8", "sensor_9", "sensor_11", "sensor_12", "sensor_13", "sensor_14", "sensor_15",
]
DEGRADATION_SENSORS = {
    "temp_hpc": "sensor_3",
    "pressure_hpc": "sensor_11",
    "fan_speed": "sensor_8",
    "core_speed": "sensor_9",
    "fuel_ratio": "sensor_12",
}
DEGRADATION_SENSORS_LITERAL = {
    "temp_hpc": "op_setting_3",
    "pressure_hpc": "sensor_8",
    "fan_speed": "sensor_5",
    "core_speed": "sensor_6",
    "fuel_ratio": "sensor_9",
}
DATASET_METADATA = [
    ("FD001", 100, 100, 1, 1, "Single operating condition, single fault mode (HPC degradation)"),
    ("FD002", 260, 259, 6, 1, "Six operating conditions, single fault mode (HPC degradation)"),
    ("FD003", 100, 100, 1, 2, "Single operating condition, two fault modes (HPC & Fan degradation)"),
    ("FD004", 248, 249, 6, 2, "Six operating conditions, two fault modes (HPC & Fan degradation)"),
]

ORACLE: dict[str, str] = {}


def _r(expr: str, alias: str, d: int = 4) -> str:
    return f"ROUND({expr}, {d}) AS {alias}"


def _mean(column: str, alias: str) -> str:
    """Compensated mean, rounded as a decimal: the operator's means do not depend on the order of
    the rows, and are rounded to ten digits before the four shown."""
    return f"CAST(ROUND(CAST(favg({column}) AS DECIMAL(28, 10)), 4) AS DOUBLE) AS {alias}"


def _corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / NULLIF(stddev_pop({a}) * stddev_pop({b}), 0)"


def _dim_values() -> str:
    rows = ", ".join(
        f"('{n}', {tr}, {te}, {oc}, {fm}, '{desc}')" for n, tr, te, oc, fm, desc in DATASET_METADATA)
    return (f"dim(dataset_id, train_engines, test_engines, operating_conditions, fault_modes, "
            f"description) AS (VALUES {rows})")


FD1 = "dataset_id = 'FD001'"

# ----------------------------------------------------------------------------- warehouse
ORACLE["q01_filter"] = with_fixtures(
    f"SELECT * FROM cmapss_train WHERE {FD1} ORDER BY unit_number, time_cycles")

ORACLE["q02_group_by_unit"] = with_fixtures(f"""
SELECT unit_number, COUNT(*) AS cycle_count, MAX(time_cycles) AS max_cycle
FROM cmapss_train WHERE {FD1} GROUP BY unit_number
ORDER BY max_cycle DESC, unit_number LIMIT 20""")

ORACLE["q03_avg_sensors"] = with_fixtures(f"""
SELECT unit_number, {_r('AVG(sensor_2)', 'avg_temp_lpc')}, {_r('AVG(sensor_3)', 'avg_temp_hpc')},
       {_r('AVG(sensor_11)', 'avg_pressure_hpc')}, {_r('AVG(sensor_12)', 'avg_fuel_ratio')},
       MAX(time_cycles) AS total_cycles
FROM cmapss_train WHERE {FD1} GROUP BY unit_number
ORDER BY total_cycles DESC, unit_number LIMIT 50""")

ORACLE["q04_variability"] = with_fixtures(f"""
SELECT unit_number, {_r('STDDEV_POP(sensor_11)', 'std_pressure')},
       {_r('STDDEV_POP(sensor_8)', 'std_fan_speed')}, {_r('STDDEV_POP(sensor_9)', 'std_core_speed')},
       MAX(time_cycles) AS lifecycle
FROM cmapss_train WHERE {FD1} GROUP BY unit_number HAVING STDDEV_POP(sensor_11) > 0
ORDER BY std_pressure DESC, unit_number LIMIT 10""")

_STAGE = "CASE WHEN time_cycles < 50 THEN 'Early' WHEN time_cycles < 100 THEN 'Mid' ELSE 'Late' END"
ORACLE["q05_lifecycle_stage"] = with_fixtures(f"""
SELECT {_STAGE} AS lifecycle_stage, {_r('AVG(sensor_3)', 'avg_hpc_temp')},
       {_r('AVG(sensor_11)', 'avg_hpc_pressure')}, {_r('AVG(sensor_14)', 'avg_core_speed')},
       COUNT(*) AS observation_count
FROM cmapss_train WHERE {FD1} GROUP BY {_STAGE} ORDER BY lifecycle_stage""")

ORACLE["q06_operating_conditions"] = with_fixtures("""
SELECT ROUND(op_setting_1, 0) AS altitude_group, ROUND(op_setting_2, 1) AS mach_group,
       COUNT(DISTINCT unit_number) AS engine_count,
       ROUND(AVG(sensor_11), 4) AS avg_pressure, ROUND(AVG(sensor_12), 4) AS avg_fuel_ratio
FROM cmapss_train WHERE dataset_id = 'FD002'
GROUP BY ROUND(op_setting_1, 0), ROUND(op_setting_2, 1)
ORDER BY engine_count DESC, altitude_group, mach_group LIMIT 20""")

ORACLE["q07_similar_profiles"] = with_fixtures("""
SELECT unit_number, ROUND(AVG(op_setting_1), 4) AS avg_altitude,
       ROUND(AVG(op_setting_2), 4) AS avg_mach, ROUND(AVG(op_setting_3), 4) AS avg_tra,
       MAX(time_cycles) AS lifecycle
FROM cmapss_train WHERE dataset_id = 'FD002' GROUP BY unit_number
HAVING AVG(op_setting_1) BETWEEN 0 AND 10
ORDER BY avg_altitude, avg_mach, unit_number LIMIT 30""")

ORACLE["q08_correlation"] = with_fixtures(f"""
SELECT dataset_id, {_r(_corr('sensor_8', 'sensor_9'), 'fan_core_speed_corr')},
       {_r(_corr('sensor_2', 'sensor_3'), 'lpc_hpc_temp_corr')},
       {_r(_corr('sensor_11', 'sensor_12'), 'pressure_fuel_corr')}
FROM cmapss_train GROUP BY dataset_id ORDER BY dataset_id""")

ORACLE["q09_anomalies"] = with_fixtures(f"""
SELECT unit_number, time_cycles, sensor_11, ROUND(m, 4) AS mean_pressure, ROUND(d / sd, 4) AS z_score
FROM (SELECT unit_number, time_cycles, sensor_11, AVG(sensor_11) OVER () AS m, STDDEV_POP(sensor_11) OVER () AS sd,
             ABS(sensor_11 - AVG(sensor_11) OVER ()) AS d
      FROM cmapss_train WHERE {FD1}) x
WHERE d > 2 * sd ORDER BY 5 DESC, 1, 2 LIMIT 50""")

ORACLE["q10_rul_stats"] = with_fixtures("""
SELECT dataset_id, COUNT(*) AS engine_count, ROUND(AVG(rul), 4) AS avg_rul,
       MIN(rul) AS min_rul, MAX(rul) AS max_rul, quantile_disc(rul, 0.5) AS median_rul,
       ROUND(STDDEV_POP(rul), 4) AS std_rul
FROM rul GROUP BY dataset_id ORDER BY dataset_id""")

ORACLE["q11_cycle_windows"] = with_fixtures(f"""
SELECT CAST(FLOOR(time_cycles / 25) * 25 AS BIGINT) AS cycle_window,
       COUNT(*) AS observation_count, {_r('AVG(sensor_3)', 'avg_hpc_temp')},
       {_r('AVG(sensor_11)', 'avg_hpc_pressure')}, {_r('AVG(sensor_14)', 'avg_core_speed')}
FROM cmapss_train WHERE {FD1} GROUP BY 1 ORDER BY cycle_window""")

ORACLE["q12_drift"] = with_fixtures(f"""
SELECT unit_number, time_cycles, sensor_11,
       sensor_11 - FIRST_VALUE(sensor_11) OVER (PARTITION BY unit_number ORDER BY time_cycles)
         AS pressure_drift
FROM cmapss_train WHERE {FD1} ORDER BY unit_number, time_cycles""")


def _q13(tq: float, pq: float) -> str:
    # The quantile as the value at its place in the sorted column.
    def at(column: str, q: float) -> str:
        return (f"(SELECT {column} FROM cmapss_train WHERE {FD1} ORDER BY {column} "
                f"OFFSET (SELECT CAST(CEIL(COUNT(*) * {q}) AS BIGINT) - 1 FROM cmapss_train WHERE {FD1}) LIMIT 1)")

    return with_fixtures(f"""
SELECT unit_number, current_cycle, ROUND(temp, 4) AS avg_temp, ROUND(pressure, 4) AS avg_pressure,
       hot AS temp_threshold, low AS pressure_threshold
FROM (SELECT *, {at('sensor_3', tq)} AS hot, {at('sensor_11', pq)} AS low FROM engine) e
WHERE temp > hot OR pressure < low ORDER BY 3 DESC, 1 LIMIT 20""", extra_ctes=f"""
engine AS (SELECT unit_number, MAX(time_cycles) AS current_cycle, AVG(sensor_3) AS temp, AVG(sensor_11) AS pressure
           FROM cmapss_train WHERE {FD1} GROUP BY unit_number)""")


ORACLE["q13_threshold_alert"] = _q13(0.95, 0.05)
ORACLE["q13_threshold_alert_mid"] = _q13(0.55, 0.45)

ORACLE["q14_dataset_comparison"] = with_fixtures(f"""
SELECT dataset_id, COUNT(DISTINCT unit_number) AS engines,
       {_r('AVG(sensor_2)', 'avg_lpc_temp')}, {_r('AVG(sensor_3)', 'avg_hpc_temp')},
       {_r('AVG(sensor_11)', 'avg_pressure')}, {_r('AVG(sensor_14)', 'avg_core_speed')},
       {_r('STDDEV_POP(sensor_11)', 'pressure_variability')}
FROM cmapss_train GROUP BY dataset_id ORDER BY dataset_id""")

ORACLE["q15_efficiency"] = with_fixtures(f"""
SELECT unit_number, {_r('AVG(sensor_10)', 'avg_epr')}, {_r('AVG(sensor_12)', 'avg_fuel_ratio')},
       {_r('AVG(sensor_15)', 'avg_bypass_ratio')},
       {_r('AVG(sensor_3 / NULLIF(sensor_2, 0))', 'temp_ratio_hpc_lpc')},
       MAX(time_cycles) AS lifecycle
FROM cmapss_train WHERE {FD1} GROUP BY unit_number
ORDER BY avg_epr DESC, unit_number LIMIT 30""")

_CV = "ROUND(STDDEV_POP({s}) / NULLIF(AVG({s}), 0), 4)"
_Q16 = f"""
SELECT 'sensor_2' AS sensor_name, {_CV.format(s='sensor_2')} AS coef_variation
FROM cmapss_train WHERE {FD1}
UNION ALL
SELECT 'sensor_3', {_CV.format(s='sensor_3')} FROM cmapss_train WHERE {FD1}
UNION ALL
SELECT 'sensor_11', {_CV.format(s='sensor_11')} FROM cmapss_train WHERE {FD1}
ORDER BY coef_variation DESC, sensor_name"""
ORACLE["q16_sensor_criticality"] = with_fixtures(_Q16)
ORACLE["q16_sensor_criticality_union"] = with_fixtures(_Q16)

# Naive many-to-many join, aggregated afterwards (the operator pre-aggregates each side).
ORACLE["q17_train_test_join"] = with_fixtures("""
SELECT unit_number, ROUND(AVG(sensor_11) FILTER (dataset_type = 'train'), 4) AS avg_train_pressure,
       ROUND(AVG(sensor_11) FILTER (dataset_type = 'test'), 4) AS avg_test_pressure,
       MAX(time_cycles) FILTER (dataset_type = 'train') AS train_cycles,
       MAX(time_cycles) FILTER (dataset_type = 'test') AS test_cycles
FROM readings WHERE dataset_id = 'FD001' GROUP BY unit_number
HAVING COUNT(DISTINCT dataset_type) = 2""")

# POW(x, 2) is written as x * x: DuckDB's POW is one ulp off the correctly rounded square on
# some rows, while x * x is exact-rounded in both engines.
ORACLE["q18_ml_features"] = with_fixtures(f"""
SELECT unit_number, time_cycles, sensor_8 / NULLIF(sensor_9, 0) AS fan_core_ratio,
       sensor_3 - sensor_2 AS temp_diff, sensor_10 AS pressure_ratio,
       (sensor_8 + sensor_9) / 2 AS avg_speed,
       SQRT(sensor_11 * sensor_11 + sensor_12 * sensor_12) AS combined_metric
FROM cmapss_train WHERE {FD1} ORDER BY unit_number, time_cycles""")


def _q19(table: str) -> str:
    return with_fixtures(f"""
SELECT dataset_id, COUNT(DISTINCT unit_number) AS total_engines,
       ROUND(AVG(time_cycles), 4) AS avg_cycles_per_observation,
       CAST(SUM(CASE WHEN dataset_type = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train_records,
       CAST(SUM(CASE WHEN dataset_type = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS test_records,
       ROUND(AVG(sensor_3), 4) AS avg_hpc_temp, ROUND(AVG(sensor_11), 4) AS avg_hpc_pressure,
       quantile_disc(sensor_14, 0.5) AS median_core_speed
FROM {table} GROUP BY dataset_id ORDER BY dataset_id""")


ORACLE["q19_dashboard"] = _q19("readings")
ORACLE["q19_dashboard_train"] = _q19("cmapss_train")

ORACLE["q20_report"] = with_fixtures(f"""
SELECT dataset_id, dataset_type, COUNT(DISTINCT unit_number) AS engines,
       COUNT(*) AS total_observations, MIN(time_cycles) AS min_cycle,
       MAX(time_cycles) AS max_cycle, {_r('AVG(time_cycles)', 'avg_cycle')},
       {_r('AVG(sensor_2)', 'avg_lpc_temp')}, {_r('AVG(sensor_3)', 'avg_hpc_temp')},
       {_r('AVG(sensor_7)', 'avg_hpc_total_pressure')}, {_r('AVG(sensor_8)', 'avg_fan_speed')},
       {_r('AVG(sensor_9)', 'avg_core_speed')}, {_r('AVG(sensor_11)', 'avg_static_pressure')},
       {_r('AVG(sensor_12)', 'avg_fuel_flow_ratio')},
       {_r('STDDEV_POP(sensor_11)', 'pressure_std')}, {_r('STDDEV_POP(sensor_14)', 'core_speed_std')}
FROM cmapss_train GROUP BY dataset_id, dataset_type ORDER BY dataset_id, dataset_type""")

# ----------------------------------------------------------------------------- pipelines
ORACLE["fleet_summary"] = with_fixtures("""
SELECT d.dataset_id, d.train_count, d.test_count,
       COALESCE(dim.description, 'N/A') AS description,
       COALESCE(CAST(dim.operating_conditions AS VARCHAR), 'N/A') AS conditions,
       COALESCE(CAST(dim.fault_modes AS VARCHAR), 'N/A') AS faults,
       t.total_records, t.distinct_unit_numbers, t.engines, t.dataset_ids, t.dataset_types
FROM d LEFT JOIN dim ON d.dataset_id = dim.dataset_id CROSS JOIN t
ORDER BY d.dataset_id""", extra_ctes=_dim_values() + """,
e AS (SELECT dataset_id, dataset_type, unit_number, COUNT(*) AS n FROM readings
      GROUP BY dataset_id, dataset_type, unit_number),
t AS (SELECT CAST(SUM(n) AS BIGINT) AS total_records,
             COUNT(DISTINCT unit_number) AS distinct_unit_numbers, COUNT(*) AS engines,
             array_to_string(list_sort(list_distinct(list(dataset_id))), ',') AS dataset_ids,
             array_to_string(list_sort(list_distinct(list(dataset_type))), ',') AS dataset_types
      FROM e),
d AS (SELECT dataset_id,
             CAST(COALESCE(SUM(CASE WHEN dataset_type = 'train' THEN n END), 0) AS BIGINT) AS train_count,
             CAST(COALESCE(SUM(CASE WHEN dataset_type = 'test' THEN n END), 0) AS BIGINT) AS test_count
      FROM e GROUP BY dataset_id)""")

ORACLE["avg_sensors_per_unit"] = with_fixtures(
    "SELECT unit_number, MAX(time_cycles) AS max_life, "
    + ", ".join(_r(f"AVG({s})", f"avg_{s}") for s in SENSOR_COLUMNS)
    + f" FROM cmapss_train WHERE {FD1} GROUP BY unit_number ORDER BY unit_number")

_HEALTH = f"""
SELECT unit_number, MAX(time_cycles) AS max_life, {_r('AVG(sensor_2)', 'avg_temp_lpc')},
       {_r('AVG(sensor_3)', 'avg_temp_hpc')}, {_r('AVG(sensor_11)', 'avg_pressure_hpc')},
       {_r('AVG(sensor_11) / (STDDEV_POP(sensor_11) + 1)', 'health_index')}
FROM cmapss_train WHERE {FD1} GROUP BY unit_number ORDER BY max_life, unit_number"""
ORACLE["unit_health_scores"] = with_fixtures(_HEALTH)
ORACLE["health_top20"] = with_fixtures(_HEALTH + " LIMIT 20")

ORACLE["sensor_statistics"] = with_fixtures(
    "SELECT " + ", ".join(
        f"MIN({s}) AS {s}_min, MAX({s}) AS {s}_max, {_r(f'AVG({s})', s + '_avg')}, "
        f"{_r(f'STDDEV_POP({s})', s + '_std')}" for s in SENSOR_COLUMNS)
    + f" FROM cmapss_train WHERE {FD1}")


def _even(expr: str, d: int = 2) -> str:
    return f"round_even({expr}, {d}) + 0.0"


ORACLE["sensor_stats_table"] = with_fixtures("\nUNION ALL\n".join(
    f"SELECT '{s}' AS sensor, {_even(f'MIN({s})')} AS min, {_even(f'MAX({s})')} AS max, "
    f"{_even(f'AVG({s})')} AS mean, {_even(f'STDDEV_POP({s})')} AS std_dev "
    f"FROM cmapss_train WHERE {FD1}" for s in CRITICAL_SENSORS))

ORACLE["degradation_trend"] = with_fixtures(
    "SELECT time_cycles, COUNT(*) AS unit_count, "
    + ", ".join(_mean(s, s) for s in SENSOR_COLUMNS)
    + f" FROM cmapss_train WHERE {FD1} GROUP BY time_cycles ORDER BY time_cycles")

ORACLE["fleet_size_at_start"] = with_fixtures(f"""
SELECT MIN(time_cycles) AS time_cycles, arg_min(unit_count, time_cycles) AS unit_count
FROM (SELECT time_cycles, COUNT(*) AS unit_count FROM cmapss_train WHERE {FD1}
      GROUP BY time_cycles)""")

ORACLE["failure_features"] = with_fixtures(f"""
SELECT unit_number, MAX(time_cycles) AS total_cycles,
       {_r('AVG(sensor_3 / NULLIF(sensor_2 + 1, 0))', 'avg_temp_ratio')},
       {_r('AVG(sensor_10)', 'avg_pressure_ratio')},
       {_r('AVG(sensor_9) / NULLIF(AVG(sensor_8) + 1, 0)', 'speed_ratio')},
       {_r('STDDEV_POP(sensor_8) + STDDEV_POP(sensor_9)', 'speed_variability')},
       {_r('AVG(sensor_12)', 'avg_fuel_ratio')}
FROM cmapss_train WHERE {FD1} GROUP BY unit_number ORDER BY unit_number""")


def _num_text(expr: str) -> str:
    return (f"CASE WHEN {expr} = FLOOR({expr}) THEN CAST(CAST({expr} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({expr} AS VARCHAR) END")


_COND_KEY = " || '-' || ".join([
    _num_text("(round_even(op_setting_1, 0) + 0.0)"),
    _num_text("(round_even(op_setting_2, 1) + 0.0)"),
    _num_text("(round_even(op_setting_3, 0) + 0.0)")])
_COND = f"""
SELECT {_COND_KEY} AS operational_condition, COUNT(DISTINCT unit_number) AS unique_engines,
       {_mean('sensor_11', 'avg_pressure')}, {_mean('sensor_12', 'avg_fuel_ratio')},
       {_mean('sensor_14', 'avg_core_speed')}, COUNT(*) AS total_observations
FROM cmapss_train WHERE dataset_id = 'FD002' GROUP BY 1
ORDER BY unique_engines DESC, operational_condition"""
ORACLE["condition_metrics"] = with_fixtures(_COND)
ORACLE["condition_metrics_top15"] = with_fixtures(f"""
SELECT c.* FROM ({_COND}) c
WHERE EXISTS (SELECT 1 FROM dim WHERE dim.dataset_id = 'FD002' AND dim.operating_conditions > 1)
ORDER BY unique_engines DESC, operational_condition LIMIT 15""", extra_ctes=_dim_values())

ORACLE["unit_profile"] = with_fixtures(f"""
SELECT unit_number, MAX(time_cycles) AS total_cycles,
       {_even('AVG(sensor_3)')} AS avg_hpc_temp, {_even('AVG(sensor_11)')} AS avg_hpc_pressure
FROM cmapss_train WHERE {FD1} GROUP BY unit_number ORDER BY unit_number""")

ORACLE["avg_sensor_corr_matrix"] = with_fixtures(f"""
SELECT a.col AS column_i, b.col AS column_j,
       ROUND({_corr('a.v', 'b.v')}, 4) AS r
FROM l a JOIN l b ON a.unit_number = b.unit_number
GROUP BY a.col, b.col ORDER BY column_i, column_j""", extra_ctes=(
    "pu AS (SELECT unit_number, "
    + ", ".join(f"AVG({s}) AS avg_{s}" for s in SENSOR_COLUMNS)
    + f" FROM cmapss_train WHERE {FD1} GROUP BY unit_number),\n"
    "l AS (UNPIVOT pu ON COLUMNS('avg_sensor_.*') INTO NAME col VALUE v)"))

# ----------------------------------------------------------------------------- jobs
# The jobs read text lines rendered from readings; a cut line holds 20 fields, a bad line
# carries a letter in sensor_11.  Over the readings table the same rules read:
ORACLE["line_count"] = with_fixtures(
    "SELECT 'total_lines' AS key, COUNT(*) AS total FROM readings")

ORACLE["op_count"] = with_fixtures("""
SELECT dataset_id, dataset_type, 'Unit_' || CAST(unit_number AS VARCHAR) AS key, COUNT(*) AS count
FROM readings GROUP BY 1, 2, 3""")

_CYCLES = """
SELECT dataset_id, dataset_type, unit_number, MAX(time_cycles) AS max_cycle
FROM readings GROUP BY 1, 2, 3"""
ORACLE["cycle_counter"] = with_fixtures(_CYCLES)

ORACLE["lifetime_distribution"] = with_fixtures(f"""
SELECT dataset_id, dataset_type, COUNT(*) AS units, MIN(max_cycle) AS min_life,
       MAX(max_cycle) AS max_life, {_r('AVG(max_cycle)', 'avg_life')},
       {_r('STDDEV_POP(max_cycle)', 'std_life')}, quantile_disc(max_cycle, 0.5) AS median_life
FROM ({_CYCLES}) c GROUP BY 1, 2""")

ORACLE["lifetime_histogram"] = with_fixtures(f"""
SELECT dataset_id, dataset_type, k AS bin, q[k] AS lower_life, q[k + 1] AS upper_life,
       (SELECT COUNT(*) FROM c x WHERE x.dataset_id IS NOT DISTINCT FROM e.dataset_id AND x.dataset_type = e.dataset_type
        AND len(list_filter(e.q[2:], lambda b: b < x.max_cycle)) = k - 1) AS units
FROM (SELECT dataset_id, dataset_type, quantile_disc(max_cycle, [0, 0.25, 0.5, 0.75, 1]) AS q FROM c GROUP BY 1, 2) e,
     range(1, 5) r(k)""", extra_ctes=f"c AS ({_CYCLES})")

_S11 = f"""
SELECT 'Sensor_11' AS key, dataset_id, dataset_type, MIN(sensor_11) AS min,
       MAX(sensor_11) AS max, ROUND(AVG(sensor_11), 4) AS avg, COUNT(*) AS count
FROM readings WHERE NOT {CUT_SQL} AND NOT {BAD_SQL} GROUP BY 2, 3"""
ORACLE["sensor11_stats"] = with_fixtures(_S11)

_FEATURES = ["op_setting_1", "op_setting_2", "op_setting_3"] + SENSOR_COLUMNS
_FEAT_COLS = ", ".join(
    f"CASE WHEN {BAD_SQL} THEN NULL ELSE sensor_11 END AS sensor_11" if f == "sensor_11" else f
    for f in _FEATURES)
ORACLE["feature_summary"] = with_fixtures("""
SELECT dataset_id, dataset_type, feature, COUNT(v) AS count, MIN(v) AS min, MAX(v) AS max,
       round_even(AVG(v), 4) + 0.0 AS mean, round_even(STDDEV_POP(v), 4) + 0.0 AS std,
       round_even(VAR_POP(v), 4) + 0.0 AS variance, round_even(MAX(v) - MIN(v), 4) + 0.0 AS range
FROM fl GROUP BY 1, 2, 3""", extra_ctes=f"""
fw AS (SELECT dataset_id, dataset_type, {_FEAT_COLS} FROM readings WHERE NOT {CUT_SQL}),
fl AS (UNPIVOT fw ON {", ".join(_FEATURES)} INTO NAME feature VALUE v)""")

ORACLE["avg_sensor4_by_setting"] = with_fixtures(f"""
SELECT dataset_id, dataset_type,
       'OpSet1_' || CAST(round_even(op_setting_1, 1) + 0.0 AS VARCHAR) AS key,
       round_even(AVG(sensor_4), 4) + 0.0 AS avg_sensor_4
FROM readings WHERE NOT {CUT_SQL} GROUP BY 1, 2, 3""")

_S11_BAD = f"CASE WHEN {BAD_SQL} THEN 0.0 ELSE sensor_11 END"


def _pct(n: str) -> str:
    return f"round_even(CASE WHEN e_{n} <> 0 THEN (l_{n} - e_{n}) / ABS(e_{n}) * 100 ELSE 0.0 END, 2)"


def _degradation(sensors: dict) -> str:
    _DEG = {n: (_S11_BAD if c == "sensor_11" else c) for n, c in sensors.items()}
    _DEG_AVG = ",\n       ".join(
        f"COALESCE(AVG(CASE WHEN a <= k THEN {n} END), 0.0) AS e_{n}, "
        f"COALESCE(AVG(CASE WHEN b <= k OR k = 0 THEN {n} END), 0.0) AS l_{n}" for n in _DEG)
    return with_fixtures(f"""
SELECT dataset_id, dataset_type, unit_number, total_cycles,
       {", ".join(_pct(n) + " + 0.0 AS " + n + "_pct_change" for n in _DEG)},
       round_even(-{_pct("temp_hpc")} + {_pct("pressure_hpc")}, 2) + 0.0 AS health_index,
       round_even(e_temp_hpc, 2) + 0.0 AS early_avg_temp,
       round_even(l_temp_hpc, 2) + 0.0 AS late_avg_temp,
       round_even(e_pressure_hpc, 2) + 0.0 AS early_avg_pressure,
       round_even(l_pressure_hpc, 2) + 0.0 AS late_avg_pressure
FROM g WHERE n >= 2""", extra_ctes=f"""
dl AS (SELECT dataset_id, dataset_type, unit_number, time_cycles,
              {", ".join(f"{v} AS {n}" for n, v in _DEG.items())} FROM readings),
dr AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, dataset_type, unit_number
                                    ORDER BY time_cycles) AS a,
              row_number() OVER (PARTITION BY dataset_id, dataset_type, unit_number
                                 ORDER BY time_cycles DESC) AS b,
              COUNT(*) OVER (PARTITION BY dataset_id, dataset_type, unit_number) AS n
       FROM dl),
dk AS (SELECT *, LEAST(10, CAST(FLOOR(n / 4) AS INT)) AS k FROM dr),
g AS (SELECT dataset_id, dataset_type, unit_number, MAX(n) AS n,
             MAX(time_cycles) AS total_cycles,
       {_DEG_AVG}
      FROM dk GROUP BY 1, 2, 3)""")


ORACLE["degradation_metrics"] = _degradation(DEGRADATION_SENSORS)
ORACLE["degradation_metrics_literal"] = _degradation(DEGRADATION_SENSORS_LITERAL)

ORACLE["job_result_filter"] = with_fixtures(f"""
SELECT key || '/' || dataset_id || '/' || dataset_type AS key, avg, min, max, count
FROM ({_S11}) s ORDER BY key LIMIT 15""")

# ----------------------------------------------------------------------------- reads, changes
ORACLE["get_dataset"] = with_fixtures(
    "SELECT * FROM readings WHERE dataset_id = 'FD001' "
    "ORDER BY dataset_id, unit_number, time_cycles, dataset_type")
ORACLE["sample_rows"] = with_fixtures(
    f"SELECT * FROM cmapss_train WHERE {FD1} ORDER BY unit_number, time_cycles LIMIT 5")
ORACLE["unit_series"] = ORACLE["q01_filter"]
ORACLE["training_scan"] = ORACLE["q01_filter"]

_FIX = """fix AS (SELECT dataset_id, dataset_type, unit_number, MAX(time_cycles) AS time_cycles,
                    MAX(sensor_11) AS sensor_11
             FROM readings GROUP BY 1, 2, 3)"""
_KEYJ = ("r.dataset_id = u.dataset_id AND r.dataset_type = u.dataset_type "
         "AND r.unit_number = u.unit_number AND r.time_cycles = u.time_cycles")
ORACLE["update_readings"] = with_fixtures(
    "SELECT " + ", ".join(
        "COALESCE(u.sensor_11, r.sensor_11) AS sensor_11" if c == "sensor_11" else f"r.{c}"
        for c in READING_COLUMNS)
    + f" FROM readings r LEFT JOIN fix u ON {_KEYJ}", extra_ctes=_FIX)
ORACLE["update_report"] = with_fixtures(f"""
SELECT COUNT(*) AS matched_count,
       COUNT(*) FILTER (WHERE u.sensor_11 IS NOT NULL
                        AND u.sensor_11 IS DISTINCT FROM r.sensor_11) AS modified_count
FROM readings r JOIN fix u ON {_KEYJ}""", extra_ctes=_FIX)

_RANK = ("CASE dataset_type WHEN 'train' THEN 0 WHEN 'test' THEN 1 WHEN 'rul' THEN 2 "
         "ELSE 3 END")
_KEY1 = "dataset_id = 'FD001' AND unit_number = 1 AND time_cycles = 1"
ORACLE["update_sensor_data"] = with_fixtures(
    "SELECT " + ", ".join(
        f"CASE WHEN {_KEY1} AND {_RANK} = best.b THEN 0.0 ELSE sensor_11 END AS sensor_11"
        if c == "sensor_11" else c for c in READING_COLUMNS)
    + " FROM readings CROSS JOIN best",
    extra_ctes=f"best AS (SELECT MIN({_RANK}) AS b FROM readings WHERE {_KEY1})")

ORACLE["delete_dataset"] = with_fixtures(
    "SELECT * FROM readings WHERE NOT (dataset_id = 'FD002' AND dataset_type = 'test')")
ORACLE["deleted_count"] = with_fixtures(
    "SELECT COUNT(*) AS deleted_count FROM readings "
    "WHERE dataset_id = 'FD002' AND dataset_type = 'test'")

# ----------------------------------------------------------------------------- sources, sinks
_CUT_COLS = set(SENSOR_COLUMNS[15:])  # a cut line ends after sensor_15
ORACLE["parse_readings"] = with_fixtures(
    "SELECT " + ", ".join(
        f"CASE WHEN {CUT_SQL} THEN NULL ELSE {c} END AS {c}" if c in _CUT_COLS
        else f"CASE WHEN {BAD_SQL} THEN NULL ELSE {c} END AS {c}" if c == "sensor_11"
        else c for c in READING_COLUMNS)
    + f", NOT {CUT_SQL} AND NOT {BAD_SQL} AS parse_ok FROM readings")

ORACLE["parse_rul"] = with_fixtures("SELECT rul, dataset_id, dataset_type FROM rul")

ORACLE["ingest_report"] = with_fixtures(f"""
SELECT CASE WHEN dataset_type = 'rul' THEN 'RUL' ELSE dataset_type END || '_' || dataset_id
         || '.txt' AS file_name,
       dataset_id, dataset_type, COUNT(*) AS rows, COUNT(*) FILTER (WHERE NOT ok) AS bad_rows,
       CASE WHEN COUNT(*) FILTER (WHERE NOT ok) = 0 THEN 'success'
            WHEN COUNT(*) FILTER (WHERE NOT ok) = COUNT(*) THEN 'failure'
            ELSE 'partial' END AS status
FROM (SELECT dataset_id, dataset_type, NOT {CUT_SQL} AND NOT {BAD_SQL} AS ok FROM readings
      UNION ALL SELECT dataset_id, dataset_type, TRUE FROM rul) x
GROUP BY dataset_id, dataset_type""")

ORACLE["ingest_files"] = ORACLE["ingest_report"]

ORACLE["csv_round_trip"] = with_fixtures("SELECT * FROM readings")

ORACLE["replace_ingest"] = with_fixtures(
    "SELECT dataset_id, dataset_type, COUNT(*) AS row_count FROM readings GROUP BY 1, 2")

ORACLE["table_views"] = with_fixtures("""
SELECT 'cmapss_train' AS table_name, COUNT(*) AS row_count FROM cmapss_train
UNION ALL SELECT 'cmapss_test', COUNT(*) FROM cmapss_test
UNION ALL SELECT 'cmapss_rul', COUNT(*) FROM rul""")

ORACLE["custom_sql"] = with_fixtures("""
SELECT t.dataset_id, COUNT(*) AS row_count, MAX(t.time_cycles) AS max_cycle,
       ROUND(AVG(t.sensor_11), 4) AS avg_sensor_11
FROM cmapss_train t
WHERE t.op_setting_3 <= 4 OR t.sensor_2 > 230
GROUP BY t.dataset_id
HAVING COUNT(*) > 0
ORDER BY t.dataset_id""")

ORACLE["dataset_overview"] = with_fixtures("""
SELECT COALESCE(f.dataset_id, dim.dataset_id) AS dataset_id, dim.train_engines,
       dim.test_engines, dim.operating_conditions, dim.fault_modes,
       COALESCE(f.tr, 0) AS train_engines_found, COALESCE(f.te, 0) AS test_engines_found,
       COALESCE(dim.train_engines, -1) <> COALESCE(f.tr, 0) AS train_mismatch,
       COALESCE(dim.test_engines, -1) <> COALESCE(f.te, 0) AS test_mismatch
FROM f FULL JOIN dim ON f.dataset_id = dim.dataset_id
ORDER BY 1""", extra_ctes=_dim_values() + """,
f AS (SELECT dataset_id,
             COUNT(DISTINCT CASE WHEN dataset_type = 'train' THEN unit_number END) AS tr,
             COUNT(DISTINCT CASE WHEN dataset_type = 'test' THEN unit_number END) AS te
      FROM readings GROUP BY dataset_id)""")

# ----------------------------------------------------------------------------- model
ORACLE["rul_label"] = with_fixtures(
    "SELECT dataset_id, dataset_type, unit_number, time_cycles, "
    + ", ".join(_FEATURES)
    + ", CAST(MAX(time_cycles) OVER (PARTITION BY dataset_id, dataset_type, unit_number)"
      " - time_cycles AS DOUBLE) AS rul"
    + f" FROM cmapss_train WHERE {FD1}")

# ----------------------------------------------------------------------------- more sources
ORACLE["parse_lines_dual"] = with_fixtures(f"""
SELECT dataset_id, dataset_type, CASE WHEN {CUT_SQL} THEN 20 ELSE 26 END AS n_fields,
       COUNT(*) AS lines
FROM readings GROUP BY 1, 2, 3""")

_QFLAG = {c: (CUT_SQL if c in _CUT_COLS else BAD_SQL if c == "sensor_11" else "FALSE")
          for c in RAW_COLUMNS}
ORACLE["parse_quality"] = with_fixtures(
    "SELECT dataset_id, dataset_type, column_name, bad_values FROM (SELECT dataset_id, "
    "dataset_type, "
    + ", ".join(f"CAST(SUM(CASE WHEN {f} THEN 1 ELSE 0 END) AS BIGINT) AS {c}"
                for c, f in _QFLAG.items())
    + " FROM readings GROUP BY 1, 2) w UNPIVOT (bad_values FOR column_name IN ("
    + ", ".join(RAW_COLUMNS) + "))")

ORACLE["file_metadata"] = with_fixtures("""
SELECT DISTINCT dataset_type || '_' || dataset_id || '.txt' AS file_name, dataset_id, dataset_type
FROM readings
UNION
SELECT DISTINCT 'RUL_' || dataset_id || '.txt', dataset_id, 'rul' FROM rul""")

ORACLE["data_layout"] = with_fixtures("""
SELECT dataset_id, dataset_type, COUNT(*) AS row_count, COUNT(DISTINCT unit_number) AS units,
       MIN(time_cycles) AS min_cycle, MAX(time_cycles) AS max_cycle
FROM readings GROUP BY 1, 2""")

ORACLE["dataset_dim"] = with_fixtures(
    "SELECT * FROM dim WHERE dataset_id IN (SELECT dataset_id FROM readings)",
    extra_ctes=_dim_values())

__all__ = ["ORACLE", "BAD_SQL", "CUT_SQL"]

# ----------------------------------------------------------------------------- stored changes, files
_READ_KEY = "dataset_id, dataset_type, unit_number, time_cycles"
ORACLE["unit_series_one"] = with_fixtures(
    "SELECT * FROM readings WHERE dataset_id = 'FD001' AND dataset_type = 'train' AND unit_number = 1")
ORACLE["get_dataset_limit"] = with_fixtures(
    "SELECT * FROM readings WHERE dataset_id = 'FD001' AND dataset_type = 'test' "
    "ORDER BY unit_number, time_cycles LIMIT 25")
ORACLE["update_stored"] = with_fixtures("""
SELECT dataset_id, dataset_type, COUNT(*) AS row_count,
       COUNT(*) FILTER (WHERE CASE WHEN dataset_id = 'FD001' AND dataset_type = 'train' AND unit_number = 1
                                        AND time_cycles = 1 THEN 0 ELSE sensor_11 END = 0) AS zeros
FROM readings GROUP BY 1, 2""")
ORACLE["delete_stored"] = with_fixtures("""
SELECT dataset_id, dataset_type, COUNT(*) AS row_count,
       (SELECT COUNT(*) FROM readings WHERE dataset_id = 'FD002' AND dataset_type = 'test') AS deleted_rows
FROM readings WHERE dataset_id <> 'FD002' OR dataset_type <> 'test' GROUP BY 1, 2""")
ORACLE["ingest_deliveries"] = with_fixtures(f"""
SELECT 'FD001' AS dataset_id, 'train' AS dataset_type, 'partial' AS status, COUNT(*) AS rows,
       COUNT(*) FILTER (WHERE {CUT_SQL} OR {BAD_SQL}) AS bad_rows, COUNT(*) AS stored_rows
FROM readings WHERE dataset_id = 'FD001' AND dataset_type = 'train'
UNION ALL SELECT 'FD001', 'train', 'superseded', 0, 0, COUNT(*) FROM readings WHERE dataset_id = 'FD001' AND dataset_type = 'train'
UNION ALL SELECT NULL, NULL, 'skipped', 0, 0, COUNT(*) FROM readings WHERE dataset_id = 'FD001' AND dataset_type = 'train'""")
# A label line is a whole number, one blank and the line end.
# A reading's line: its fields (20 of a cut line, one letter more in a bad one), a separator each,
# and in the blank form three blanks after the cycle and two at the end; then the line end.
_LINE_BYTES = " + ".join(
    f"CASE WHEN {CUT_SQL} THEN 0 ELSE length(CAST({c} AS VARCHAR)) + 1 END" if i >= 20
    else f"length(CAST({c} AS VARCHAR)) + 1" for i, c in enumerate(RAW_COLUMNS))
ORACLE["storage_summary"] = with_fixtures(f"""
SELECT COALESCE(area, 'TOTAL') AS area, COUNT(DISTINCT area || dataset_id) AS files, SUM(n)::BIGINT AS bytes FROM (
  SELECT dataset_type AS area, dataset_id, {_LINE_BYTES}
         + CASE WHEN {BAD_SQL} AND NOT {CUT_SQL} THEN 1 ELSE 0 END
         + CASE WHEN (unit_number + time_cycles) % 2 = 1 THEN 0 ELSE 4 END AS n FROM readings
  UNION ALL SELECT 'rul', dataset_id, length(CAST(CAST(rul AS BIGINT) AS VARCHAR)) + 2 FROM rul) f
GROUP BY ROLLUP (area)""")
ORACLE["degradation_json"] = f"""
SELECT dataset_id, dataset_type, unit_number, total_cycles, health_index, temp_hpc_pct_change
FROM ({ORACLE["degradation_metrics"]}) d"""

# ----------------------------------------------------------------------------- model
# What SQL can say of a model: which rows it takes, and that a stored one predicts as before.  Its
# errors and predictions are tested against a walk through its nodes and a known best error.
_TRAIN = "dataset_id = 'FD001' AND dataset_type = 'train'"
ORACLE["training_report"] = with_fixtures(f"""
SELECT COUNT(*) AS training_rows, CAST(0 AS BIGINT) AS left_out FROM readings WHERE {_TRAIN}""")
ORACLE["model_io"] = with_fixtures(f"SELECT {_READ_KEY}, TRUE AS agree FROM readings WHERE {_TRAIN}")
