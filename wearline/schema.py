"""Table schemas, column lists and the small fixed dimension tables.

Everything here is a constant; operators take these as default arguments so that
they also work on any other wide sensor table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results).
# Column order of a raw reading line: unit, cycle, three settings, 21 sensors.
# ---------------------------------------------------------------------------
KEY_COLUMNS = ["unit_number", "time_cycles"]
SETTING_COLUMNS = ["op_setting_1", "op_setting_2", "op_setting_3"]
SENSOR_COLUMNS = [f"sensor_{i}" for i in range(1, 22)]
RAW_COLUMNS = KEY_COLUMNS + SETTING_COLUMNS + SENSOR_COLUMNS  # 26 positional fields
META_COLUMNS = ["dataset_id", "dataset_type"]
READING_COLUMNS = RAW_COLUMNS + META_COLUMNS  # 28 columns
FEATURE_COLUMNS = SETTING_COLUMNS + SENSOR_COLUMNS  # 24 model / summary features
SERIES_KEY = ["dataset_id", "dataset_type", "unit_number"]

# What the columns measure, with units; kept as column comments of the readings.
COLUMN_COMMENTS = {
    "unit_number": "Engine Unit ID",
    "time_cycles": "Operational Cycle (Time)",
    "op_setting_1": "Operational Setting 1 (Altitude)",
    "op_setting_2": "Operational Setting 2 (Mach Number)",
    "op_setting_3": "Operational Setting 3 (Throttle Resolver Angle)",
    "sensor_1": "Total temperature at fan inlet (°R)",
    "sensor_2": "Total temperature at LPC outlet (°R)",
    "sensor_3": "Total temperature at HPC outlet (°R)",
    "sensor_4": "Total temperature at LPT outlet (°R)",
    "sensor_5": "Pressure at fan inlet (psia)",
    "sensor_6": "Total pressure in bypass-duct (psia)",
    "sensor_7": "Total pressure at HPC outlet (psia)",
    "sensor_8": "Physical fan speed (rpm)",
    "sensor_9": "Physical core speed (rpm)",
    "sensor_10": "Engine pressure ratio (P50/P2)",
    "sensor_11": "Static pressure at HPC outlet (psia)",
    "sensor_12": "Ratio of fuel flow to Ps30 (pps/psi)",
    "sensor_13": "Corrected fan speed (rpm)",
    "sensor_14": "Corrected core speed (rpm)",
    "sensor_15": "Bypass Ratio",
    "sensor_16": "Burner fuel-air ratio",
    "sensor_17": "Bleed Enthalpy",
    "sensor_18": "Demanded fan speed (rpm)",
    "sensor_19": "Demanded corrected fan speed (rpm)",
    "sensor_20": "HPT coolant bleed (lbm/s)",
    "sensor_21": "LPT coolant bleed (lbm/s)",
}

# The eleven sensors the reference treats as critical for health monitoring.
CRITICAL_SENSORS = [
    "sensor_2", "sensor_3", "sensor_4", "sensor_7", "sensor_8",
    "sensor_9", "sensor_11", "sensor_12", "sensor_13", "sensor_14", "sensor_15",
]

# Data-set metadata
# (name, train_engines, test_engines, operating_conditions, fault_modes, description).
DATASET_METADATA = [
    ("FD001", 100, 100, 1, 1, "Single operating condition, single fault mode (HPC degradation)"),
    ("FD002", 260, 259, 6, 1, "Six operating conditions, single fault mode (HPC degradation)"),
    ("FD003", 100, 100, 1, 2, "Single operating condition, two fault modes (HPC & Fan degradation)"),
    ("FD004", 248, 249, 6, 2, "Six operating conditions, two fault modes (HPC & Fan degradation)"),
]

# Sensors of the degradation job, by intended meaning (see README, fault F4).
DEGRADATION_SENSORS = {
    "temp_hpc": "sensor_3",
    "pressure_hpc": "sensor_11",
    "fan_speed": "sensor_8",
    "core_speed": "sensor_9",
    "fuel_ratio": "sensor_12",
}
# The same job as literally written, positions 4, 12, 9, 10, 13 of a line.
DEGRADATION_SENSORS_LITERAL = {
    "temp_hpc": "op_setting_3",
    "pressure_hpc": "sensor_8",
    "fan_speed": "sensor_5",
    "core_speed": "sensor_6",
    "fuel_ratio": "sensor_9",
}


def _field(name: str, dtype: T.DataType) -> T.StructField:
    comment = COLUMN_COMMENTS.get(name)
    return T.StructField(name, dtype, True, {"comment": comment} if comment else None)


RAW_SCHEMA = T.StructType(
    [_field(c, T.IntegerType()) for c in KEY_COLUMNS]
    + [_field(c, T.DoubleType()) for c in SETTING_COLUMNS + SENSOR_COLUMNS]
)
READINGS_SCHEMA = T.StructType(
    RAW_SCHEMA.fields + [_field(c, T.StringType()) for c in META_COLUMNS]
)
RUL_SCHEMA = T.StructType(
    [
        T.StructField("rul", T.DoubleType(), True),
        T.StructField("dataset_id", T.StringType(), True),
        T.StructField("dataset_type", T.StringType(), True),
    ]
)
DATASET_DIM_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType(), False),
        T.StructField("train_engines", T.IntegerType(), False),
        T.StructField("test_engines", T.IntegerType(), False),
        T.StructField("operating_conditions", T.IntegerType(), False),
        T.StructField("fault_modes", T.IntegerType(), False),
        T.StructField("description", T.StringType(), False),
    ]
)


def dataset_dim(spark: SparkSession) -> DataFrame:
    """The four-row metadata dimension (fixed size: safe to broadcast)."""
    return spark.createDataFrame(DATASET_METADATA, DATASET_DIM_SCHEMA)
