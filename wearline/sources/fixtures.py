"""Map the driver's tables onto the sensor data model.

The driver tables hold no sensor data, so ``readings`` is derived from ``lineitem`` (and the
label table ``rul`` from ``orders``) by a fixed rule that is written identically in the DuckDB
oracle (``wearline.plans.oracle``).  Raw text lines for the parsers and the jobs are rendered
from ``readings`` by Spark, with deterministic faults injected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.functions.series import block_row_number
from wearline.schema import RAW_COLUMNS, READING_COLUMNS
from wearline.sources.ingest import writer_count

# Fixed values of the fixture rule (shared with the oracle SQL).
DATASET_BY_RETURNFLAG = {"A": "FD001", "R": "FD002"}  # every other flag -> FD003
RUL_DATASET_BY_STATUS = {"O": "FD001", "F": "FD002", "P": "FD003"}
CUT_MODULUS = 97  # lines with (7*unit + cycle) % 97 == 0 are cut after CUT_FIELDS fields
CUT_FIELDS = 20
BAD_MODULUS = 89  # other lines with (7*unit + cycle) % 89 == 0 carry a letter in sensor_11
BAD_FIELD = 15


def sensor_formula(i: int, q: Column, p: Column, cycles: Column) -> Column:
    """Synthetic sensor i (2..21); the operation order matters for bit-equal results."""
    base = F.lit(float(100 * i)) + q * (i % 5 + 1) / 8 + p / (1024 * (1 + i % 3))
    drift = cycles.cast("double") / (16 * (1 + i % 4))
    return base - drift if i % 2 == 1 else base + drift


# Bytes of lineitem's files whose rows one task numbers: about 600,000, of 300 bytes in memory.
NUMBER_BYTES = 8 << 20


def readings_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """28-column readings table; series = (return flag, line status, supplier).

    ``time_cycles`` is the row number inside the series in (ship date, order, line, part)
    order, computed per ship year so that a supplier holding a large share of the
    table is never sorted by one task (``functions.series.block_row_number``).  The result is
    in ranges of (data set, type, unit) and sorted so (``data_layout(ordered=True)``): only the
    few columns that the sensors derive from are shuffled, once.
    """
    dataset_id = F
    for flag, ds in DATASET_BY_RETURNFLAG.items():
        dataset_id = dataset_id.when(F.col("l_returnflag") == flag, ds)
    narrow = lineitem.select(
        dataset_id.otherwise("FD003").alias("dataset_id"),
        F.when(F.col("l_linestatus") == "F", "train").otherwise("test").alias("dataset_type"),
        "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_orderkey", "l_linenumber",
        "l_partkey", "l_discount", "l_tax", "l_quantity", "l_extendedprice")
    b = block_row_number(
        narrow, ["dataset_id", "dataset_type", "l_suppkey", "l_returnflag", "l_linestatus"],
        ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"], F.year("l_shipdate"),
        name="_cycle", partitions=writer_count(narrow, NUMBER_BYTES)).select(
        F.col("l_suppkey").cast("int").alias("unit_number"),
        F.col("_cycle").cast("int").alias("time_cycles"),
        (F.col("l_discount") * 100 + 0.0).alias("op_setting_1"),
        (F.col("l_tax") * 10 + 0.0).alias("op_setting_2"),
        F.col("l_linenumber").cast("double").alias("op_setting_3"),
        F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("p"),
        "dataset_id", "dataset_type",
    )
    q, p, tc = F.col("q"), F.col("p"), F.col("time_cycles")
    sensors = [F.lit(518.5).alias("sensor_1")] + [
        sensor_formula(i, q, p, tc).alias(f"sensor_{i}") for i in range(2, 22)]
    return b.select("unit_number", "time_cycles", "op_setting_1", "op_setting_2",
                    "op_setting_3", *sensors, "dataset_id", "dataset_type")


def rul_from_orders(orders: DataFrame) -> DataFrame:
    """Label table (rul, dataset_id, dataset_type='rul')."""
    ds = F
    for status, name in RUL_DATASET_BY_STATUS.items():
        ds = ds.when(F.col("o_orderstatus") == status, name)
    return orders.select(
        F.floor(F.col("o_totalprice") / 2500).cast("double").alias("rul"),
        ds.alias("dataset_id"),
        F.lit("rul").alias("dataset_type"),
    )


def fault_flags(unit: str = "unit_number", cycle: str = "time_cycles"):
    h = F.col(unit) * 7 + F.col(cycle)
    cut = F.pmod(h, F.lit(CUT_MODULUS)) == 0
    bad = (~cut) & (F.pmod(h, F.lit(BAD_MODULUS)) == 0)
    return cut, bad


def source_name(kind: Column, dataset_id: Column) -> Column:
    """File name of a series: train_FD001.txt, test_FD001.txt, RUL_FD001.txt."""
    prefix = F.when(kind == "rul", F.lit("RUL")).otherwise(kind)
    return F.concat(prefix, F.lit("_"), dataset_id, F.lit(".txt"))


def raw_lines(readings: DataFrame, style: str = "mixed", faults: bool = True) -> DataFrame:
    """Render readings as raw text lines ``(source, value)``.

    ``style='blank'``: blank-separated with a triple blank after the cycle and two trailing
    blanks (raw file form); ``'comma'``: comma-separated (processed CSV form); ``'mixed'``:
    every line with odd ``unit + cycle`` is comma-separated, the others blank-separated.
    With ``faults``, cut lines keep only 20 fields and bad lines carry ``x`` before sensor_11.
    """
    if style not in ("mixed", "comma", "blank"):
        raise ValueError(f"unknown line style {style!r}")
    cut, bad = fault_flags() if faults else (F.lit(False), F.lit(False))
    fields = [F.col(c).cast("string") for c in RAW_COLUMNS]
    fields[BAD_FIELD] = F.when(bad, F.concat(F.lit("x"), fields[BAD_FIELD])).otherwise(
        fields[BAD_FIELD])
    full_blank = F.concat(fields[0], F.lit(" "), fields[1], F.lit("   "),
                          F.concat_ws(" ", *fields[2:]), F.lit("  "))
    cut_blank = F.concat(fields[0], F.lit(" "), fields[1], F.lit("   "),
                         F.concat_ws(" ", *fields[2:CUT_FIELDS]), F.lit("  "))
    full_comma = F.concat_ws(",", *fields)
    cut_comma = F.concat_ws(",", *fields[:CUT_FIELDS])
    comma = {"mixed": F.pmod(F.col("unit_number") + F.col("time_cycles"), F.lit(2)) == 1,
             "comma": F.lit(True), "blank": F.lit(False)}[style]
    value = (F.when(comma & cut, cut_comma).when(comma, full_comma)
             .when(cut, cut_blank).otherwise(full_blank))
    return readings.select(
        source_name(F.col("dataset_type"), F.col("dataset_id")).alias("source"),
        value.alias("value"),
    )


def rul_lines(rul: DataFrame) -> DataFrame:
    """Label lines as in the label files: a whole number and one trailing blank."""
    return rul.select(
        source_name(F.lit("rul"), F.col("dataset_id")).alias("source"),
        F.concat(F.col("rul").cast("bigint").cast("string"), F.lit(" ")).alias("value"),
    )


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


__all__ = ["readings_from_lineitem", "rul_from_orders", "raw_lines", "rul_lines",
           "fault_flags", "load_table", "READING_COLUMNS"]
