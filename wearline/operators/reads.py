"""Point reads, previews and changes of the readings table.

Reads are lazy filters on the partition columns (pruned at the scan) plus an explicit
total order.  Changes never rewrite a table in place: they return the changed table as a
new DataFrame (a join or a conditional projection), which the caller writes to a new
location or, with ``sources.ingest.replace_ingest``, over the touched partitions only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.functions.joins import attach_one_row
from wearline.operators.common import subset
from wearline.schema import READING_COLUMNS

ROW_KEY = ["dataset_id", "dataset_type", "unit_number", "time_cycles"]
# Explicit preference when a change names no data-set type (train before test).
TYPE_ORDER = {"train": 0, "test": 1, "rul": 2}


def _type_rank(c: Column) -> Column:
    out = F
    for name, rank in TYPE_ORDER.items():
        out = out.when(c == name, F.lit(rank))
    return out.otherwise(F.lit(len(TYPE_ORDER)))


def get_dataset(readings: DataFrame, dataset_id: str | None = None,
                dataset_type: str | None = None, unit_number: int | None = None,
                limit: int | None = None) -> DataFrame:
    """Optional equality filters, ordered by unit and cycle (type as tie-break), optional
    limit."""
    df = subset(readings, dataset_id, dataset_type)
    if unit_number is not None:
        df = df.where(F.col("unit_number") == unit_number)
    df = df.orderBy("dataset_id", "unit_number", "time_cycles", "dataset_type")
    return df.limit(limit) if limit is not None else df


def sample_rows(readings: DataFrame, dataset_id: str = "FD001", dataset_type: str = "train",
                limit: int = 5) -> DataFrame:
    """A few rows of one data set (the first by key, so the sample is deterministic).

    ``orderBy().limit()`` plans as a top-k (``TakeOrderedAndProject``): each task keeps
    ``limit`` rows, nothing else is shuffled.
    """
    return subset(readings, dataset_id, dataset_type).orderBy(
        "unit_number", "time_cycles").limit(limit)


def unit_series(readings: DataFrame, unit_number: int | None = None,
                dataset_id: str = "FD001", dataset_type: str = "train") -> DataFrame:
    """A unit's full series by cycle (every unit's, in unit order, when ``unit_number`` is
    None)."""
    df = subset(readings, dataset_id, dataset_type)
    if unit_number is not None:
        df = df.where(F.col("unit_number") == unit_number)
    return df.orderBy("unit_number", "time_cycles")


def training_scan(readings: DataFrame, dataset_id: str = "FD001",
                  dataset_type: str = "train") -> DataFrame:
    """Full scan of one data set and type; training needs no order, so none is made."""
    return subset(readings, dataset_id, dataset_type)


def update_sensor_data(readings: DataFrame, dataset_id: str, unit_number: int,
                       time_cycles: int, updates: Mapping[str, object],
                       dataset_type: str | None = None) -> DataFrame:
    """Set columns of the one reading with this key; returns the whole changed table.

    Without ``dataset_type`` the match is the reading of the first type in ``TYPE_ORDER``
    that has the key (train before test): a one-row aggregate over the matching rows,
    attached as a scalar subquery, never decided on the driver.
    """
    key = ((F.col("dataset_id") == dataset_id) & (F.col("unit_number") == unit_number)
           & (F.col("time_cycles") == time_cycles))
    if dataset_type is not None:
        df = readings.withColumn("_hit", key & (F.col("dataset_type") == dataset_type))
    else:
        best = readings.where(key).agg(F.min(_type_rank(F.col("dataset_type"))).alias("_best"))
        df = attach_one_row(readings, best).withColumn(
            "_hit", key & (_type_rank(F.col("dataset_type")) == F.col("_best")))
    out = df.select(*[
        F.when(F.col("_hit"), F.lit(updates[c]).cast(df.schema[c].dataType))
        .otherwise(F.col(c)).alias(c) if c in updates else F.col(c)
        for c in readings.columns])
    return out


def _one_per_key(updates: DataFrame, null_means_keep: bool) -> DataFrame:
    """Updates reduced to one row per key: each column's greatest non-NULL value, or with
    ``null_means_keep=False`` NULL if any of the key's rows says NULL."""
    cols = [c for c in updates.columns if c not in ROW_KEY]
    aggs = []
    for c in cols:
        best = F.max(c)
        if not null_means_keep:
            best = F.when(F.count_if(F.col(c).isNull()) == 0, best)
        aggs.append(best.alias(f"_new_{c}"))
    return updates.groupBy(*ROW_KEY).agg(*aggs, F.lit(True).alias("_hit"))


def apply_updates(readings: DataFrame, updates: DataFrame, null_means_keep: bool = True) -> DataFrame:
    """Bulk form: ``updates`` holds the row key and the columns to set.

    NULL keeps the stored value; with ``null_means_keep=False`` it is set.  A left join on
    the full key.  Updates are first reduced to one row per key (if a key appears twice, the
    greatest non-NULL value of each column wins), so the table never gains rows.  AQE picks
    the join strategy from the measured size of the updates (broadcast below its threshold,
    else a shuffle join with skew splitting).
    """
    cols = [c for c in updates.columns if c not in ROW_KEY]
    joined = readings.join(_one_per_key(updates, null_means_keep), ROW_KEY, "left")

    def new(c: str) -> Column:
        if null_means_keep:
            return F.coalesce(F.col(f"_new_{c}"), F.col(c))
        return F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c))

    return joined.select(*[new(c).alias(c) if c in cols else F.col(c) for c in readings.columns])


def update_report(readings: DataFrame, updates: DataFrame) -> DataFrame:
    """Matched and modified row counts of a bulk update (one row; updates reduced to one
    row per key as in ``apply_updates``)."""
    cols = [c for c in updates.columns if c not in ROW_KEY]
    upd = updates.groupBy(*ROW_KEY).agg(*[F.max(c).alias(f"_new_{c}") for c in cols])
    j = readings.join(upd, ROW_KEY, "inner")
    changed = F.lit(False)
    for c in cols:
        changed = changed | (F.col(f"_new_{c}").isNotNull()
                             & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)))
    return j.agg(F.count(F.lit(1)).alias("matched_count"),
                 F.count_if(changed).alias("modified_count"))


def write_changes(changed: DataFrame, table_path: str, dataset_id: str,
                  dataset_type: str | None = None, stage_path: str | None = None) -> DataFrame:
    """Store a changed table back over the partitions of one data set (and type).

    The changed rows usually come from a plan that reads ``table_path`` itself, and Spark
    cannot overwrite a path it is reading in the same job.  So the touched partitions are
    first written to a staging folder of their own below the session's shared folder, then
    swapped in with the idempotent partition replace (``sources.ingest.replace_ingest``);
    all other partitions are left as they are.  The staging folder is removed afterwards.
    Returns rows written per partition.
    """
    import uuid

    from wearline.session import join_path, scratch_dir
    from wearline.sources.ingest import replace_ingest

    spark = changed.sparkSession
    stage = stage_path or join_path(scratch_dir(spark), "wearline-stage", uuid.uuid4().hex)
    touched = changed.where(F.col("dataset_id") == dataset_id)
    if dataset_type is not None:
        touched = touched.where(F.col("dataset_type") == dataset_type)
    touched.select(*READING_COLUMNS).write.mode("overwrite").parquet(stage)
    replace_ingest(spark.read.parquet(stage), table_path)  # the write is eager
    if stage_path is None:  # our own staging folder: remove it once the swap is written
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(stage)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return subset(spark.read.parquet(table_path), dataset_id, dataset_type).groupBy(
        "dataset_id", "dataset_type").agg(F.count(F.lit(1)).alias("inserted_rows"))


def delete_dataset(readings: DataFrame, dataset_id: str,
                   dataset_type: str | None = None) -> DataFrame:
    """The table without the rows of one data set (and type): an anti-filter.  Stored
    tables drop the partition folder instead (``sources.ingest.delete_partitions``)."""
    cond = F.col("dataset_id") == dataset_id
    if dataset_type is not None:
        cond = cond & (F.col("dataset_type") == dataset_type)
    return readings.where(~cond)


def deleted_count(readings: DataFrame, dataset_id: str,
                  dataset_type: str | None = None) -> DataFrame:
    """Rows a delete would remove (one row, computed on the pruned partitions)."""
    return subset(readings, dataset_id, dataset_type).agg(
        F.count(F.lit(1)).alias("deleted_count"))


__all__ = ["get_dataset", "sample_rows", "unit_series", "training_scan", "update_sensor_data",
           "apply_updates", "update_report", "write_changes", "delete_dataset", "deleted_count",
           "READING_COLUMNS", "ROW_KEY"]
