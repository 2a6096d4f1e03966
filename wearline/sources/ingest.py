"""Sinks: the partitioned Parquet layout, idempotent replace-ingest, views, ingest report."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearline.functions.quantiles import attach_groups
from wearline.schema import META_COLUMNS, RAW_COLUMNS, READING_COLUMNS
from wearline.session import join_path, own_splits, remove_path, scratch_dir
from wearline.sources.text import (FILE_NAME_PATTERN, file_metadata, parse_head, parse_readings, parse_rul,
                                   read_lines, whole_number)

PARTITION_COLUMNS = META_COLUMNS  # dataset_id, dataset_type
SORT_COLUMNS = ["unit_number", "time_cycles"]


# Target amount of (estimated) data per writer task of the layout: its rows are two to three times
# as large in memory and are sorted there without spilling.  Files inside a writer are cut by
# ``maxRecordsPerFile``.
TARGET_WRITE_BYTES = 1 << 28
# Of stored readings: doubles of high entropy, where zstd takes less space than the default.
COMPRESSION = "zstd"


def writer_count(df: DataFrame, target_bytes: int = TARGET_WRITE_BYTES) -> int:
    """Number of writer tasks: the optimizer's size estimate of ``df`` (file sizes for scans)
    divided by ``target_bytes``, at least the shuffle-partition setting.  A frame without an
    estimate (not read from files) gets that setting."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return base if size >= 1 << 60 else max(base, -(-size // target_bytes))


def _layout_frame(df: DataFrame, partitions: int | None) -> DataFrame:
    """Cluster rows by (data set, type, unit, cycle) and sort them inside each file.

    Range partitioning on the whole row key (boundaries from a sample) gives every writer
    a contiguous key range of about equal size: a large data set or a very long unit is
    spread over many writers, and each file covers a narrow unit range, which keeps the
    Parquet min/max statistics selective for unit filters.  The writer count follows the
    input size (``writer_count``).
    """
    n = partitions or writer_count(df)
    return _sorted_in_tasks(df.repartitionByRange(n, *PARTITION_COLUMNS, *SORT_COLUMNS))


def _sorted_in_tasks(df: DataFrame) -> DataFrame:
    return df.sortWithinPartitions(*PARTITION_COLUMNS, *SORT_COLUMNS)


def data_layout(df: DataFrame, path: str, partitions: int | None = None,
                mode: str = "overwrite", max_records_per_file: int = 5_000_000,
                ordered: bool = False, ranged: bool = False) -> None:
    """Write readings as Parquet partitioned by data set and type, sorted by unit and cycle.

    ``ordered`` says that ``df`` already lies in ranges of that order, sorted inside: its wide
    rows are then written without another shuffle.  ``ranged`` is as in ``replace_ingest``.

    Partition pruning serves data-set filters; min/max statistics of the sorted files serve
    unit filters (the access paths of the reference's compound indexes).
    """
    rows = df.select(*READING_COLUMNS)
    laid = rows if ordered else _sorted_in_tasks(rows) if ranged else _layout_frame(rows, partitions)
    (laid.write.mode(mode)
     .option("compression", COMPRESSION)
     .option("partitionOverwriteMode", "static")  # full rewrite; writes the _SUCCESS marker
     .option("maxRecordsPerFile", max_records_per_file)
     .partitionBy(*PARTITION_COLUMNS).parquet(path))


def replace_ingest(df: DataFrame, path: str, partitions: int | None = None,
                   max_records_per_file: int = 5_000_000, ranged: bool = False) -> DataFrame:
    """Idempotent load: the (dataset_id, dataset_type) partitions present in ``df`` are
    replaced, all other partitions stay (dynamic partition overwrite).

    ``ranged`` says that every task of ``df`` holds a range of units of its own: rows are then
    sorted where they are, without a shuffle.

    Returns the number of rows written per partition (computed from the written files).
    """
    spark = df.sparkSession
    rows = df.select(*READING_COLUMNS)
    laid = _sorted_in_tasks(rows) if ranged else _layout_frame(rows, partitions)
    (laid.write.mode("overwrite")
     .option("compression", COMPRESSION)
     .option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", max_records_per_file)
     .partitionBy(*PARTITION_COLUMNS).parquet(path))
    touched = df.select(*PARTITION_COLUMNS).distinct()
    return (spark.read.parquet(path).join(touched, PARTITION_COLUMNS, "left_semi")
            .groupBy(*PARTITION_COLUMNS).agg(F.count(F.lit(1)).alias("inserted_rows")))


def delete_partitions(spark: SparkSession, path: str, dataset_id: str,
                      dataset_type: str | None = None) -> int:
    """Physical delete: drop the partition folder(s) of one data set (and type).

    Returns the number of rows deleted (counted from the folders before removal, a
    metadata-light count of the pruned partitions).
    """
    from wearline.session import join_path

    cond = F.col("dataset_id") == dataset_id
    if dataset_type:
        cond = cond & (F.col("dataset_type") == dataset_type)
    deleted = spark.read.parquet(path).where(cond).count()
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    types = [dataset_type] if dataset_type else None
    root = jvm.org.apache.hadoop.fs.Path(join_path(path, f"dataset_id={dataset_id}"))
    fs = root.getFileSystem(conf)
    if types is None:
        fs.delete(root, True)
    else:
        for t in types:
            fs.delete(jvm.org.apache.hadoop.fs.Path(join_path(str(root), f"dataset_type={t}")),
                      True)
    return deleted


def table_views(spark: SparkSession, readings: DataFrame, rul: DataFrame | None = None,
                prefix: str = "cmapss") -> dict[str, DataFrame]:
    """Register ``cmapss_train``, ``cmapss_test`` and ``cmapss_rul`` as session views."""
    views = {
        f"{prefix}_train": readings.where(F.col("dataset_type") == "train"),
        f"{prefix}_test": readings.where(F.col("dataset_type") == "test"),
    }
    if rul is not None:
        views[f"{prefix}_rul"] = rul
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return views


def view_counts(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Row count of each registered view, as one small table."""
    parts = [spark.table(n).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(n).alias("table_name"), "row_count") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def deliveries(spark: SparkSession, raw_path: str | list[str]) -> DataFrame:
    """One row per delivered file below ``raw_path``: path, name, data set, type, bytes, time
    and ``state``: ``newest`` (the delivery of its data set and type that counts), ``older``,
    or ``skipped`` (the name is none of ``train_/test_/RUL_<id>.txt``).

    A file may be a folder of part files; they are one delivery.  Of two deliveries of the
    same name the later modification time wins, then the greater path.  Only the listing is
    read, no content; Spark's readers do not list files of zero bytes."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(raw_path)
             .select("path", "modificationTime", "length"))
    dsid, dtype = file_metadata(F.col("path"))
    part = F.regexp_extract("path", FILE_NAME_PATTERN, 1)
    root = F.when(part == "", F.col("path")).otherwise(
        F.regexp_extract("path", r"^((?:.*/)?(?:source=)?(?:train|test|RUL)_FD[0-9]+\.txt)(?:/[^/]+)?$", 1))
    named = files.select(root.alias("delivery"), dsid.alias("dataset_id"), dtype.alias("dataset_type"),
                         "modificationTime", "length")
    per = named.groupBy("delivery", "dataset_id", "dataset_type").agg(
        F.max("modificationTime").alias("modified"), F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
    # One row per data set and type; skipped files have neither and join with nothing.
    newest = (per.where(F.col("dataset_id").isNotNull()).groupBy(F.col("dataset_id").alias("_id"), F.col("dataset_type").alias("_type"))
              .agg(F.max_by("delivery", F.struct("modified", "delivery")).alias("_newest")))
    found = per.join(newest, (per.dataset_id == F.col("_id")) & (per.dataset_type == F.col("_type")), "left")
    return found.select(*per.columns, F.when(F.col("_newest").isNull(), "skipped")
                        .when(F.col("delivery") == F.col("_newest"), "newest").otherwise("older").alias("state"))


def ingest_report(found: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per delivered file: name, data set, type, rows, bad rows and status.

    ``success`` (every line parsed), ``partial``, ``failure`` (no line parsed), ``superseded`` by a newer delivery, or ``skipped`` for its name.  ``counts`` has
    ``dataset_id, dataset_type, rows, bad_rows`` of the loaded files."""
    name = F.regexp_replace(F.element_at(F.split("delivery", "/"), -1), "^source=", "")
    used = F.col("state") == "newest"
    j = attach_groups(found, counts, ["dataset_id", "dataset_type"])
    rows, bad = F.coalesce("rows", F.lit(0)), F.coalesce("bad_rows", F.lit(0))
    status = (F.when(F.col("state") == "skipped", "skipped").when(F.col("state") == "older", "superseded")
              .when(bad == rows, "failure").when(bad == 0, "success").otherwise("partial"))
    return j.select(name.alias("file_name"), "dataset_id", "dataset_type", F.when(used, rows).alias("rows"),
                    F.when(used, bad).alias("bad_rows"), status.alias("status"))


def report_counts(loaded: DataFrame) -> DataFrame:
    """Rows and rows with a parse problem per data set and type (``parse_ok`` if present)."""
    ok = F.col("parse_ok") if "parse_ok" in loaded.columns else F.lit(True)
    return loaded.groupBy("dataset_id", "dataset_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~ok).alias("bad_rows"))


# Smaller files than this, on average, are put together by the range shuffle.
SMALL_FILE_BYTES = 8 << 20


def unit_ranges(lines: DataFrame) -> DataFrame:
    """``task_ranges`` of raw lines by data set and type of their file.  Only the first field of a
    line is parsed."""
    dsid, dtype = file_metadata(F.col("source"))
    return task_ranges(parse_head(lines, 1).select(
        dsid.alias("dataset_id"), dtype.alias("dataset_type"), whole_number(F.col("fields"), 0).alias("unit")))


def in_unit_ranges(readings: DataFrame) -> bool:
    """Whether every task that reads ``readings`` holds a range of units of its own, as those of a
    stored layout do (within ``own_splits``).  Only the key columns are read."""
    found = task_ranges(readings.select(*PARTITION_COLUMNS, F.col("unit_number").alias("unit")))
    return found.where("overlaps > 0").isEmpty()


def task_ranges(units: DataFrame) -> DataFrame:
    """Per data set and type with any row: ``rows``, and ``overlaps``, the number of tasks whose
    units reach below those of a task before (0: every task holds a range of units of its own; a
    unit may go on in the next)."""
    tasks = units.withColumn("task", F.spark_partition_id()).groupBy(*PARTITION_COLUMNS, "task").agg(
        F.count(F.lit(1)).alias("n"), F.min("unit").alias("low"), F.max("unit").alias("high"))
    before = Window.partitionBy(*PARTITION_COLUMNS).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    return tasks.withColumn("over", F.max("high").over(before) > F.col("low")).groupBy(*PARTITION_COLUMNS).agg(
        F.sum("n").alias("rows"), F.count_if("over").alias("overlaps"))


def _load_readings(spark: SparkSession, paths: list[str], files: int, size: int, table_path: str) -> DataFrame:
    """Load reading files into ``table_path``; rows and bad rows per data set and type.

    Files that lie in unit order, as they are delivered, are parsed into the table straight: a
    task sorts the split it reads, nothing is shuffled or staged.  Others, and many small files, are
    parsed once into a staging folder, from which the range sample, the layout and the counts
    are taken, and which is removed afterwards."""
    lines = read_lines(spark, paths)
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if files <= max(4 * base, size // SMALL_FILE_BYTES):
        with own_splits(spark, size):
            ranges = kept_rows(unit_ranges(lines))
            if ranges.where("overlaps > 0").isEmpty():
                replace_ingest(parse_readings(lines), table_path, ranged=True)
                valid = F.lit(True)
                for c in RAW_COLUMNS:
                    valid = valid & F.col(c).isNotNull()
                loaded = spark.read.parquet(table_path).join(F.broadcast(ranges), PARTITION_COLUMNS, "left_semi")
                return kept_rows(report_counts(loaded.select(*PARTITION_COLUMNS, valid.alias("parse_ok"))))
    stage = join_path(scratch_dir(spark), "wearline-stage", uuid.uuid4().hex)
    parse_readings(lines).drop("source").write.option("compression", COMPRESSION).parquet(stage)
    staged = spark.read.parquet(stage)
    counts = kept_rows(report_counts(staged))
    replace_ingest(staged, table_path)
    remove_path(spark, stage)
    return counts


def ingest_files(spark: SparkSession, raw_path: str | list[str], table_path: str,
                 labels_path: str | None = None, only: set[tuple[str, str]] | None = None,
                 report_path: str | None = None) -> DataFrame:
    """The whole ingest over a folder (or glob, or list) of raw files, eagerly; returns the
    report, one row per delivered file.

    The report is appended to the table ``report_path`` (by default below the shared folder)
    under the number of this run, written by tasks and read back from there, however many
    files were delivered; ``ingest_reports`` reads the runs before.

    The newest delivery of each file replaces its (data set, type) partition of
    ``table_path``, label files that of ``labels_path`` (ignored without one).  ``only``
    restricts the load to some (data set, type) pairs.  Readings and labels are told apart by
    file before any line is read."""
    report_path = report_path or join_path(scratch_dir(spark), "wearline-ingest-reports")
    run = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    # The listing is taken once: files that arrive meanwhile belong to the next run.
    listing = join_path(scratch_dir(spark), "wearline-stage", uuid.uuid4().hex)
    deliveries(spark, raw_path).write.parquet(listing)
    found = spark.read.parquet(listing)
    # One row per data set and type, whatever the number of files and lines.
    newest = [r for r in found.where("state = 'newest'").collect()
              if only is None or (r["dataset_id"], r["dataset_type"]) in only]
    counts = spark.createDataFrame([], "dataset_id string, dataset_type string, rows long, bad_rows long")
    used = [r for r in newest if r["dataset_type"] != "rul"]
    if used:
        counts = counts.unionByName(_load_readings(
            spark, [r["delivery"] for r in used], sum(r["files"] for r in used), sum(r["bytes"] for r in used), table_path))
    paths = [r["delivery"] for r in newest if r["dataset_type"] == "rul"]
    if paths and labels_path is not None:
        labels = parse_rul(read_lines(spark, paths))
        (labels.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("dataset_id").parquet(labels_path))
        stored = spark.read.parquet(labels_path).where(F.col("dataset_id").isin([r["dataset_id"] for r in newest]))
        counts = counts.unionByName(kept_rows(report_counts(stored.select(
            "dataset_id", F.lit("rul").alias("dataset_type"), F.col("rul").isNotNull().alias("parse_ok")))))
    ingest_report(found, counts).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(report_path)
    remove_path(spark, listing)
    return ingest_reports(spark, report_path).where(F.col("run") == run).drop("run")


REPORT = "file_name string, dataset_id string, dataset_type string, rows long, bad_rows long, status string, run string"


def ingest_reports(spark: SparkSession, report_path: str) -> DataFrame:
    """The reports of all runs, one row per delivered file and ``run`` (a time and a random part)."""
    return spark.read.schema(REPORT).parquet(report_path)


def kept_rows(df: DataFrame) -> DataFrame:
    """A result of few rows (one per data set and type) taken out of its plan, so that its
    input may be removed."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def ingest_lines(lines: DataFrame, table_path: str) -> None:
    """Ingest raw reading lines ``(source, value)`` from any reader, eagerly: they replace
    their (data set, type) partitions of ``table_path``."""
    replace_ingest(parse_readings(lines).where(F.col("dataset_type").isin("train", "test")), table_path)
