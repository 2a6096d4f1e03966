"""Tables of one scale-factor folder: the driver's Parquet files mapped to the data model.

``readings`` is built once per folder by Spark and stored in the session's shared scratch
folder (``spark.checkpoint.dir``) with the layout of ``sources.ingest.data_layout``:
Parquet partitioned by data set and type, sorted by unit and cycle.  Every query then reads
that table, so data-set filters prune partitions and the lineage is cut at the ingest.
"""

from __future__ import annotations

import hashlib
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.session import join_path, open_writers, path_exists, publish, remove_path, scratch_dir
from wearline.sources.fixtures import load_table, readings_from_lineitem, rul_from_orders
from wearline.sources.ingest import data_layout

_LAYOUTS: dict[tuple, str] = {}
# One build at a time per process: callers on several threads must not overwrite the same
# folder concurrently (each build is idempotent and skipped once its marker exists).
BUILD_LOCK = threading.RLock()
# Table DataFrames per (session, folder[, kind]): the file listing is done once.
_FRAMES: dict[tuple, DataFrame] = {}
# Part of every stored path: raise it when the derivation of a stored table changes.
LAYOUT_VERSION = "4"


_FINGERPRINTS: dict[tuple, str] = {}


def _fingerprint(sf_dir: str, spark: SparkSession) -> str:
    """Key of a table folder: layout version, path, and path, size and time of every file of
    the tables that the stored ones derive from.  Computed once per session and folder."""
    cache_key = (spark.sparkContext.applicationId, sf_dir)
    if cache_key not in _FINGERPRINTS:
        _FINGERPRINTS[cache_key] = _compute_fingerprint(sf_dir, spark)
    return _FINGERPRINTS[cache_key]


def _compute_fingerprint(sf_dir: str, spark: SparkSession) -> str:
    base = sf_dir.rstrip("/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .load([f"{base}/lineitem.parquet", f"{base}/orders.parquet"]))
    found = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return hashlib.sha1(f"{LAYOUT_VERSION}|{base}|{found[0]}|{found[1]}".encode()).hexdigest()[:16]


def readings_path(spark: SparkSession, sf_dir: str) -> str:
    return join_path(scratch_dir(spark), "wearline-layout", _fingerprint(sf_dir, spark), "readings")


def _unfinished(path: str) -> str:
    """A folder of this build's own; it gets the final name when complete (``publish``)."""
    return f"{path}-{uuid.uuid4().hex[:12]}"


def build_readings(spark: SparkSession, sf_dir: str, force: bool = False) -> str:
    """Materialise the readings layout for ``sf_dir`` (idempotent); returns its path."""
    with BUILD_LOCK:
        path = readings_path(spark, sf_dir)
        if force or not path_exists(spark, join_path(path, "_SUCCESS")):
            _FRAMES.pop((spark.sparkContext.applicationId, sf_dir), None)  # stale listing
            made = _unfinished(path)
            data_layout(readings_unstored(spark, sf_dir), made, ordered=True)
            if force:
                remove_path(spark, path)
            publish(spark, made, path)
        _LAYOUTS[(spark.sparkContext.applicationId, sf_dir)] = path
        return path


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored readings table (built on first use).  The DataFrame is kept per session
    and folder, so the file listing happens once; it is immutable, and every query
    derives its own plan from it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FRAMES:
        path = _LAYOUTS.get(key) or build_readings(spark, sf_dir)
        _FRAMES[key] = spark.read.parquet(path)
    return _FRAMES[key]


def readings_unstored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table computed straight from ``lineitem`` (no stored layout)."""
    return readings_from_lineitem(load_table(spark, sf_dir, "lineitem"))


def rul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rul_from_orders(load_table(spark, sf_dir, "orders"))


def scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder for a query's own files, below the shared scratch folder."""
    return join_path(scratch_dir(spark), "wearline-work", _fingerprint(sf_dir, spark), name)


def lines_path(spark: SparkSession, sf_dir: str, style: str, plain: bool = True) -> str:
    return join_path(scratch_dir(spark), "wearline-layout", _fingerprint(sf_dir, spark),
                     f"lines-{style}" if plain else f"lines-{style}-gz")


def lines(spark: SparkSession, sf_dir: str, style: str = "mixed", plain: bool = False) -> DataFrame:
    """Raw text lines rendered by Spark from the readings (with injected faults), stored once
    as text files named like the raw files (``train_FD001.txt`` ...) and read back through
    the text source, so the jobs see files as in production.

    The parts of a file are compressed unless ``plain`` (the file listings report the bytes of
    plain text).  Lines come straight from the tables, without the stored readings; the few file
    names are written side by side, no task sorts its lines by them."""
    from wearline.sources.fixtures import raw_lines
    from wearline.sources.text import read_lines

    key = (spark.sparkContext.applicationId, sf_dir, f"lines-{style}-{plain}")
    with BUILD_LOCK:
        path = _LAYOUTS.get(key) or lines_path(spark, sf_dir, style, plain)
        if key not in _LAYOUTS and not path_exists(spark, join_path(path, "_SUCCESS")):
            made = _unfinished(path)
            with open_writers(spark):
                raw_lines(readings_unstored(spark, sf_dir), style=style).write.option(
                    "compression", "none" if plain else "gzip").partitionBy("source").text(made)
            publish(spark, made, path)
        _LAYOUTS[key] = path
        if key not in _FRAMES:
            _FRAMES[key] = read_lines(spark, path)
    return _FRAMES[key]


def rul_lines_path(spark: SparkSession, sf_dir: str) -> str:
    return join_path(scratch_dir(spark), "wearline-layout", _fingerprint(sf_dir, spark),
                     "rul-lines")


def rul_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines (``RUL_<id>.txt`` files) rendered from the label table, stored once."""
    from wearline.sources.fixtures import rul_lines
    from wearline.sources.text import read_lines

    key = (spark.sparkContext.applicationId, sf_dir, "rul-lines")
    with BUILD_LOCK:
        path = rul_lines_path(spark, sf_dir)
        if key not in _LAYOUTS and not path_exists(spark, join_path(path, "_SUCCESS")):
            made = _unfinished(path)
            with open_writers(spark):
                rul_lines(rul(spark, sf_dir)).write.partitionBy("source").text(made)
            publish(spark, made, path)
        _LAYOUTS[key] = path
    return read_lines(spark, path)
