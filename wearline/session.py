"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = "local[*]", shuffle_partitions: int | None = None,
                  app: str = "wearline", extra: dict | None = None) -> SparkSession:
    """A session with AQE (partition coalescing, skew-join splitting) on.

    Local masters get ``shuffle_partitions`` (default 8).  On a cluster pass
    ``master=None``: the cluster's own shuffle-partition setting is kept unless
    ``shuffle_partitions`` is given; size it so one partition is a few hundred MB of
    shuffle data at the largest input (AQE then merges the small ones).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None or master:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read here.  Where it is
    unset (tests, a laptop) a fresh local folder is created and registered once.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="wearline-ckpt-")
        sc.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
        d = sc.getCheckpointDir() or d
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d.rstrip("/")


@contextmanager
def _settings(spark: SparkSession, **values: int | str) -> Iterator[None]:
    """Settings ``spark.sql.<name>`` (dots written ``__``) that hold for the actions run inside."""
    names = {f"spark.sql.{k.replace('__', '.')}": str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def open_writers(spark: SparkSession, most: int = 100) -> Iterator[None]:
    """Partitioned writes inside keep a file per partition value open (up to ``most``) instead of
    sorting a task's whole rows by that value: for few values and wide rows."""
    with _settings(spark, maxConcurrentOutputFileWriters=most):
        yield


# Most bytes of a file that one task reads (Spark's own default).
SPLIT_BYTES = 128 << 20


@contextmanager
def own_splits(spark: SparkSession, total_bytes: int | None = None) -> Iterator[None]:
    """Scans inside read one split of one file per task and put no files together, so that what a
    task reads are neighbours in their file.  ``total_bytes`` (all files) sizes splits such that
    every core gets one."""
    size = SPLIT_BYTES
    if total_bytes is not None:
        size = max(4 << 20, min(size, total_bytes // spark.sparkContext.defaultParallelism))
    with _settings(spark, files__maxPartitionBytes=size, files__openCostInBytes=size):
        yield


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through the Hadoop file system of the path (works for any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the program's own below the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def publish(spark: SparkSession, made: str, path: str) -> None:
    """Give a finished folder its final name.  If another driver was first, its folder stays
    and ours is removed: readers never see an unfinished or a replaced one."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    source, target = hadoop(made), hadoop(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        if not fs.exists(target):
            raise RuntimeError(f"cannot publish {path}")


def join_path(*parts: str) -> str:
    head, *rest = parts
    return "/".join([head.rstrip("/")] + [p.strip("/") for p in rest])


__all__ = ["build_session", "scratch_dir", "path_exists", "join_path", "remove_path", "publish",
           "open_writers", "own_splits"]
