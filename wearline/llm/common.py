"""Shared helpers of the operators: reading tables, words, shared-folder tables, packed rows.

Words are the maximal runs of characters other than the six ASCII blanks
(``\\x20 \\x09-\\x0D``).  ``bytes.split()`` cuts at exactly those, and ``bytes.lower()`` lowers
exactly A-Z, so the Python helpers work on UTF-8 bytes; ``WORD`` is the same rule for the
JVM's regular expressions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.session import join_path, scratch_dir

WORD = r"[^\x20\x09-\x0D]+"
BLANK = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Folders of intermediate tables made by this driver and not yet removed.
_MADE: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` for one run of an operator.  A lazy result may
    read it, so it stays until ``sweeping`` or ``sweep`` removes it."""
    path = join_path(scratch_dir(spark), "wearline-llm", f"{name}-{uuid.uuid4().hex[:12]}")
    _MADE.append(path)
    return path


def sweep(spark: SparkSession, first: int = 0) -> int:
    """Remove the intermediate folders made so far (from the ``first`` one on): to be called when
    the results that read them are written.  Returns their number."""
    gone = _MADE[first:]
    del _MADE[first:]
    for path in gone:
        remove(spark, path)
    return len(gone)


@contextmanager
def sweeping(spark: SparkSession):
    """Removes the intermediate folders that the operators called inside have made."""
    first = len(_MADE)
    try:
        yield
    finally:
        sweep(spark, first)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage at a copy that every executor can read again, so a lost executor costs
    only its running tasks, and gives later joins a bare scan (whose skewed partitions the
    adaptive planner can split)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate folder that no later plan reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (the file sizes for a plain scan)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def buckets_for(df: DataFrame, bucket_mb: int, at_least: int = 96) -> int:
    """Number of hash buckets so that each one serves about ``bucket_mb`` MB of input.

    A frame that is not read from files has no size estimate; it gets ``at_least``, and a
    caller with a large one stores it first."""
    size = input_bytes(df)
    return at_least if size >= 1 << 60 else max(at_least, -(-size // (bucket_mb << 20)))


def id_text(column: str) -> Column:
    return F.col(column).cast("string")


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (NULL id: NULL)."""
    return F.crc32(id_text(column).cast("binary")) % F.lit(modulus)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes: texts vary too much in length for a
    bound by rows.  8 MB unless the cluster or the session says otherwise; a longer text is
    a batch of its own."""
    spark = df.sparkSession
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_BYTES):  # set by nobody
        spark.conf.set(BATCH_BYTES, "8m")
    return df.mapInArrow(function, schema)


def batch_bytes_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A text column of a batch as UTF-8 byte strings (None for NULL)."""
    return batch.column(column).cast(pa.binary()).to_pylist()


class WordHash(dict):
    """64-bit hash per word, remembered for up to ``limit`` words of one worker."""

    def __init__(self, limit: int = 150_000, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, self.seed)
        if len(self) < self.limit:
            self[word] = h
        return h

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


MULT = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective finisher: spreads every input bit over the 64-bit value."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes (none if there are fewer).

    Doubling: the polynomial hash of 2m words is built from two hashes of m words, so the
    cost is logarithmic in the width."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total, done = None, 0
        power, size, m = words, 1, MULT  # hashes of runs of `size` words; MULT ** size
        left = width
        while left:
            if left & 1:
                part = power[done:done + n]
                total = part.copy() if total is None else total * m + part
                done += size
            left >>= 1
            if left:
                power = power[:len(power) - size] * m + power[size:]
                m = m * m
                size *= 2
        return mixed(total)


def shares(limit: int, weights: Iterator[int]) -> Iterator[list[int]]:
    """Consecutive indexes grouped so that each group's weight stays near ``limit``."""
    group, total = [], 0
    for i, w in enumerate(weights):
        if group and total + w > limit:
            yield group
            group, total = [], 0
        group.append(i)
        total += w
    if group:
        yield group
