"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph is a non-empty line, blanks around it removed.  It is hashed to a wide vector of
two parts:

* eight lanes of 64 bits, drawn from the 128-bit hash of its bytes;
* 256 lanes of 32 bits, in which every run of three words of the paragraph adds +1 or -1 to
  one lane (lane and sign from its hash; a shorter paragraph is one run).

A document's fingerprint is the sum of its paragraphs' vectors, modulo 2^64 and 2^32.  The
order of paragraphs does not matter; a paragraph is inserted or deleted by adding or
subtracting its vector, and documents are united by adding fingerprints.  Equal multisets of
paragraphs have equal fingerprints, others differ but for collisions of 512 bits of sums.
Since sums keep differences, the 32-bit lanes of two fingerprints also tell how alike the
texts are: the squared length of their difference estimates how many word runs are in one
text only, ``likeness = 1 - |a - b|^2 / (|a|^2 + |b|^2)``, within some 6 % at 256 lanes.  No
lane of a text wraps: a text is at most 2^31 bytes, and every run takes two of them.

* NULL text counts as empty; its fingerprint is all zeros.  Two empty texts are alike (1),
  an empty and a non-empty one are not (0).
* The next document is the next row in the order of id (NULL first), then text; the last
  row's next is the first, a single row's next is itself.  Repeated rows follow each other.
* A very long text is read line by line in one row.  An empty table gives no rows; only ``doc_id``
  and ``text`` are read, so further columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.common import MULT, WordHash, buckets_for, map_arrow, mixed, shared_folder, stored, window_hashes

IDENTITY, LANES, RUN = 8, 256, 3
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
Print = tuple[np.ndarray, np.ndarray]  # identity lanes, likeness lanes


def fingerprint(text: str, hashes: WordHash) -> Print:
    """The fingerprint of a text."""
    paragraphs = [p for line in text.encode().split(b"\n") if (p := line.strip())]
    identity, lanes = np.zeros(IDENTITY, np.uint64), np.zeros(LANES, np.uint32)
    if not paragraphs:
        return identity, lanes
    whole = [xxhash.xxh3_128_intdigest(p) for p in paragraphs]
    low = np.array([x & 0xFFFFFFFFFFFFFFFF for x in whole], np.uint64)[:, None]
    high = np.array([x >> 64 for x in whole], np.uint64)[:, None]
    step = np.arange(1, IDENTITY + 1, dtype=np.uint64)[None, :]
    with np.errstate(over="ignore"):
        identity = (mixed(low + step * MULT) + mixed(high ^ (step * MULT))).sum(axis=0, dtype=np.uint64)
    words = [p.split() for p in paragraphs]
    counts = np.array([len(w) for w in words])
    h = hashes.of([x for w in words for x in w])
    runs = window_hashes(h, RUN)
    of = np.repeat(np.arange(len(words)), counts)
    runs = runs[of[:len(runs)] == of[RUN - 1:]] if len(runs) else runs
    short = np.flatnonzero(counts < RUN)
    if len(short):
        runs = np.concatenate([runs, mixed(low[short, 0])])
    lane = (runs % np.uint64(LANES)).astype(np.int64)
    sign = 1 - 2 * ((runs >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    sums = np.bincount(lane, weights=sign, minlength=LANES).astype(np.int64)
    return identity, (sums & 0xFFFFFFFF).astype(np.uint32)


def insert(a: Print, b: Print) -> Print:
    """The fingerprint of both texts' paragraphs together."""
    with np.errstate(over="ignore"):
        return a[0] + b[0], a[1] + b[1]


def delete(a: Print, b: Print) -> Print:
    """The fingerprint of ``a``'s paragraphs without those of ``b``."""
    with np.errstate(over="ignore"):
        return a[0] - b[0], a[1] - b[1]


def likeness(a: Print, b: Print) -> float:
    """0 (nothing in common) to 1 (equal), from the fingerprints alone."""
    if (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0

    def square(x: np.ndarray) -> float:
        s = x.astype(np.int32).astype(np.float64)
        return float((s * s).sum())

    total = square(a[1]) + square(b[1])
    if not total:
        return 0.0
    with np.errstate(over="ignore"):
        return min(1.0, max(0.0, 1.0 - square(a[1] - b[1]) / total))


def to_text(p: Print) -> str:
    return base64.b64encode(p[0].tobytes() + p[1].tobytes()).decode()


def from_text(s: str) -> Print:
    raw = base64.b64decode(s)
    return np.frombuffer(raw[:8 * IDENTITY], np.uint64), np.frombuffer(raw[8 * IDENTITY:], np.uint32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every document; a narrow transformation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(
                [to_text(fingerprint(t or "", hashes)) for t in batch.column("text").to_pylist()], pa.string())],
                names=["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").transform(map_arrow, run, "doc_id long, fingerprint string")


def cuts_of(places: DataFrame, parts: int, at_once: int = 1000) -> list[float]:
    """About ``parts - 1`` ascending numbers that cut the column ``place`` into even ranges.

    The first sketch has a fixed accuracy (a quarter of a range of ``at_once``), so what its tasks
    merge does not grow with the ranges; where there are more, each of its ranges is cut again by
    a sketch of its own, all in one aggregate."""
    coarse = min(parts, at_once)
    cuts = sorted({0.0, *places.approxQuantile("place", [i / coarse for i in range(1, coarse)], 1 / (4 * at_once))})
    if parts <= coarse or not cuts:
        return cuts
    cut = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="place", outputCol="range", handleInvalid="skip")
    per = -(-parts // coarse)
    inner = cut.transform(places).groupBy("range").agg(
        F.percentile_approx("place", [i / per for i in range(1, per)], 4 * per).alias("cuts")).select("cuts").collect()
    return sorted({*cuts, *(c for r in inner for c in r["cuts"] or [])})


def in_order(docs: DataFrame, bucket_mb: int) -> DataFrame:
    """``bucket, ghost, doc_id, text``: documents dealt to ranges of ids and sorted, each
    range followed by a copy (``ghost``) of the next range's first row.

    The ranges are cut at quantiles of the ids (``cuts_of``; NULL ids are the range 0), so an
    outlying id leaves the others spread.  Only one row per range (24 bytes) is ranked; the
    ranges' first ids are broadcast up to a million ranges, beyond that joined by shuffle.  Texts
    are shuffled once, each range to a partition of its own."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = buckets_for(docs.select("doc_id", "text"), bucket_mb)
    place = F.col("doc_id").cast("double")  # keeps the order; equal ids stay together
    cuts = cuts_of(texts.select(place.alias("place")), parts)
    ranges = len(cuts) + 2
    cut = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="place", outputCol="range", handleInvalid="keep")
    ranged = cut.transform(texts.withColumn("place", place)).select(
        "doc_id", "text", F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("range").cast("int") + 1).alias("bucket"))
    firsts = stored(ranged.groupBy("bucket").agg(F.min("doc_id").alias("first")), shared_folder(spark, "ranges"))
    by_range = Window.orderBy("bucket")  # one row per range
    following = firsts.select(
        "bucket", F.coalesce(F.lead(F.struct("first", "bucket")).over(by_range),
                             F.first(F.struct("first", "bucket")).over(by_range)).alias("next"))
    wanted = following.select(F.col("bucket").alias("before"), F.col("next.first").alias("first"),
                              F.col("next.bucket").alias("bucket"))
    wanted = wanted.withColumnRenamed("bucket", "_b")
    ghosts = (ranged.join(F.broadcast(wanted) if firsts.count() <= 1_000_000 else wanted,
                          (F.col("bucket") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("first")))
              .groupBy("before", "doc_id").agg(F.min("text").alias("text"))
              .select(F.col("before").alias("bucket"), F.lit(1).alias("ghost"), "doc_id", "text"))
    return (ranged.select("bucket", F.lit(0).alias("ghost"), "doc_id", "text").unionByName(ghosts)
            .repartitionById(ranges, "bucket")
            .sortWithinPartitions("bucket", "ghost", F.col("doc_id").asc_nulls_first(), "text"))


def edited(text: str, following: str) -> str:
    """The last half of a text's code points replaced by as many of the next text's first."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edit_fingerprints(docs: DataFrame, *, bucket_mb: int = 32) -> DataFrame:
    """The fingerprints of every text and of its edited text, and how alike they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        held = None  # the row whose next one has not been seen
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for bucket, ghost, doc_id, text in zip(*(batch.column(c).to_pylist() for c in (
                    "bucket", "ghost", "doc_id", "text")), strict=True):
                own = fingerprint(text, hashes)
                if held is not None and held[0] == bucket:
                    _, last_id, last_text, last = held
                    changed = edited(last_text, text)
                    new = fingerprint(changed, hashes)
                    for column, value in zip(columns, (
                            last_id, len(last_text), hashlib.sha256(changed.encode()).hexdigest(), to_text(last),
                            to_text(new), likeness(last, new), likeness(last, own)), strict=True):
                        column.append(value)
                held = None if ghost else (bucket, doc_id, text, own)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                  names=[f.split()[0] for f in SCHEMA.split(", ")])

    return in_order(docs, bucket_mb).transform(map_arrow, run, SCHEMA)
