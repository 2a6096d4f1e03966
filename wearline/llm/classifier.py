"""Quality classifier: regularised quadratic discriminant over document statistics.

Every text is described by twelve transformed statistics (logarithms of smoothed ratios, so
that short texts stay near the middle).  Per class, Spark sums the statistics and their
products over all labelled training rows; from the sums come the class mean and the
covariance, shrunk towards a multiple of the identity.  The Cholesky factors are computed
once and shipped with the scoring function.  A score is the logistic of the difference of
the two classes' Mahalanobis log densities plus log priors.

* NULL text counts as empty; the statistics of an empty text are defined, so it is scored.
* Labels other than 0 and 1, NULL ids, and ids whose label rows contradict each other teach
  nothing.  Repeated label rows count once; repeated documents count as often as they occur.
* A very long text is one row of twelve numbers; its words are held while it is measured.
* An empty table gives no rows; only ``doc_id`` and ``text`` are read, other columns (also of a
  clashing name) are carried by ``keep_good``.
* With labels of one class only, every score is that class (0 or 1); with none, 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import WordHash, batch_bytes_of, crc_mod, map_arrow, shared_folder, stored, window_hashes

SYMBOLS = b"#*$%&|<>"
CAPITALS = re.compile(rb"[A-Z]|\xc3[\x80-\x96\x98-\x9e]")
NAMES = ("words", "word_length", "distinct_words", "symbols", "exclamations", "digits", "capitals",
         "repeated_lines", "doubled_words", "stops", "commas", "distinct_pairs")
SMOOTH = 100.0  # pseudo-observations without the trait, in every ratio


def statistics(text: bytes, hashes: WordHash) -> list[float]:
    """The twelve statistics of one text, in the order of ``NAMES``."""
    words = text.split()
    h = hashes.of(words)
    n, k = len(text), len(words)

    def without(chars: bytes) -> int:
        return n - len(text.translate(None, chars))

    lines = [x for x in text.split(b"\n") if x.strip()]

    def ratio(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (whole + SMOOTH)))

    return [
        float(np.log1p(k)),
        float(np.log((sum(map(len, words)) + 1) / (k + 1))),
        ratio(len(np.unique(h)), k),
        ratio(without(SYMBOLS), n),
        ratio(text.count(b"!"), n),
        ratio(without(b"0123456789"), n),
        ratio(len(CAPITALS.findall(text)), n),
        ratio(len(lines) - len(set(lines)), len(lines)),
        ratio(int((h[1:] == h[:-1]).sum()), k),
        ratio(text.count(b".") + text.count(b"?"), k),
        ratio(text.count(b","), k),
        ratio(len(np.unique(window_hashes(h, 2))), k),
    ]


def _matrix(batch: pa.RecordBatch, hashes: WordHash) -> np.ndarray:
    return np.array([statistics(t or b"", hashes) for t in batch_bytes_of(batch, "text")],
                    np.float64).reshape(-1, len(NAMES))


def features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and one double column per statistic, a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            x = _matrix(batch, hashes)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *map(pa.array, x.T)],
                                  names=["doc_id", *NAMES])

    return docs.select("doc_id", "text").transform(map_arrow, run, ", ".join(["doc_id long", *(f"{n} double" for n in NAMES)]))


@dataclass
class Model:
    """Per class: mean, Cholesky factor, half log determinant and log prior; ``constant``
    replaces them when a class has no training row."""

    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    offsets: np.ndarray | None = None
    constant: float | None = None
    rows: tuple[int, int] = (0, 0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            logs.append(offset - 0.5 * (z * z).sum(0))
        return 1.0 / (1.0 + np.exp(-np.clip(logs[1] - logs[0], -60.0, 60.0)))


# Labelled ids that are broadcast to pick their documents (8 bytes each); with more of them, the
# statistics of all documents (96 bytes each) are made and joined.
BROADCAST_LABELS = 1_000_000


def fit(rows: DataFrame, label: str, shrinkage: float = 0.02) -> Model:
    """A model from all ``rows`` (the statistics' columns and a 0/1 ``label``).

    One aggregation with partial sums; two rows of 91 numbers come to the driver."""
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(NAMES)],
        *[F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    found = {int(r[label]): r for r in sums}
    counts = tuple(int(found[c]["n"]) if c in found else 0 for c in (0, 1))
    if not all(counts):
        return Model(constant=0.5 if not any(counts) else float(counts[1] > 0), rows=counts)
    total = sum(counts)
    first, second = np.zeros((2, d)), np.zeros((2, d, d))
    for c, r in found.items():
        first[c] = [r[f"s{i}"] for i in range(d)]
        for i, j in pairs:
            second[c, i, j] = second[c, j, i] = r[f"p{i}_{j}"]
    # Scale all statistics alike before shrinking: the identity then fits every one of them.
    spread = np.sqrt(np.maximum(np.diag(second.sum(0)) / total - (first.sum(0) / total) ** 2, 1e-12))
    means, factors, offsets = [], [], []
    for c in (0, 1):
        mean = first[c] / counts[c]
        cov = (second[c] / counts[c] - np.outer(mean, mean)) / np.outer(spread, spread)
        cov = (1 - shrinkage) * cov + (shrinkage * max(np.trace(cov) / d, 1e-6) + 1e-9) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(spread[:, None] * factor)
        offsets.append(np.log(counts[c] / total) - np.log(np.diag(factors[-1])).sum())
    return Model(np.array(means), np.array(factors), np.array(offsets), rows=counts)


def held_out(column: str = "doc_id", modulus: int = 4, remainder: int = 2) -> Column:
    """Ids whose label never teaches: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(crc_mod(column, modulus) == remainder, F.lit(False))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """One row per labelled id outside the held-out part, contradicting ids left out."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
            .groupBy("doc_id").agg(F.min(label).alias("_label"), F.max(label).alias("_most"))
            .where("_label = _most").select("doc_id", "_label"))


def train(stats: DataFrame, labels: DataFrame, label: str, shrinkage: float = 0.02) -> Model:
    return fit(stats.join(training_labels(labels, label), "doc_id"), "_label", shrinkage)


def quality_scores(docs: DataFrame, labels: DataFrame, *, label: str = "quality",
                   threshold: float = 0.7, shrinkage: float = 0.02) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    The texts are read once: the statistics (96 bytes a document) are stored in the shared
    folder, the model is trained on them and applied to them."""
    spark = docs.sparkSession
    stats = stored(features(docs), shared_folder(spark, "statistics"))
    model = train(stats, labels, label, shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES])
            yield pa.record_batch([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return (stats.transform(map_arrow, run, "doc_id long, score double")
            .select("doc_id", held_out().alias("held_out"), "score",
                    F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame, *, label: str = "quality",
              threshold: float = 0.7, shrinkage: float = 0.02) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns.

    Statistics for training are made of the labelled documents only.  The filter recomputes them
    batch by batch, so no join has to bring scores and texts together and repeated or NULL ids
    need no rule."""
    known = training_labels(labels, label)
    few = known.count() <= BROADCAST_LABELS
    taught = docs.join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi") if few else docs
    model = train(features(taught), labels, label, shrinkage)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            yield batch.filter(pa.array(model.score(_matrix(batch, hashes)) >= threshold))

    return docs.transform(map_arrow, run, docs.schema)
