"""A random forest for regression, grown level by level over rows packed as bin numbers.

The model is Spark's (``RandomForestRegressionModel``), and trees are grown by its rules: features
cut into at most ``max_bins`` bins from a sample, a Poisson weight per row and tree, every feature
tried in every node, the split of least variance, the mean label in a leaf.  Only the weights are
drawn otherwise, so a forest is not the one that Spark's own trainer grows from a seed.

That trainer keeps a row with its weights in about 600 bytes of JVM memory, reads all of them some
40 times for 100 trees of depth 10, and adds each to statistics of 64 MB, far beyond any cache.  Here
a row is one byte per feature and its label, weights are drawn anew from the seed, and a tree and a
feature are counted at a time.  Every level is one Spark job: tasks sum labels and weights per node,
feature and bin over blocks of rows, for some of the trees each; the sums are shuffled by tree, and
the best split per node goes to the driver (a few numbers per node).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wearline.session import _settings, join_path, remove_path, scratch_dir

# Rows packed together (numbers of one feature lie together), and rows whose sums one task adds up.
CHUNK_ROWS = 1 << 16
BLOCK_ROWS = 4 << 20
# Trees and nodes of a tree that one task counts at once: bounds its sums (100 MB at 32 bins and 24
# features), whatever the rows.
GROUP_TREES = 16
GROUP_NODES = 512
# Rows from which bins are cut, twice what Spark's forest takes at least.
SAMPLE_ROWS = 20_000
BATCH_BYTES = 8 << 20


# A random 16-bit number counts as often as there are entries here not above it: Poisson, mean 1.
POISSON = [k for k in (round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(n + 1))) for n in range(8)) if k < 65536]


def row_weights(seed: int, tree: int, part: int, chunk: int, rows: int) -> np.ndarray:
    """How often each row of a chunk counts in a tree: the same on every call."""
    source = np.random.Generator(np.random.SFC64(np.random.SeedSequence([seed % (1 << 64), tree, part, chunk])))
    drawn = np.frombuffer(source.bytes(2 * rows), np.uint16)
    weight = np.zeros(rows, np.uint8)
    for least in POISSON:
        weight += drawn >= np.uint16(least)
    return weight


def bin_cuts(values: np.ndarray, max_bins: int) -> np.ndarray:
    """Ascending thresholds, fewer than ``max_bins``: midway between neighbouring values, all of
    them or those that part the values into about equal shares."""
    distinct, counts = np.unique(values, return_counts=True)
    middle = distinct[:-1] / 2 + distinct[1:] / 2
    if len(middle) >= max_bins:
        wanted = np.arange(1, max_bins) * (len(values) / max_bins)
        middle = middle[np.unique(np.searchsorted(np.cumsum(counts)[:-1], wanted).clip(max=len(middle) - 1))]
    return np.unique(middle[np.isfinite(middle)])


@dataclass
class Tree:
    """Nodes in the order they are made; a leaf has ``left`` -1 and, as one of Spark's, impurity and
    gain -1 (its squares are not summed).  ``open``: nodes to be split next."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    impurity: list[float] = field(default_factory=list)
    stats: list[list[float]] = field(default_factory=list)  # weight, sum and sum of squares of the labels
    open: list[int] = field(default_factory=list)

    def add(self, weight: float, total: float) -> int:
        for values, v in ((self.feature, -1), (self.cut, -1), (self.left, -1), (self.gain, -1.0), (self.impurity, -1.0),
                          (self.stats, [weight, total, 0.0])):
            values.append(v)
        return len(self.left) - 1

    def walk(self, low: int) -> tuple[np.ndarray, ...]:
        """Arrays to walk rows down with: a leaf leads to itself.  ``slot`` numbers the open nodes
        from ``low`` on, -1 for all others."""
        left = np.array(self.left)
        leaf = left < 0
        slot = np.full(len(left), -1)
        some = self.open[low:low + GROUP_NODES]
        slot[some] = np.arange(len(some))
        return (np.where(leaf, 0, self.feature), np.where(leaf, 255, self.cut).astype(np.uint8),
                np.where(leaf, np.arange(len(left)), left), slot)


def _packer(cuts: list[np.ndarray]) -> Callable:
    """Arrow function: rows (features, then the label) to chunks of bin numbers and labels."""

    def packed(rows: pa.Table, part: int, chunk: int) -> pa.RecordBatch:
        columns = [c.to_numpy() for c in rows.columns]
        bins = b"".join(np.searchsorted(c, x).astype(np.uint8).tobytes() for c, x in zip(cuts, columns, strict=False))
        return pa.RecordBatch.from_pydict({
            "part": [part], "chunk": [chunk], "bins": [bins], "labels": [columns[-1].astype(np.float64).tobytes()]},
            schema=pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("bins", pa.binary()), ("labels", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            while rows >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, CHUNK_ROWS), part, chunk)
                held, rows, chunk = table.slice(CHUNK_ROWS).to_batches(), rows - CHUNK_ROWS, chunk + 1
        if rows:
            yield packed(pa.Table.from_batches(held), part, chunk)

    return run


def _counter(walks: dict[int, tuple[np.ndarray, ...]], groups: int, depth: int, n_features: int, bins: int, seed: int) -> Callable:
    """Arrow function: chunks to the sums of each tree of their group: weights and weighted labels
    by feature, node and bin, then weighted squares by node."""

    def add(sums: np.ndarray, tree: int, chunk: dict) -> None:
        feature, cut, left, slot = walks[tree]
        labels = np.frombuffer(chunk["labels"])
        values = np.frombuffer(chunk["bins"], np.uint8)
        n = len(labels)
        weight = row_weights(seed, tree, chunk["part"], chunk["chunk"], n)
        rows = np.flatnonzero(weight > 0)
        node = np.zeros(len(rows), np.intp)
        start = feature * n
        for _ in range(depth):
            node = left[node] + (values[start[node] + rows] > cut[node])
        at = slot[node]
        if at.size and at.min() < 0:
            rows, at = rows[at >= 0], at[at >= 0]
        nodes = slot.max() + 1
        w = weight[rows].astype(np.float64)
        y = labels[rows]
        wy = w * y
        base, size = at * bins, nodes * bins
        both = sums[:2 * n_features * size].reshape(2, n_features, size)
        for f in range(n_features):
            place = base + values[f * n:(f + 1) * n].take(rows)
            both[0, f] += np.bincount(place, w, size)
            both[1, f] += np.bincount(place, wy, size)
        sums[2 * n_features * size:] += np.bincount(at, wy * y, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk in batch.to_pylist():
                for tree in sorted(t for t in walks if t % groups == chunk["of"]):
                    if tree not in sums:
                        nodes = walks[tree][3].max() + 1
                        sums[tree] = np.zeros(nodes * (2 * n_features * bins + 1))
                    add(sums[tree], tree, chunk)
        for tree, found in sums.items():
            yield pa.RecordBatch.from_pydict({"tree": [tree], "sums": [found.tobytes()]},
                                             schema=pa.schema([("tree", pa.int32()), ("sums", pa.binary())]))

    return run


SPLIT = "tree int, slot int, feature int, cut int, gain double, weight double, total double, squares double, left_weight double, left_total double"


def best_splits(sums: np.ndarray, n_features: int, bins: int) -> dict[str, np.ndarray]:
    """Per node the split whose parts' variances are least (the first of equal ones), with the sums
    of the node and of its left part; ``gain`` 0 where no split leaves rows on both sides."""
    nodes = len(sums) // (2 * n_features * bins + 1)
    weight, total = np.cumsum(sums[:2 * n_features * nodes * bins].reshape(2, n_features, nodes, bins), axis=-1)
    n, s = weight[0, :, -1], total[0, :, -1]
    left, left_total = weight[..., :-1], total[..., :-1]
    right, right_total = n[:, None] - left, s[:, None] - left_total
    with np.errstate(divide="ignore", invalid="ignore"):
        less = left_total ** 2 / left + right_total ** 2 / right - (s * s / n)[:, None]
    less = np.where((left > 0) & (right > 0), less, 0.0).transpose(1, 0, 2).reshape(nodes, -1)
    best = less.argmax(axis=1)
    f, cut = best // (bins - 1), best % (bins - 1)
    at = np.arange(nodes)
    squares = sums[2 * n_features * nodes * bins:]
    found = less[at, best]
    # differences below the last digits of the sums are none
    gain = np.where(found > 1e-12 * squares, found / np.maximum(n, 1), 0.0)
    return {"slot": at, "feature": f, "cut": cut, "gain": gain, "weight": n, "total": s, "squares": squares,
            "left_weight": weight[f, at, cut], "left_total": total[f, at, cut]}


def _splitter(n_features: int, bins: int) -> Callable:
    """Arrow function: the sums of whole trees to their best splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, np.ndarray] = {}
        for batch in batches:
            for tree, sums in zip(batch.column("tree").to_pylist(), batch.column("sums"), strict=True):
                part = np.frombuffer(sums.as_buffer())
                whole[tree] = whole[tree] + part if tree in whole else part
        for tree, sums in whole.items():
            found = best_splits(sums, n_features, bins)
            ints = {k: pa.array(v, pa.int32()) for k, v in {"tree": np.full(len(found["slot"]), tree), **found}.items()
                    if k in ("tree", "slot", "feature", "cut")}
            yield pa.RecordBatch.from_pydict(ints | {k: pa.array(v, pa.float64()) for k, v in found.items() if k not in ints})

    return run


def _grow(packed: DataFrame, rows: int, trees: list[Tree], max_depth: int, n_features: int, bins: int, seed: int) -> None:
    """All trees, one level after the other."""
    spark = packed.sparkSession
    cores = spark.sparkContext.defaultParallelism
    blocks = -(-rows // BLOCK_ROWS)
    groups = min(len(trees), max(-(-len(trees) // GROUP_TREES), -(-2 * cores // blocks)))
    work = reduce(DataFrame.unionAll, [packed.withColumn("of", F.lit(g)).coalesce(blocks) for g in range(groups)])
    for depth in range(max_depth):
        following: dict[int, list[int]] = {}
        for low in range(0, max(len(t.open) for t in trees), GROUP_NODES):
            walks = {i: t.walk(low) for i, t in enumerate(trees) if len(t.open) > low}
            sums = work.mapInArrow(_counter(walks, groups, depth, n_features, bins, seed), "tree int, sums binary")
            found = sums.repartition(min(len(walks), max(2 * cores, 1)), "tree").mapInArrow(_splitter(n_features, bins), SPLIT)
            for r in found.toArrow().sort_by([("tree", "ascending"), ("slot", "ascending")]).to_pylist():
                tree = trees[r["tree"]]
                node, n = tree.open[low + r["slot"]], r["weight"]
                tree.stats[node] = [n, r["total"], r["squares"]]
                tree.impurity[node] = max(r["squares"] / n - (r["total"] / n) ** 2, 0.0) if n else 0.0
                if r["gain"] > 0:
                    tree.feature[node], tree.cut[node], tree.gain[node] = r["feature"], r["cut"], r["gain"]
                    tree.left[node] = tree.add(r["left_weight"], r["left_total"])
                    tree.add(n - r["left_weight"], r["total"] - r["left_total"])
                    following.setdefault(r["tree"], []).extend(
                        c for c in (tree.left[node], tree.left[node] + 1) if tree.stats[c][0] > 1)
        for i, t in enumerate(trees):
            t.open = following.get(i, [])
        if not following:
            break


def _node_rows(trees: list[Tree], cuts: list[np.ndarray]) -> Iterator[dict]:
    """The trees as rows of Spark's node table."""
    for i, t in enumerate(trees):
        for k, left in enumerate(t.left):
            n, total, squares = t.stats[k]
            at = [float(cuts[t.feature[k]][t.cut[k]])] if left >= 0 else []
            yield {"treeID": i, "nodeData": {
                "id": k, "prediction": total / n if n else 0.0, "impurity": t.impurity[k], "impurityStats": [n, total, squares],
                "rawCount": int(n), "gain": t.gain[k], "leftChild": left, "rightChild": left + 1 if left >= 0 else -1,
                "split": {"featureIndex": t.feature[k], "leftCategoriesOrThreshold": at, "numCategories": -1}}}


def _model(spark: SparkSession, pipeline: Pipeline, features: Sequence[str], label: str, trees: list[Tree],
           cuts: list[np.ndarray]) -> PipelineModel:
    """The trees as a fitted pipeline.  Spark's estimator writes the model folder, with all
    parameters, from two rows of no meaning; its table of nodes is then replaced by the trees'."""
    columns = ", ".join(f"{c} double" for c in [*features, label])
    made = spark.createDataFrame([[float(v)] * (len(features) + 1) for v in (0, 1)], columns).coalesce(1)
    path = join_path(scratch_dir(spark), "wearline-stage", uuid.uuid4().hex)
    pipeline.fit(made).write().save(path)
    forest = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(join_path(path, "stages", "1_*"))
    folder = forest.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(forest)[0].getPath().toString()
    data = join_path(folder, "data")
    schema = spark.read.parquet(data).schema
    nodes = spark.createDataFrame(pa.Table.from_pylist(list(_node_rows(trees, cuts)), to_arrow_schema(schema)), schema)
    nodes.coalesce(1).write.mode("overwrite").parquet(data)
    model = PipelineModel.load(path)
    remove_path(spark, path)
    return model


def fit_forest(data: DataFrame, dealt: DataFrame, rows: int, pipeline: Pipeline, features: Sequence[str], label: str,
               key: Sequence[str]) -> PipelineModel:
    """The ``pipeline`` (assembler and forest) fitted on ``data``, whose ``rows`` rows ``dealt``
    holds in tasks of bounded size and in a fixed order."""
    spark, forest = data.sparkSession, pipeline.getStages()[-1]
    bins, seed = forest.getMaxBins(), forest.getSeed()
    if not 2 <= bins <= 256:
        raise ValueError("max_bins must be from 2 to 256")
    columns = [*features, label]
    few = F.lit(True) if rows <= SAMPLE_ROWS else F.pmod(F.xxhash64(*key, *features, F.lit(seed)), F.lit(rows)) < SAMPLE_ROWS
    sample = data.where(few).select(*[F.col(c).cast("double") for c in features]).toArrow()
    cuts = [bin_cuts(sample.column(c).to_numpy(), bins) for c in features]
    path = join_path(scratch_dir(spark), "wearline-stage", uuid.uuid4().hex)
    trees = [Tree() for _ in range(forest.getNumTrees())]
    for t in trees:
        t.open = [t.add(0.0, 0.0)]
    # a union of single tasks stays one task each
    with _settings(spark, execution__arrow__maxBytesPerBatch=BATCH_BYTES, unionOutputPartitioning="false"):
        try:
            (dealt.select(*[F.col(c).cast("double").alias(c) for c in columns])
             .mapInArrow(_packer(cuts), "part int, chunk int, bins binary, labels binary")
             .write.option("compression", "zstd").parquet(path))
            _grow(spark.read.parquet(path), rows, trees, forest.getMaxDepth(), len(features), bins, seed)
        finally:
            remove_path(spark, path)
    return _model(spark, pipeline, features, label, trees, cuts)
