"""MinHash near-dedup with bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  Its sketch is
the ``k`` smallest of them.

1. Documents of equal sets form a class; from here on a class counts once.
2. *Overlaps.*  Inverted lists of the retained values tell how many values of a sketch occur
   in other sketches.  A pair at or above the threshold shares at least ``need`` retained
   values (a bound that a pair at the threshold misses with a chance of about 1e-8), so a
   class with fewer shared values is linked with nothing.  Few classes remain; only their
   full sets are built.
3. A remaining class can only be linked if enough of its *full* set occurs in other classes;
   ``common`` counts those shingles exactly.
4. *Lists.*  Sorting a sketch by the lengths of its lists, a pair that shares ``need`` values
   shares one of the ``k - need + 1`` rarest; only these stay in lists.  Each list first
   compares its members with one pivot, the member whose values are the most common: in a
   group of near copies that is the text that the others vary.  After those links only pairs
   of different components are left to compare.  The few members concerned are sorted by
   the rarity of all their shingles, and only pairs go on whose first shared shingle stands
   early enough in both (the exact prefix and position bounds of set joins).
5. *Estimate and verify.*  A pair's similarity is first estimated in the sketch of the
   union; the pairs left are confirmed by exact Jaccard on the full sets.
6. Components of the confirmed links; the smallest id of a component stays.

* NULL text and texts without a word have the empty set and are linked with nothing.
* A text of fewer than five words has its whole sequence as its one shingle.
* A row with NULL id is linked with nothing: component NULL, kept.
* Repeated rows share their class and each get its verdict.
* A very long text is one row of its distinct shingles' hashes (8 bytes each).
* An empty table gives no rows; further columns, also of clashing names, are only carried by
  ``drop_near_duplicates``.
* The hash is 64 bits wide; sets are compared through it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.common import WordHash, batch_bytes_of, map_arrow, mixed, shared_folder, stored, window_hashes
from wearline.llm.components import components

SKETCHED = "doc_id long, n long, print binary, low array<long>"
FULL = "doc_id long, n long, print binary, shingles array<long>"


def shingle_set(text: bytes | None, width: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, as signed 64-bit numbers."""
    words = hashes.of((text or b"").lower().split())
    if not len(words):
        return np.zeros(0, np.int64)
    found = window_hashes(words, min(width, len(words)))
    if len(words) < width:  # a whole short sequence is no shingle of a longer text
        found = mixed(found + np.uint64(len(words)))
    return np.unique(found.view(np.int64))


def fingerprint(values: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    import xxhash

    return xxhash.xxh3_128_digest(values.tobytes())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(a) for a in arrays])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _set_function(width: int, k: int | None):
    """Arrow function: the ``k`` smallest values of each set, or all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for whole in batches:
            for at in range(0, len(whole), 2000):
                batch = whole.slice(at, 2000)
                sets = [shingle_set(t, width, hashes) for t in batch_bytes_of(batch, "text")]
                yield pa.record_batch(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(map(len, sets), pa.int64()),
                     pa.array(map(fingerprint, sets), pa.binary()), _lists([s[:k] for s in sets])],
                    names=["doc_id", "n", "print", "low" if k else "shingles"])

    return run


def need(n: Column, k: int, least: int, percent: int) -> Column:
    """Retained values that a pair at the threshold shares at least."""
    return F.least(F.lit(least), F.ceil(n * percent / 100).cast("int"))


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and common shingles allow the threshold.  A shared shingle is common in
    both sets, so the intersection is at most the smaller ``common``."""
    most = F.least(F.col(f"{a}.common"), F.col(f"{b}.common"))
    return 100 * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)


def may_reach(most: str, percent: int) -> Column:
    """Whether a set of ``n`` that shares at most ``most`` can reach the threshold with the
    smallest partner possible (``least_n``, or what the threshold asks of a partner)."""
    partner = F.greatest(F.col("least_n"), F.ceil(F.col("n") * percent / 100))
    return 100 * F.col(most) >= percent * (F.col("n") + partner - F.col(most))


def rest_pairs(rest: DataFrame, sets: DataFrame, percent: int, base: str) -> DataFrame:
    """Pairs ``a, b`` of different components among ``rest`` (``c, n, root``) that may reach
    the threshold.

    Each full set is sorted, rarest shingle first.  Two sets at the threshold share one of
    their ``n - ceil(n * t) + 1`` rarest, and at the first one that they share neither has a
    shared one before it: what follows in the shorter remainder bounds the intersection."""
    shingles = rest.join(sets.select("c", "shingles"), "c").select("c", "n", "root", F.explode("shingles").alias("h"))
    counts = stored(shingles.groupBy("h").agg(F.count(F.lit(1)).alias("f")), f"{base}/rest-counts")
    prefix = (shingles.join(counts, "h")
              .withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy("f", "h")))
              .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).where("f > 1")
              .select("h", "c", "n", "root", (F.col("n") - F.col("place") + 1).alias("left")))
    prefix = stored(prefix, f"{base}/rest-prefix")
    sizes = prefix.groupBy("h").agg(F.min("n").alias("least_n"))
    able = stored(prefix.join(sizes, "h").where(may_reach("left", percent)).drop("least_n"), f"{base}/rest-able")
    several = able.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("h")
    able = stored(able.join(several, "h"), f"{base}/rest-lists")
    x, y = able.alias("x"), able.alias("y")
    most = F.least("x.left", "y.left")
    return (x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.c") < F.col("y.c")) & (F.col("x.root") != F.col("y.root"))
                   & (100 * most >= percent * (F.col("x.n") + F.col("y.n") - most)))
            .select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct())


def verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, k: int, least: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` at or above the threshold: union-sketch estimate, then exact."""
    low = classes.select("c", "low", "n")
    estimated = (pairs.join(low.select(F.col("c").alias("a"), F.col("low").alias("la"), F.col("n").alias("na")), "a")
                 .join(low.select(F.col("c").alias("b"), F.col("low").alias("lb"), F.col("n").alias("nb")), "b"))
    union = F.slice(F.array_sort(F.array_union("la", "lb")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(union, F.col("la")), F.col("lb")))
    passing = estimated.where(both >= F.least(need(F.col("na"), k, least, percent), need(F.col("nb"), k, least, percent))
                              ).select("a", "b")
    s = sets.select("c", "shingles")
    full = (passing.join(s.select(F.col("c").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(s.select(F.col("c").alias("b"), F.col("shingles").alias("sb")), "b"))
    inter = F.size(F.array_intersect("sa", "sb"))
    return full.where(100 * inter >= percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def least_shared(k: int, percent: int, chance: float = 1e-8) -> int:
    """The number of shared values, among the ``k`` smallest of a union, that a pair at the
    threshold falls short of with less than ``chance`` (binomial tail)."""
    t, tail = percent / 100, 0.0
    for shared in range(k + 1):
        tail += comb(k, shared) * t**shared * (1 - t) ** (k - shared)
        if tail > chance:
            return shared
    return k


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, k: int = 64,
                    broadcast_ids: int = 1_000_000) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Links join sets with ``100 * intersection >= percent * union``.  Ids of the few classes
    whose full sets are needed are broadcast up to ``broadcast_ids`` (16 bytes each), beyond
    that joined by shuffle."""
    spark = docs.sparkSession
    least = least_shared(k, percent)
    base = shared_folder(spark, "near")
    rows = stored(docs.select("doc_id", "text").transform(map_arrow, _set_function(width, k), SKETCHED), f"{base}/rows")
    classes = stored(
        rows.where("doc_id IS NOT NULL AND n > 0").groupBy("print")
        .agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.any_value("low").alias("low"))
        .withColumn("c", F.monotonically_increasing_id()), f"{base}/classes")

    # 2. classes of which enough retained values occur elsewhere
    postings = classes.select("c", F.explode("low").alias("v"))
    shared = stored(postings.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("v"), f"{base}/values")
    hits = postings.join(shared, "v").groupBy("c").agg(F.count(F.lit(1)).alias("hits"))
    wanted = stored(classes.join(hits, "c").where(F.col("hits") >= need(F.col("n"), k, least, percent))
                    .select("c", "print", "first", "n", "low"), f"{base}/wanted")

    # 3. their full sets, and how much of each occurs in another class
    ids = wanted.select(F.col("first").alias("doc_id")).distinct()
    few = wanted.count() <= broadcast_ids
    again = (docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
             .transform(map_arrow, _set_function(width, None), FULL))
    chosen = wanted.select("c", "print")
    sets = stored(again.join(F.broadcast(chosen) if few else chosen, "print")
                  .groupBy("c").agg(F.any_value("n").alias("n"), F.any_value("shingles").alias("shingles")), f"{base}/sets")
    alone = (sets.select("c", F.explode("shingles").alias("h")).groupBy("h")
             .agg(F.count(F.lit(1)).alias("f"), F.min("c").alias("c")).where("f = 1")
             .groupBy("c").agg(F.count(F.lit(1)).alias("alone")))
    members = stored(
        wanted.join(alone, "c", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
        .where(100 * F.col("common") >= percent * F.col("n")).select("c", "n", "common", "low"), f"{base}/members")

    # 4. lists of the rarest retained values, and their pivots
    open_lists = members.select("c", "n", "common", F.size("low").alias("size"), F.explode("low").alias("v"))
    lengths = stored(open_lists.groupBy("v").agg(F.count(F.lit(1)).alias("f")), f"{base}/lengths")
    ranked = (open_lists.join(lengths, "v")
              .withColumn("place", F.row_number().over(Window.partitionBy("c").orderBy("f", "v")))
              .withColumn("weight", F.sum("f").over(Window.partitionBy("c")) / F.col("size"))
              .where(F.col("place") <= F.col("size") - need(F.col("n"), k, least, percent) + 1).where("f > 1"))
    ranked = stored(ranked.select("v", "c", "n", "common", "weight"), f"{base}/lists")
    m = F.struct("weight", (-F.col("c")).alias("order"), "c", "n", "common")
    pivots = ranked.groupBy("v").agg(F.max(m).alias("p"))
    star = (ranked.alias("x").join(pivots.select("v", "p.c", "p.n", "p.common").alias("y"), "v")
            .where(F.col("x.c") != F.col("y.c")).where(may_link("x", "y", percent))
            .select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct())
    star = stored(star, f"{base}/star")
    links = stored(verified(star, members, sets, k, least, percent), f"{base}/star-links")

    # 5. members that share a list with another component: compared by their full sets
    label = components(links)
    labelled = ranked.join(label.withColumnRenamed("node", "c"), "c", "left").withColumn(
        "root", F.coalesce("root", F.col("c")))
    several = labelled.groupBy("v").agg(F.min("root").alias("r0"), F.max("root").alias("r1"),
                                        F.min("n").alias("least_n")).where("r0 <> r1").select("v", "least_n")
    rest = stored(labelled.join(several, "v").where(may_reach("common", percent)).select("c", "n", "root").distinct(),
                  f"{base}/rest")
    pairs = stored(rest_pairs(rest, sets, percent, base), f"{base}/pairs")
    more = stored(verified(pairs, members, sets, k, least, percent), f"{base}/more-links")

    # 6. components over all links; the smallest id names and represents each
    label = components(links.unionByName(more))
    group = (label.join(classes.select(F.col("c").alias("node"), "first", "print"), "node"))
    names = group.groupBy("root").agg(F.min("first").alias("component_id"))
    found = stored(group.join(names, "root").select(F.col("print").alias("_print"), "component_id"), f"{base}/groups")
    named = stored(classes.select("print", "first").join(found, F.col("print") == F.col("_print"), "left")
                   .select(F.col("print").alias("_print"), F.coalesce("component_id", "first").alias("_component")),
                   f"{base}/names")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(
        F.coalesce("_component", "doc_id"))
    return (rows.select("doc_id", "n", "print").join(named, F.col("print") == F.col("_print"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns; rows that repeat one id and text
    stay together.  The verdicts (8 bytes a dropped document) are joined by id."""
    verdicts = near_duplicates(docs, **options)
    dropped = verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("__llm_dropped")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["__llm_dropped"], "left_anti")
