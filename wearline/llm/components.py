"""Connected components by alternating star operations, all in DataFrames.

Every round replaces each node's edges by edges to its smallest neighbour: the large-star
step does so for the neighbours above the node, the small-star step for those below it.
The graph's components never change and after a number of rounds logarithmic in the longest
path every node points to the smallest node of its component.  A round groups and joins on
the node; minima are pre-aggregated, and each round is stored in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import remove, shared_folder, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root``: for every node of ``edges`` (long columns ``a, b``) the smallest node
    of its component.

    NULL ends and loops are ignored; repeated edges change nothing; no edges give no rows."""
    spark = edges.sparkSession
    base = shared_folder(spark, "components")
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .distinct(), f"{base}/0")
    before = None
    for i in range(1, max_rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above the node go to the smallest of its neighbourhood
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = stored(large, f"{base}/{i}-large")
        # small star: neighbours below the node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = stored(small, f"{base}/{i}")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, f"{base}/{i - 1}")
        remove(spark, f"{base}/{i}-large")
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
