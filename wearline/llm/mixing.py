"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

1. Every source has a weight.  The sources share all words by weight, no source above
   ``max_epochs`` times its own size; what a capped source leaves is shared again.  That
   fixed point is a water level: source s gets min(cap_s, level * weight_s).  With sources
   in the order of cap / weight the level follows from running sums.
2. Blocks of equal numbers of words go to the sources by highest quotients target / (2a + 1).
   A block has ``block_words`` words, or less where a small source needs it: at most a
   ``1 / fineness`` of the smallest target, a single word at least.  So each source's words come
   within one block, one per cent of its target or one word, whatever the sizes of the others.
   Quotients above total / (2 N - S) surely win and those below total / (2 N + S) surely
   lose, so only about two seats a source are ranked.
3. A source's documents are dealt to shards by a hash of the id; the same method gives every
   shard of a source its integer quota.
4. In its shard a document has a seeded place; the shard's words are a ring cut into blocks.
   Full rounds of the ring come first; the rest is a run of blocks from a seeded block on.
   A document's ``taken`` is the number of its words in the chosen blocks, repeats counted.

Only tables of sources and of shards are ranked or summed in order: the first has a row per
source; a source has at most ``max_shards`` shards.  Documents are ordered within one shard.

* NULL text has size 0 and nothing is taken of it; a source whose documents are all empty
  has target 0.  The NULL source is a source like others, the last in the order.
* Repeated rows are rows of their own: all count, and share one place in the ring's order
  after which their run follows by size.  NULL ids are placed like any other id.
* A very long text is one row, counted by one regular expression.  Only ``doc_id, source`` and
  ``text`` are read; ``repeat_by_taken`` carries further columns, also of clashing names.
* No words at all, or no rows: all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.common import WORD, shared_folder, stored


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def text_hash() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def draw(seed: int, *columns: str) -> Column:
    """A seeded 60-bit number of the columns' text, the same in every engine that has MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size`` to the same plus ``pos, target``; a row per source.

    Weights repeat over the sources in the order of code points, NULL last."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        weight = F.when(F.col("pos") % len(weights) == i, w).otherwise(weight)
    ranked = (sizes.withColumn("pos", F.row_number().over(by_name) - 1)
              .withColumn("weight", weight.cast("double"))
              .withColumn("cap", F.col("source_size").cast("double") * max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Were this source and all later ones uncapped, the level would be `level`; the first
    # source for which it does not reach the cap gives the true level.
    return (ranked
            .withColumn("total", F.sum("source_size").over(everything).cast("double"))
            .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
            .withColumn("level", (F.col("total") - F.col("spent")) / F.col("open"))
            .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
            .withColumn("water", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "pos", "level")))
                        .over(everything).getField("level"))
            .withColumn("target", F.when(F.col("water").isNull(), F.col("cap"))
                        .otherwise(F.least("cap", F.col("water") * F.col("weight"))))
            .select("source", "source_size", "pos", "target"))


def apportion(parties: DataFrame, party: list[str], within: list[str], share: str, seats: str, name: str) -> DataFrame:
    """Adds the integer column ``name``: seats of each party by highest quotients
    share / (2a + 1), ties to the first party in the order of ``party``.

    ``seats`` (equal in all rows of a group ``within``) is the number to give away; parties
    of share 0 get none."""
    group = Window.partitionBy(*within)
    count = F.sum(F.when(F.col(share) > 0, 1).otherwise(0)).over(group)
    total = F.sum(share).over(group)
    n = F.col(seats)

    def won(quotient: Column) -> Column:
        """Seats whose quotient is at least ``quotient``."""
        return F.floor((F.col(share) / quotient + 1) / 2).cast("long")

    # far above the rounding error of doubles, and few seats even of a share of 1e12 blocks
    sure = F.when(2 * n > F.col("_parties"), won(F.col("_total") / (2 * n - F.col("_parties")) * (1 + 1e-12)))
    possible = won(F.col("_total") / (2 * n + F.col("_parties")) * (1 - 1e-12))
    rows = (parties.withColumn("_parties", count).withColumn("_total", total)
            .withColumn("_sure", F.when(F.col(share) > 0, F.coalesce(sure, F.lit(0))).otherwise(F.lit(0)).cast("long"))
            .withColumn("_possible", F.when(F.col(share) > 0, possible).otherwise(F.lit(0)).cast("long"))
            .withColumn("_left", n - F.sum("_sure").over(group)))
    contested = rows.withColumn("_seat", F.explode(F.when(
        F.col("_possible") > F.col("_sure"), F.sequence(F.col("_sure"), F.col("_possible") - 1)).otherwise(
            F.array(F.lit(-1).cast("long")))))
    best = Window.partitionBy(*within).orderBy(
        F.when(F.col("_seat") < 0, 1).otherwise(0), (F.col(share) / (2 * F.col("_seat") + 1)).desc(), *party, "_seat")
    keep = [c for c in parties.columns]
    return (contested.withColumn("_rank", F.row_number().over(best))
            .groupBy(*keep, "_sure")
            .agg(F.sum(F.when((F.col("_seat") >= 0) & (F.col("_rank") <= F.col("_left")), 1).otherwise(0)).alias("_won"))
            .withColumn(name, F.col("_sure") + F.col("_won")).drop("_sure", "_won"))


def mix(docs: DataFrame, *, block_words: int = 64, shard_words: int = 200_000, max_shards: int = 4096,
        max_epochs: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7, fineness: int = 50) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, text_hash`` for every document.

    ``text_hash`` (MD5 of the text) tells repeated ids apart.  The texts are read once: the
    rows without them are stored in the shared folder, later steps read those."""
    spark = docs.sparkSession
    rows = stored(docs.select("doc_id", "source", word_count().alias("size"),
                              text_hash().alias("text_hash")),
                  shared_folder(spark, "mix-sizes"))
    sources = stored(
        source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs, weights)
        .withColumn("shards", F.least(F.lit(max_shards), F.greatest(
            F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("int"))
        .withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(
            F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy()) / fineness))).cast("long")),
        shared_folder(spark, "mix-sources"))
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / F.col("block")).cast("long")
    quotas = apportion(sources.withColumn("blocks", blocks), ["pos"], [], "target", "blocks", "quota").drop("blocks")

    dealt = (attach_sources(rows, sources)
             .withColumn("shard", (draw(seed, "doc_id") % F.col("shards")).cast("int")))
    shard_sizes = dealt.groupBy("pos", "shard").agg(F.sum("size").alias("shard_size"))
    shard_quota = apportion(
        quotas.select("pos", "quota", "block").join(shard_sizes, "pos"), ["shard"], ["pos"], "shard_size", "quota", "shard_quota")
    # The run of blocks starts at a seeded block; no shard is taken more than max_epochs times.
    plan = (shard_quota
            .withColumn("words", F.least(F.col("shard_quota") * F.col("block"), F.col("shard_size") * max_epochs))
            .withColumn("rounds", F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0).cast("long"))
            .withColumn("rest", F.col("words") - F.col("rounds") * F.col("shard_size"))
            .withColumn("start", draw(seed + 1, "pos", "shard")
                        % F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))) * F.col("block"))
            .select("pos", "shard", "shard_size", "rounds", "rest", "start"))
    plan = stored(plan, shared_folder(spark, "mix-plan"))

    place = Window.partitionBy("pos", "shard").orderBy(draw(seed + 2, "doc_id"), "doc_id", "text_hash", "size")
    placed = dealt.withColumn("end", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    begin, end, start, size = F.col("end") - F.col("size"), F.col("end"), F.col("start"), F.col("shard_size")

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(end, hi) - F.greatest(begin, lo))

    first = overlap(start, F.least(start + F.col("rest"), size))
    wrapped = overlap(F.lit(0), start + F.col("rest") - size)
    small = plan.count() <= 100_000  # 48 bytes a row
    return (placed.join(F.broadcast(plan) if small else plan, ["pos", "shard"])
            .withColumn("taken", F.col("rounds") * F.col("size") + first + wrapped)
            .select("doc_id", "source", "size", "source_size", "target", "taken", "text_hash"))


def attach_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Each document with its source's row.  The table of sources is broadcast while it has
    at most 100,000 rows (some 10 MB); a larger one is joined by shuffle, where the
    null-safe comparison lets the adaptive planner split a hot source."""
    right = sources.withColumnRenamed("source", "_source")
    if sources.count() <= 100_000:
        right = F.broadcast(right)
    return rows.join(right, rows["source"].eqNullSafe(right["_source"])).drop("_source")


def repeat_by_taken(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix as rows: every document as often as its words were taken, rounded to whole
    documents by a seeded fraction; same columns as ``docs``."""
    copies = (mixed.where(F.col("taken") > 0)
              .withColumn("whole", F.floor(F.col("taken") / F.col("size")))
              .withColumn("part", F.col("taken") / F.col("size") - F.col("whole"))
              .withColumn("copies", (F.col("whole") + F.when(
                  draw(99, "doc_id", "text_hash") % 1_000_000 < F.col("part") * 1_000_000, 1).otherwise(0)).cast("int"))
              .groupBy(F.col("doc_id").alias("__llm_id"), F.col("text_hash").alias("__llm_hash"))
              .agg(F.max("copies").alias("__llm_copies")).where(F.col("__llm_copies") > 0))
    keyed = docs.withColumn("__llm_text", text_hash())
    return (keyed.join(copies, keyed["doc_id"].eqNullSafe(copies["__llm_id"]) & (keyed["__llm_text"] == copies["__llm_hash"]))
            .withColumn("__llm_copy", F.explode(F.sequence(F.lit(1), F.col("__llm_copies")))).select(*docs.columns))
