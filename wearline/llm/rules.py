"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed rules fail a text of fewer than 20 words, or of which over 30 % of the words lie in
8-word windows that the text repeats.  All other rules take their cutoffs from the data: per
language and source, a quantile sketch of each measure gives the 20 % and the 80 % quantile,
and a document is rejected outside ``q80 + 6 * (q80 - q20)`` and ``q20 - 6 * (q80 - q20)``.
Junk may make up a fifth of a group without moving the fences.

A group's quantiles are blended with those of its language as if ``prior`` documents of the
language's kind were added, the language's in the same way with those of all documents: small
groups follow their language, large ones themselves, and one more document changes little.

A measure that hardly varies (most documents repeat no line) would reject its first exception;
its fences keep a distance of at least ``FLOOR`` from the quantiles.

The sketch is a histogram with logarithmic bins: integers below 64 have a bin each, larger
ones are kept to a 32nd.  Sketches merge by adding counts, so partial aggregates of one hot
group combine before the shuffle, and the sketch of a language or of all documents is the
sum of its sources' sketches.

* NULL text has no words: the base fails.  NULL language or source is a group of its own.
* Repeated rows count as often as they occur; NULL ids get their verdict like others.
* Documents that fail the base do not enter the sketches; if none pass, no cutoff is needed.
* A very long text is measured inside its row: the keys of all its 8-word windows (16 bytes a
  word) must fit into Spark's 2 GB of one row, which bounds a text to some 100 million words.
* An empty table gives no rows; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.common import WORD, shared_folder, stored

BLANKS = r"\x20\x09-\x0D"
MARKS = r"!-/:-@\[-`{-~"  # ASCII punctuation
# Measure -> least distance of a fence from its quantile; all measures are integers (shares per
# mille, word length in hundredths).
FLOOR = {"symbols": 40, "marks": 15, "capitals": 10, "length": 20, "same_lines": 400, "repeated": 285, "doubled": 10}
REACH = 6  # distance of a fence in spreads
TWO_SIDED = ("length",)


def share(part: str, whole: str, scale: int = 1000) -> Column:
    """floor(scale * part / whole) in integers, 0 for an empty whole."""
    return F.when(F.col(whole) > 0, F.expr(f"({scale} * {part}) div {whole}")).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame, span: int = 8) -> DataFrame:
    """``doc_id, lang, source``, the base counts and the measures of every text.

    Arrays stay inside their row and nothing is shuffled.  Arrays that a lambda reads are made
    by a one-element generator: the optimizer moves no expression through it, so they are
    made once a row and not once an element."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def left(pattern: str) -> Column:
        """Characters outside the runs of ``pattern``."""
        return F.length(F.regexp_replace("text", pattern, "")).cast("long")

    step = (docs.select("doc_id", "lang", "source", text.alias("text"))
            .withColumn("words", F.explode(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))))
            .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))))
    step = step.select(
        "doc_id", "lang", "source", "words", F.size("words").cast("long").alias("n_words"),
        (F.length("text") - left(rf"[^{BLANKS}]+")).alias("word_chars"),
        left(r"[^#*$%&|<>]+").alias("n_symbols"), left(rf"[^{MARKS}]+").alias("n_marks"),
        left(r"\P{Lu}+").alias("n_capitals"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("size(filter(words, (w, i) -> w = get(words, i - 1)))").cast("long").alias("n_doubled"),
        F.expr(f"CASE WHEN size(words) > {span} THEN transform(sequence(1, size(words) - {span - 1}), "
               f"i -> xxhash64(slice(words, i, {span}))) END").alias("keys"))
    # Sorted by (key, place), keys that occur again are neighbours.
    step = (step.drop("words")
            .withColumn("pairs", F.expr("explode(array(CASE WHEN size(array_distinct(keys)) < size(keys) THEN "
                                        "sort_array(transform(keys, (k, i) -> struct(k AS k, i AS i))) END))"))
            .drop("keys")
            .withColumn("places", F.expr("explode(array("
                "sort_array(transform(filter(transform(pairs, (x, j) -> struct(x.i AS i, "
                "x.k <=> get(pairs, j - 1).k OR x.k <=> get(pairs, j + 1).k AS again)), y -> y.again), y -> y.i))))")).drop("pairs")
            # Each place covers `span` words, less the overlap with the next place.
            .withColumn("n_repeat_words", F.expr(
                f"coalesce(aggregate(transform(places, (x, j) -> least({span}, coalesce(get(places, j + 1) - x, {span}))), "
                "0L, (a, x) -> a + x), 0L)")).drop("places"))
    return step.select(
        "*", share("n_symbols", "word_chars").alias("symbols"), share("n_marks", "word_chars").alias("marks"),
        share("n_capitals", "word_chars").alias("capitals"), share("word_chars", "n_words", 100).alias("length"),
        share("n_dup_lines", "n_lines").alias("same_lines"), share("n_repeat_words", "n_words").alias("repeated"),
        share("n_doubled", "n_words").alias("doubled"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"))


def bin_of(value: str) -> Column:
    """Bin of an integer >= 0: itself below 64, else its exponent and next five bits."""
    e = f"(length(bin({value})) - 6)"
    return F.expr(f"CASE WHEN {value} < 64 THEN {value} ELSE {e} * 32 + shiftright({value}, {e}) END").cast("long")


def bin_floor(bin_: str) -> Column:
    """Smallest integer of a bin."""
    return F.expr(f"CASE WHEN {bin_} < 64 THEN {bin_} ELSE "
                  f"shiftleft({bin_} % 32 + 32, cast({bin_} div 32 - 1 AS int)) END").cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """``lang, source, measure, bin, n``: the sketch of every group and measure."""
    pairs = ", ".join(f"'{m}', {m}" for m in FLOOR)
    return (measured.where(~F.col("base_failed"))
            .selectExpr("lang", "source", f"stack({len(FLOOR)}, {pairs}) AS (measure, value)")
            .groupBy("lang", "source", "measure", bin_of("value").alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def quantiles(merged: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches (one per ``keys`` and measure) to ``keys, docs, low_<m>, high_<m>``: the 20 % and
    the 80 % quantile, each the first bin at which the running count reaches its share."""
    group = Window.partitionBy(*keys, "measure")
    running = (merged.withColumn("run", F.sum("n").over(group.orderBy("bin")))
               .withColumn("docs", F.sum("n").over(group)).withColumn("value", bin_floor("bin")))
    found = running.groupBy(*keys, "measure").agg(
        F.max("docs").alias("docs"), F.min(F.when(5 * F.col("run") >= F.col("docs"), F.col("value"))).alias("low"),
        F.min(F.when(5 * F.col("run") >= 4 * F.col("docs"), F.col("value"))).alias("high"))
    columns = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{side}_{m}") for m in FLOOR for side in ("low", "high")]
    return found.groupBy(*keys).agg(F.max("docs").alias("docs"), *columns)


def blended(own: Column, docs: Column, prior: int, parent: Column) -> Column:
    """The mean of a group's quantile and its parent's, which counts as ``prior`` documents."""
    return (docs * own + prior * parent) / (docs + prior).cast("double")


def thresholds(sketched: DataFrame, prior: int) -> DataFrame:
    """``lang, source`` and the fences that hold for the group."""
    sides = [f"{side}_{m}" for m in FLOOR for side in ("low", "high")]

    def merged(keys: list[str]) -> DataFrame:
        return quantiles(sketched.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n")), keys)

    own = merged(["lang", "source"])
    of_lang = merged(["lang"]).select(F.col("lang").alias("_lang"), F.col("docs").alias("_docs"),
                                      *[F.col(c).alias(f"_{c}") for c in sides])
    of_all = merged([]).select(F.struct(*sides).alias("everything")).scalar()
    joined = own.join(of_lang, own["lang"].eqNullSafe(of_lang["_lang"]), "left")
    joined = joined.select("lang", "source", *[
        blended(F.col(c), F.col("docs"), prior, blended(F.col(f"_{c}"), F.col("_docs"), prior, of_all.getField(c))).alias(c)
        for c in sides])
    fenced = []
    for m, floor in FLOOR.items():
        reach = F.greatest(REACH * (F.col(f"high_{m}") - F.col(f"low_{m}")), F.lit(float(floor)))
        fenced += [(F.col(f"low_{m}") - reach).alias(f"low_{m}"), (F.col(f"high_{m}") + reach).alias(f"high_{m}")]
    return joined.select("lang", "source", *fenced)


def quality_rules(docs: DataFrame, *, prior: int = 100, broadcast_groups: int = 100_000) -> DataFrame:
    """Base counts, measures, ``base_failed`` and ``kept`` for every document.

    The texts are read once; the measures (numbers only) are stored in the shared folder and
    read for the sketches and again for the verdicts.  The thresholds are broadcast up to
    ``broadcast_groups`` groups (some 20 MB), beyond that joined by shuffle; the null-safe
    comparison then gives the adaptive planner an exchange on which to split a hot group."""
    spark = docs.sparkSession
    base = shared_folder(spark, "rules")
    measured = stored(measures(docs), f"{base}/measures")
    cutoffs = stored(thresholds(stored(sketches(measured), f"{base}/sketches"), prior), f"{base}/thresholds")
    right = cutoffs.withColumnRenamed("lang", "_lang").withColumnRenamed("source", "_source")
    if cutoffs.count() <= broadcast_groups:
        right = F.broadcast(right)
    inside = F.lit(True)
    for m in FLOOR:
        inside = inside & (F.col(m) <= F.col(f"high_{m}"))
        if m in TWO_SIDED:
            inside = inside & (F.col(m) >= F.col(f"low_{m}"))
    joined = measured.join(right, measured["lang"].eqNullSafe(right["_lang"])
                           & measured["source"].eqNullSafe(right["_source"]), "left")
    return joined.select(*measured.columns, (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))
