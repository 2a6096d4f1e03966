"""The corpus pipeline: quality, near duplicates, repeated passages, source mix, tokens.

Each stage takes all that its predecessor kept, and its decisions take effect.  ``run``
stores every stage as Parquet in the shared folder and reads it back, so a lost executor
never costs more than the running stage's tasks.

* NULL text is an empty text: scored, never a duplicate, without words or tokens.
* Repeated rows (one id, one text) share every verdict; NULL ids are linked with nothing.
* Empty tables pass through; further columns of ``documents`` are carried to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wearline.llm import bpe, classifier, mixing, near, repeats
from wearline.llm.common import remove, shared_folder, stored, sweeping, table
from wearline.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8 or more), the
    one of the smallest id."""
    return near.drop_near_duplicates(docs, width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, passages that occur earlier cut out of their texts."""
    return repeats.cut_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents left out or repeated (up to three times) so that sources meet their targets."""
    return mixing.repeat_by_taken(docs, mixing.mix(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every document of the mix."""
    return bpe.encode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mix", source_mix),
    ("bpe encoding", tokens),
]

# A trained classifier, digests of windows and a vocabulary's merges are beyond SQL; the
# tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the table ``documents``.

    A stage's intermediate tables, and the result of the stage before, are removed when its own
    result is written; the last result stays in the shared folder (``common.sweep`` removes it)."""
    docs = table(spark, sf_dir, "documents")
    base = shared_folder(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        with sweeping(spark):
            docs = stored(stage(spark, docs, sf_dir), f"{base}/{i}")
        if i:
            remove(spark, f"{base}/{i - 1}")
    return docs
