"""The ingest as a Structured Streaming job over a folder where raw files arrive.

Same parser and table layout as the batch ingest.  A micro-batch only says *which* data
sets have new files; each of those is then loaded again from all that has been delivered for
it (``sources.ingest.ingest_files``, newest delivery of a file wins).  The result therefore
does not depend on how files fall into micro-batches, and a replayed batch writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wearline.session import join_path, scratch_dir
from wearline.sources.ingest import ingest_files
from wearline.sources.text import FILE_NAME_PATTERN, file_metadata


def arrivals(spark: SparkSession, source_dir: str) -> DataFrame:
    """Paths of newly arriving ``train_/test_/RUL_<id>.txt`` files below ``source_dir`` (any
    depth).  Each path is seen once: a re-delivered file arrives under a new folder."""
    df = (spark.readStream.format("text").option("pathGlobFilter", "*.txt")
          .option("recursiveFileLookup", "true").load(source_dir))
    return (df.select(F.col("_metadata.file_path").alias("source"))
            .where(F.col("source").rlike(FILE_NAME_PATTERN)))


def ingest_stream(spark: SparkSession, source_dir: str, table_path: str,
                  checkpoint: str | None = None, available_now: bool = True,
                  labels_path: str | None = None) -> StreamingQuery:
    """Start the streaming ingest; ``available_now`` processes what is there and stops.

    Readings go into ``table_path``, label files into ``labels_path`` when given."""
    def write_batch(batch: DataFrame, _epoch: int) -> None:
        dataset_id, dataset_type = file_metadata(F.col("source"))
        # At most one row per data set and type of the batch.
        touched = batch.select(dataset_id.alias("i"), dataset_type.alias("t")).distinct().collect()
        if touched:
            ingest_files(spark, source_dir, table_path, labels_path, only={(r["i"], r["t"]) for r in touched})

    ckpt = checkpoint or join_path(scratch_dir(spark), "wearline-stream",
                                   table_path.strip("/").replace("/", "_").replace(":", "_"))
    writer = arrivals(spark, source_dir).writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute")
    return writer.start()
