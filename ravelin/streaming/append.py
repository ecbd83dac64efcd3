"""Append-only ingest of new files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators.ingest import chunked, stored
from ravelin.operators.store import SnapshotStore
from ravelin.sources.files import PATTERN, below


def append_new_files(spark: SparkSession, root: str, store: SnapshotStore, checkpoint: str, embed=None) -> None:
    """Chunk and store the files that have come since the last call, and return.

    A file stream tracks paths: it sees neither changes to a file nor deletions, which are the
    snapshot diff's work.  A batch rewrites the buckets of its files only; one that is run again
    replaces what it wrote before.
    """
    files = (
        spark.readStream.schema("value string")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", PATTERN)
        .option("wholetext", True)
        .format("text")
        .load(root)
        .select(below(F.col("_metadata.file_path"), root).alias("source"), F.col("value").alias("content"))
    )

    def write(batch: DataFrame, _: int) -> None:
        store.replace_sources(batch.select("source"), stored(chunked(batch), embed))

    files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
