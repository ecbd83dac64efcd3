"""What changed between listings, as a stream: state by source in Structured Streaming's state store.

Each listing is a folder of (source, hash) with its number, put into place by one rename, so the stream meets it whole.
A source's state is its hash and the listing it was last in.  A row with another hash is a change, the first one a new
file, and a source that the next listing does not name is gone: a timer fires for it once the watermark, which
is the newest listing's number as a time, has passed the listing it was in.  So listings come one after
another, each a batch or several in one, and a restart goes on from the checkpoint: nothing is reported twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

LISTING = "listing long, source string, hash string"
CHANGE = "source string, listing long, state string, hash string"
#: The source of a row that each listing has besides its own, so that an empty one moves the watermark, too.
MARK = ""
#: The state store that timers need; a setting of the session.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def publish(listing: DataFrame, root: str, number: int) -> None:
    """Put a listing (source, hash) into place as number ``number``, from 1, whole or not at all."""
    spark = listing.sparkSession
    mark = spark.createDataFrame([(MARK, "")], "source string, hash string")
    rows = listing.select("source", "hash").unionByName(mark).select(F.lit(number).cast("long").alias("listing"), "source", "hash")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    aside, place = path(f"{root}/.aside-{uuid.uuid4().hex}"), path(f"{root}/listing-{number:09d}")
    rows.write.parquet(aside.toString())
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place) or not fs.rename(aside, place):
        fs.delete(aside, True)
        raise FileExistsError(f"listing {number} is in {root} already")


def _time(number: int) -> int:
    """A listing's number as milliseconds."""
    return number * 1000


class _BySource(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hash string, listing long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        source = key[0]
        if source == MARK:
            return
        given = sorted((int(n), h) for part in rows for n, h in zip(part["listing"], part["hash"], strict=True))
        was, at = self.last.get() if self.last.exists() else (None, None)
        if at is not None:
            self.handle.deleteTimer(_time(at) + 1)
        out = []
        for number, now in given:
            if at is not None and number > at + 1:
                out.append((source, at + 1, "gone", None))
                was = None
            if was is None or at is None or was != now:
                out.append((source, number, "new" if was is None else "changed", now))
            was, at = now, number
        self.last.update((was, at))
        self.handle.registerTimer(_time(at) + 1)
        if out:
            yield pd.DataFrame(out, columns=["source", "listing", "state", "hash"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.last.get()[1]
        self.last.clear()
        yield pd.DataFrame([(key[0], at + 1, "gone", None)], columns=["source", "listing", "state", "hash"])

    def close(self) -> None:
        pass


def changes(spark: SparkSession, root: str) -> DataFrame:
    """The stream of changes (source, listing, state, hash) over the listings in ``root``."""
    rows = spark.readStream.schema(LISTING).option("recursiveFileLookup", True).parquet(f"{root}/listing-*")
    timed = rows.withColumn("at", F.timestamp_millis(F.col("listing") * 1000)).withWatermark("at", "0 seconds")
    return timed.groupBy("source").transformWithStateInPandas(
        statefulProcessor=_BySource(), outputStructType=CHANGE, outputMode="Append", timeMode="EventTime"
    )


def append_changes(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Add the changes of all listings that have come since the last call to the table in ``out``, and return."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    query = changes(spark, root).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
