"""Helpers that the operators share: tables, shared folder, words, safe columns."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine, as in tests, a local folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = _own_dir.setdefault("dir", "")
        if not path:
            path = _own_dir["dir"] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/ravelin/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null becomes the empty text."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def hand_back() -> None:
    """Give the memory that this Python process has freed back to the system.

    Spark uses its Python workers again; what their allocators keep of one stage would be
    missing in the next.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices, so that what is made of one stays small.

    After each batch and at the end freed memory is handed back.
    """
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
        del batch
        hand_back()
    hand_back()


def ascii_words(text: bytes) -> list[bytes]:
    """Words of ``WORD`` after lower-casing A-Z only (bytes.lower touches nothing else)."""
    return text.lower().split()


#: Rows of ids, some 30 bytes each, up to which a table is broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def broadcast_if_small(ids: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A written table of ids, to be broadcast if it has ``most`` rows at most, else shuffled."""
    return F.broadcast(ids) if ids.count() <= most else ids


def hash60(key: Column, seed: str) -> Column:
    """Hash of 60 bits in [0, 2**60), which any SQL engine with md5 can repeat."""
    digest = F.md5(F.concat(F.lit(seed + ":"), key))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def id_text(name: str) -> Column:
    """An id as text; a null id is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns that an operator is about to add; the computed column wins."""
    return df.drop(*[c for c in names if c in df.columns])


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs.

    Spark deletes a shuffle once the driver's garbage collector finds that nothing
    refers to it; a long program that waits for that by chance fills the disks.  Spark's listeners
    hold the last query that ended, so an empty one follows it.
    """
    gc.collect()
    spark.sql("SELECT 1").collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made, when nothing reads it any more."""
    context = df.sparkSession.sparkContext
    for file in df.inputFiles()[:1]:
        path = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/ravelin/" in path.toString():
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
