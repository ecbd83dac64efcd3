"""Document sources: folder trees and tar archives."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PATTERN = "*.{md,mdx,txt}"


def document_files(spark: SparkSession, root: str) -> DataFrame:
    """(source, content) of all Markdown and text files below ``root``.

    The source is the path below the root.  Files whose names start with a dot or an
    underscore are hidden from Spark's readers and so are not documents here.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", PATTERN).text(root, wholetext=True)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(below(path, root).alias("source"), F.col("value").alias("content"))


def below(path: F.Column, root: str) -> F.Column:
    """The part of a file's path below a folder, with forward slashes."""
    plain = root.rstrip("/").split("://", 1)[-1]
    plain = plain.removeprefix("file:")
    return F.replace(F.element_at(F.split(path, F.concat(F.lit("\\Q"), F.lit(plain + "/"), F.lit("\\E")), 2), -1), F.lit("\\"), F.lit("/"))


def count_files(spark: SparkSession, root: str) -> int:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path").count()


def archived_files(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(source, content) of the text files in tar archives (plain or compressed), one task an archive.

    Only entries whose stored path starts with ``prefix`` are unpacked; the first
    component of the path is stripped.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                with tarfile.open(fileobj=io.BytesIO(data.as_py()), mode="r:*") as tar:
                    for entry in tar:
                        if not entry.isfile() or not entry.name.startswith(prefix):
                            continue
                        name = entry.name.partition("/")[2]
                        if not name.endswith((".md", ".mdx", ".txt")):
                            continue
                        text = tar.extractfile(entry).read().decode("utf-8", "replace")
                        yield pa.RecordBatch.from_pydict({"source": [name], "content": [text]})

    archives = spark.read.format("binaryFile").load(path).select("content")
    return archives.mapInArrow(unpack, "source string, content string")
