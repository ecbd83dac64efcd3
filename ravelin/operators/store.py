"""A chunk store of versioned buckets, and the keyed changes that lead from one to the next."""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Of the rows with one key, the last in the given order."""
    latest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_sources(rows: DataFrame, sources: DataFrame, source: str = "source") -> DataFrame:
    """``rows`` without those of the given sources."""
    gone = sources.select(F.col("source").alias("__gone")).distinct()
    return rows.join(gone, F.col(source) == F.col("__gone"), "left_anti")


@dataclass(frozen=True)
class Head:
    """What a store's current pointer says: its number, the version that holds each bucket, and the bucket's rows."""

    number: int = -1
    versions: dict[int, str] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)
    #: How many buckets each version had when it was written.
    whole: dict[str, int] = field(default_factory=dict)


class ChunkStore(Protocol):
    """What ingest, search and chat need of a store."""

    schema: str

    def read(self) -> DataFrame: ...

    def write(self, rows: DataFrame) -> None: ...

    def replace_sources(self, sources: DataFrame, rows: DataFrame) -> None: ...

    def count(self) -> int: ...

    def healthy(self) -> bool: ...

    def clear(self) -> None: ...


class SnapshotStore:
    """A table in a folder of any store Spark writes to, in buckets by a hash of ``key``.

    Spark's partitioned writer puts a version's rows into a folder a bucket.  A pointer, a small file with the next
    number, names the version that holds each bucket, so a change writes the buckets it touches and no others.  The pointer
    with the highest number counts: readers see all of a change or nothing of it, and a failed run changes
    nothing.  A pointer is written aside and put into place under its number only if there is none yet,
    so of two writers that started from the same state one gets an error (by a hard link on a local file system; elsewhere
    by a rename that does not replace).  Versions of the last two pointers are kept for readers that are under way.

    Without a key all rows are in one bucket.  A bucket is rewritten whole: choose ``buckets`` so that one
    is some hundred megabytes.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str,
        key: str | None = None,
        buckets: int = 1,
        by: Callable[[Column, int], Column] = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)),
    ):
        self.spark, self.root, self.schema, self.key, self.buckets, self.by = spark, root.rstrip("/"), schema, key, buckets, by
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # -- pointers ----------------------------------------------------------------

    def _numbers(self) -> list[int]:
        """The pointers' numbers, the newest first."""
        folder = self._path(self.root)
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((int(n.removeprefix("current-")) for n in names if n.startswith("current-")), reverse=True)

    def _pointer(self, number: int) -> str:
        return f"{self.root}/current-{number:012d}"

    def _head(self, number: int) -> Head:
        source = self._fs.open(self._path(self._pointer(number)))
        try:
            said = json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()
        return Head(number, *({int(k): v for k, v in said[name].items()} for name in ("versions", "rows")), said["whole"])

    def head(self) -> Head:
        numbers = self._numbers()
        return self._head(numbers[0]) if numbers else Head()

    def _put(self, head: Head) -> None:
        aside = self._path(f"{self.root}/aside-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(json.dumps({"versions": head.versions, "rows": head.rows, "whole": head.whole}).encode())
        out.close()
        place = self._path(self._pointer(head.number))
        jvm = self.spark.sparkContext._jvm
        try:
            if self._fs.getScheme() == "file":
                on_disk = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(on_disk(place), on_disk(aside))
            else:
                how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self._conf).rename(aside, place, how)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                raise FileExistsError(f"another writer has committed to {self.root}") from None
            raise
        finally:
            self._fs.delete(aside, False)

    # -- reading -----------------------------------------------------------------

    @property
    def version(self) -> int | None:
        """The number of the current pointer."""
        return (self._numbers() or [None])[0]

    def bucket_of(self, key: Column) -> Column:
        return self.by(key, self.buckets).cast("int")

    def buckets_of(self, sources: DataFrame) -> list[int]:
        """The buckets of the sources (source): at most as many numbers as there are buckets."""
        return sorted(r["b"] for r in sources.select(self.bucket_of(F.col("source")).alias("b")).distinct().collect())

    def _folders(self, head: Head, buckets: Iterable[int] | None = None) -> list[str]:
        """The folders of the buckets, one for all of a version of which every bucket is asked for."""
        asked = head.versions if buckets is None else {b: head.versions[b] for b in buckets if b in head.versions}
        uses = Counter(asked.values())
        whole = sorted(v for v, n in uses.items() if n == head.whole.get(v))
        return [f"{self.root}/{v}" for v in whole] + [f"{self.root}/{v}/bucket={b}" for b, v in sorted(asked.items()) if v not in whole]

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*folders)

    def read(self, buckets: Iterable[int] | None = None, head: Head | None = None) -> DataFrame:
        """The current rows, or those of some buckets; none of an absent store."""
        return self._rows(self._folders(head or self.head(), buckets))

    def read_staged(self, version: str) -> DataFrame:
        return self._rows([f"{self.root}/{version}"])

    def of_sources(self, sources: Iterable[str]) -> DataFrame:
        """The rows of a few sources: other buckets are not opened, and files are sorted by the key."""
        asked = [(s,) for s in sources]
        found = self.read(self.buckets_of(self.spark.createDataFrame(asked, "source string")))
        return found.filter(F.col(self.key).isin([s for s, in asked]))

    def healthy(self) -> bool:
        """Whether the current versions are whole and of the store's columns (an absent store is): one footer a version is read."""
        try:
            head = self.head()
            for version in set(head.versions.values()):
                if not self._fs.exists(self._path(f"{self.root}/{version}/_SUCCESS")):
                    return False
                found = self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/{version}")
                if not {f.name for f in self._rows([]).schema} <= set(found.columns):
                    return False
        except Exception:  # whatever the store raises, the answer is no
            return False
        return True

    def read_or_empty(self) -> DataFrame:
        """The current rows, or none where they cannot be read."""
        return self.read() if self.healthy() else self.spark.createDataFrame([], self.schema)

    def count(self) -> int:
        """The rows of all buckets, as the pointer has them."""
        return sum(self.head().rows.values())

    # -- writing -----------------------------------------------------------------

    def stage(self, rows: DataFrame) -> str:
        """Write ``rows`` as a version that nobody reads yet; its name.

        Spark balances the buckets over tasks, and splits large ones.  Files are sorted by the key, which has
        a Bloom filter, so that a filter on it skips files and row groups.
        """
        version = f"v-{uuid.uuid4().hex}"
        rows = rows.select(*self._rows([]).columns)
        if self.key:
            bucket = self.bucket_of(F.col(self.key))
            rows = rows.withColumn("bucket", bucket).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", F.col(self.key))
        else:
            rows = rows.withColumn("bucket", F.lit(0))
        self._write(rows, f"{self.root}/{version}")
        return version

    def _write(self, rows: DataFrame, path: str) -> None:
        writer = rows.write.partitionBy("bucket")
        if self.key:
            # adaptive: a small file has a small filter, else each file has one of a megabyte
            writer = writer.option(f"parquet.bloom.filter.enabled#{self.key}", True).option("parquet.bloom.filter.adaptive.enabled", True)
        writer.parquet(path)

    def _staged_buckets(self, version: str) -> dict[int, int]:
        """The rows of each bucket of a staged version, from the footers of its files."""
        first = self._rows([]).schema.fieldNames()[0]
        staged = self.spark.read.schema(f"{first} string, bucket int").parquet(f"{self.root}/{version}")
        return {r["bucket"]: r["count"] for r in staged.groupBy("bucket").count().collect()}  # a row a bucket

    def commit(self, version: str, base: Head | None = None, buckets: Iterable[int] | None = None) -> None:
        """Make a staged version the current one: of ``buckets``, or of all.

        ``base`` is the head that the version was made from; if another commit came since, this one is an error.
        Folders that neither this pointer nor the one before names are deleted.
        """
        base = base or self.head()
        rows = self._staged_buckets(version)
        gone = set(base.versions if buckets is None else buckets)
        kept = {b: v for b, v in base.versions.items() if b not in gone}
        versions = kept | dict.fromkeys(rows, version)
        whole = {v: n for v, n in base.whole.items() if v in kept.values()} | ({version: len(rows)} if rows else {})
        self._put(Head(base.number + 1, versions, {b: n for b, n in base.rows.items() if b in kept} | rows, whole))
        self._tidy(base.number + 1)

    def _tidy(self, number: int) -> None:
        live = {(b, v) for n in (number, number - 1) if n >= 0 for b, v in self._head(n).versions.items()}
        for old in [n for n in self._numbers() if n < number - 1]:
            for b, v in self._head(old).versions.items():
                if (b, v) not in live:
                    whole = v not in {x for _, x in live}
                    self._fs.delete(self._path(f"{self.root}/{v}" if whole else f"{self.root}/{v}/bucket={b}"), True)
            self._fs.delete(self._path(self._pointer(old)), False)

    def drop(self, version: str) -> None:
        """Delete a staged version."""
        self._fs.delete(self._path(f"{self.root}/{version}"), True)

    def write(self, rows: DataFrame) -> None:
        """Make ``rows`` the store's rows."""
        base = self.head()
        self.commit(self.stage(rows), base)

    def replace_sources(self, sources: DataFrame, rows: DataFrame, base: Head | None = None) -> None:
        """Put ``rows`` in place of all rows of ``sources`` (source), in the buckets of these only."""
        base = base or self.head()
        touched = self.buckets_of(sources)
        kept = delete_sources(self.read(touched, base), sources, self.key)
        self.commit(self.stage(kept.unionByName(rows)), base, touched)

    def clear(self) -> None:
        self._fs.delete(self._path(self.root), True)
