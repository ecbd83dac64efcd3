"""A chunk store as flat JSON lines; a keyed merge keeps first positions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators.store import Head, SnapshotStore, delete_sources

CORRUPT = "_corrupt_record"
POSITION = "position"


def merged(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``new`` put into ``old`` by key; both have a position, too.

    A row that is there keeps its position and takes the last of its new values; others follow after the last old
    position, where they first come in ``new``.  One grouping by key, whose rows are combined before the shuffle.
    """
    last = old.agg(F.max(POSITION).alias("last")).first()["last"]
    end = 0 if last is None else last + 1
    values = [c for c in old.columns if c not in (key, POSITION)]
    placed = new.select(key, *values, (F.col(POSITION) + F.lit(end)).alias(POSITION))
    whole = F.struct(*[F.col(c) for c in values])
    found = old.select(key, *values, POSITION).unionByName(placed).groupBy(key).agg(F.min(POSITION).alias(POSITION), F.max_by(whole, POSITION).alias("__v"))
    return found.select(key, *[F.col("__v").getField(c).alias(c) for c in values], POSITION)


class JsonStore(SnapshotStore):
    """As ``SnapshotStore``, in JSON lines and one bucket, each row with its position.

    A store that is not there is empty.  One with a line that is no JSON of its schema is not healthy: it reads as empty by
    ``read_or_empty`` and fails by ``read``.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, source: str = "metadata.source"):
        super().__init__(spark, root, f"{schema}, {POSITION} long")
        self.source, self.rows_schema = source, schema

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).option("mode", "FAILFAST").json(folders)

    def read(self, buckets: Iterable[int] | None = None, head: Head | None = None) -> DataFrame:
        return self.positioned(head).drop(POSITION)

    def positioned(self, head: Head | None = None) -> DataFrame:
        """The rows with their positions."""
        return super().read(None, head)

    def corrupt(self) -> DataFrame:
        """Lines that are no JSON of the schema."""
        folders = self._folders(self.head())
        if not folders:
            return self.spark.createDataFrame([], f"{CORRUPT} string")
        row = F.from_json("value", f"{self.schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
        lines = self.spark.read.option("recursiveFileLookup", True).text(folders).select(row.alias("r"))
        return lines.select(f"r.{CORRUPT}").filter(F.col(CORRUPT).isNotNull())

    def healthy(self) -> bool:
        """Whether every line can be read; JSON has no footers that would say so."""
        try:
            return self.corrupt().isEmpty()
        except Exception:  # whatever the store raises, the answer is no
            return False

    def read_or_empty(self) -> DataFrame:
        return self.read() if self.healthy() else self.spark.createDataFrame([], self.rows_schema)

    def stage(self, rows: DataFrame) -> str:
        if POSITION not in rows.columns:
            rows = rows.withColumn(POSITION, F.monotonically_increasing_id())
        return super().stage(rows)

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.partitionBy("bucket").option("ignoreNullFields", False).json(path)

    def _staged_buckets(self, version: str) -> dict[int, int]:
        n = self.read_staged(version).count()
        return {0: n} if n else {}

    def upsert(self, rows: DataFrame, key: str = "id") -> None:
        """Merge ``rows`` by key; they have a position of their own, or come in any order."""
        if POSITION not in rows.columns:
            rows = rows.withColumn(POSITION, F.monotonically_increasing_id())
        base = self.head()
        self.commit(self.stage(merged(self.positioned(base), rows, key)), base)

    def replace_sources(self, sources: DataFrame, rows: DataFrame, base: Head | None = None) -> None:
        base = base or self.head()
        kept = delete_sources(self.positioned(base), sources, self.source)
        last = kept.agg(F.max(POSITION).alias("last")).first()["last"]
        new = rows.withColumn(POSITION, F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1))
        self.commit(self.stage(kept.unionByName(new)), base)
