"""An inverted index in blocks, and an exact top-k search that skips most of them.

Texts are dealt into ranges of some ``RANGE_TEXTS`` texts that are alike in their largest weight.  A block holds the
postings of one term in one range, and its largest weight; a term that every text has is split over all ranges.
Blocks lie in buckets by their term's number, sorted by it, in a ``SnapshotStore``.

A search opens the buckets of its terms only.  From the blocks' largest weights, without their postings, follows what a
text of a range can score at most.  Each query first scores its ``FIRST`` most promising ranges whole; the k-th best of
these bounds the result from below, and of all other ranges only those that can reach it are scored.  Every text is
in one range, so nothing is scored twice and nothing is missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.config import DEFAULT
from ravelin.operators.sparse import small, top_k
from ravelin.operators.store import SnapshotStore

RANGE_TEXTS = 512
#: Ranges that a query scores before it skips any.
FIRST = 4
#: Blocks of a search, some 40 bytes each, up to which their list is held by the driver and broadcast to the postings; beyond, they are shuffled.
MAX_BLOCKS = 200_000
#: Rows of queries' terms up to which these are broadcast.
MAX_TERMS = 500_000


def index_store(spark: SparkSession, root: str, id_type: str = "string", buckets: int = 64) -> SnapshotStore:
    schema = f"ix int, range long, n int, max_w double, entries array<struct<id: {id_type}, w: double>>"
    return SnapshotStore(spark, root, schema, "ix", buckets, by=lambda ix, n: F.pmod(ix, F.lit(n)))


def blocks(vectors: DataFrame, range_texts: int = RANGE_TEXTS) -> DataFrame:
    """Blocks of texts (id, sparse).  Texts whose largest weights share a quarter of a power of two are alike."""
    alike = F.floor(-4 * F.log2(F.array_max("sparse.values"))).cast("long")
    rows = vectors.filter(F.size("sparse.indices") > 0).select("id", "sparse", alike.alias("alike"))
    sizes = rows.groupBy("alike").agg(F.ceil(F.count("*") / range_texts).alias("parts"))  # a row a quarter power: some hundred
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    entry = F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("e")
    entries = rows.join(F.broadcast(sizes), "alike").select("id", (F.shiftleft(F.col("alike"), 40) + part).alias("range"), entry)
    return (
        entries.select(F.col("e.indices").alias("ix"), "range", F.struct("id", F.col("e.values").alias("w")).alias("entry"))
        .groupBy("ix", "range")
        .agg(F.count("*").cast("int").alias("n"), F.max("entry.w").alias("max_w"), F.collect_list("entry").alias("entries"))
    )


def build(index: SnapshotStore, vectors: DataFrame, range_texts: int = RANGE_TEXTS) -> None:
    index.write(blocks(vectors, range_texts))


class Search:
    """A search of an index by weighted terms (qid, ix, w)."""

    def __init__(self, index: SnapshotStore, asked: DataFrame, k: int = DEFAULT.prefetch, first: int = FIRST):
        self.k, self.first = k, first
        asked = asked.select("qid", "ix", F.col("w").alias("qw"))
        local = small(asked, MAX_TERMS)
        self.asked = asked if local is None else F.broadcast(local)
        wanted = (asked if local is None else local).select(index.bucket_of(F.col("ix")).alias("b")).distinct()
        self.index = index.read(sorted(r["b"] for r in wanted.collect()))  # as many numbers as buckets, at most
        heads = self.index.select("ix", "range", "max_w").join(self.asked, "ix")
        local = small(heads, MAX_BLOCKS)
        self.heads = heads if local is None else local  # few blocks: their weights are read once

    def bounds(self) -> DataFrame:
        """(qid, range, most): what a text of the range can score."""
        return self.heads.groupBy("qid", "range").agg(F.sum(F.col("qw") * F.col("max_w")).alias("most"))

    def _scores(self, wanted: DataFrame) -> DataFrame:
        """(qid, id, score) of all texts of the ranges in ``wanted`` (qid, range), each scored whole."""
        at = self.heads.join(wanted, ["qid", "range"], "left_semi").select("ix", "range", "qid", "qw")
        local = small(at, MAX_BLOCKS)
        met = self.index.select("ix", "range", "entries").join(at if local is None else F.broadcast(local), ["ix", "range"])
        rows = met.select("qid", "qw", F.explode("entries").alias("e"))
        return rows.groupBy("qid", F.col("e.id").alias("id")).agg(F.round(F.sum(F.col("qw") * F.col("e.w")) + 1e-12, 9).alias("score"))

    def first_ranges(self) -> DataFrame:
        order = Window.partitionBy("qid").orderBy(F.desc("most"), "range")
        return self.bounds().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= self.first).select("qid", "range")

    def hits(self) -> DataFrame:
        """(qid, id, score, rk): the k best texts of each query, ties by id."""
        spark = self.index.sparkSession
        ranges = self.first_ranges()
        ranges = spark.createDataFrame(ranges.toArrow(), ranges.schema)  # a few rows a query; sums of another run can differ in the last digit, and so order ranges otherwise
        best = top_k(self._scores(ranges), "qid", "id", self.k).select("qid", "id", "score", "rk")
        best = spark.createDataFrame(best.toArrow(), best.schema)  # k rows a query of a stated set
        least = best.filter(F.col("rk") == self.k).select("qid", F.col("score").alias("least"))
        open_ = self.bounds().join(ranges, ["qid", "range"], "left_anti").join(F.broadcast(least), "qid", "left")
        rest = self._scores(open_.filter(F.col("least").isNull() | (F.col("most") + 1e-9 >= F.col("least"))).select("qid", "range"))
        return top_k(best.drop("rk").unionByName(rest), "qid", "id", self.k).select("qid", "id", "score", "rk")


def search(index: SnapshotStore, asked: DataFrame, k: int = DEFAULT.prefetch, first: int = FIRST) -> DataFrame:
    """(qid, id, score, rk) of ``asked`` (qid, ix, w): the k best texts by the dot product of weights."""
    return Search(index, asked, k, first).hits()
