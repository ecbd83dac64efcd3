"""Exact deduplication by counting quotient filters.

Every task builds a counting quotient filter of its texts' 64-bit fingerprints, one
for each range of quotients.  A filter keeps its remainders sorted within their
quotient, so filters of a range merge without loss by merging sorted remainders and
adding counts.  Fingerprints whose count exceeds one route their texts, and no
others, to byte verification: a grouping on the whole text, combined in each task
before its shuffle.  Up to a million such fingerprints are broadcast, so that other texts stay
where they are; more of them are joined by a shuffle.

Of equal texts the row with the largest doc_id stays.  Null counts as the empty text.
A null doc_id is smaller than any; rows that repeat a doc_id and text share one
decision.  Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import broadcast_if_small, table, written

#: Fingerprints that one merged filter holds on average.
PER_RANGE = 250_000
#: Fingerprints that a task keeps before it adds them to its filters.
HELD = 2_000_000


class CountingQuotientFilter:
    """Fingerprints of 64 bits with exact counts.

    A fingerprint's top ``bits`` bits are its quotient, the rest its remainder.
    ``occupied`` has a bit a quotient; ``ends`` marks the last slot of each run of
    remainders; remainders are sorted within a run; ``counts`` stand beside them.
    """

    def __init__(self, bits: int, occupied: np.ndarray, ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.bits, self.occupied, self.ends, self.remainders, self.counts = bits, occupied, ends, remainders, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray, bits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        fp = fingerprints[order]
        n = np.ones(len(fp), np.int64) if counts is None else counts[order]
        first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1])) if len(fp) else np.empty(0, np.int64)
        fp, n = fp[first], np.add.reduceat(n, first) if len(first) else n
        quotients = (fp >> np.uint64(64 - bits)).astype(np.int64)
        occupied = np.zeros(1 << bits, bool)
        occupied[quotients] = True
        ends = np.append(quotients[1:] != quotients[:-1], True)[: len(fp)]
        return cls(bits, occupied, ends, fp & np.uint64((1 << (64 - bits)) - 1), n)

    def fingerprints(self) -> np.ndarray:
        runs = np.cumsum(np.append(0, self.ends[:-1])) if len(self.ends) else np.empty(0, np.int64)
        return (np.flatnonzero(self.occupied)[runs].astype(np.uint64) << np.uint64(64 - self.bits)) | self.remainders

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        return cls.of(
            np.concatenate([f.fingerprints() for f in filters]),
            filters[0].bits,
            np.concatenate([f.counts for f in filters]),
        )

    def to_bytes(self) -> bytes:
        head = np.array([self.bits, len(self.remainders)], np.int64).tobytes()
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.ends).tobytes() + self.remainders.tobytes() + self.counts.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, n = map(int, np.frombuffer(data, np.int64, 2))
        a = 16
        b = a + ((1 << bits) + 7) // 8
        c = b + (n + 7) // 8
        flags = lambda lo, hi, size: np.unpackbits(np.frombuffer(data, np.uint8, hi - lo, lo), count=size).astype(bool)
        return cls(
            bits, flags(a, b, 1 << bits), flags(b, c, n), np.frombuffer(data, np.uint64, n, c), np.frombuffer(data, np.int64, n, c + 8 * n)
        )


def repeated_fingerprints(fingerprints: DataFrame, n_rows: int) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once; ``fingerprints`` has fp.

    The filter's range is the fingerprint's top bits; within a range the quotient is
    the next bits, so that the ranges' filters together are one large filter.
    """
    range_bits = max(4, (n_rows // PER_RANGE).bit_length() + 1)
    quotient_bits = 12

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        filters: dict[int, CountingQuotientFilter] = {}

        def pack() -> None:
            fp = np.sort(np.concatenate(held))
            ids = (fp >> np.uint64(64 - range_bits)).astype(np.int64)
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            for lo, hi in zip(starts, np.append(starts[1:], len(fp)), strict=True):
                new = CountingQuotientFilter.of(fp[lo:hi] << np.uint64(range_bits), quotient_bits)
                old = filters.get(int(ids[lo]))
                filters[int(ids[lo])] = CountingQuotientFilter.merged([old, new]) if old else new
            held.clear()

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) > HELD:
                pack()
        if any(len(h) for h in held):
            pack()
        for k, f in filters.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([f.to_bytes()], pa.binary())], ["range", "cqf"])

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        whole = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(b) for b in group["cqf"]])
        many = whole.counts > 1
        low = whole.fingerprints()[many] >> np.uint64(range_bits)
        fp = (np.uint64(int(key[0])) << np.uint64(64 - range_bits)) | low
        return pd.DataFrame({"fp": fp.view(np.int64), "n": whole.counts[many]})

    built = fingerprints.select("fp").mapInArrow(build, "range long, cqf binary")
    return built.groupBy("range").applyInPandas(merge, "fp long, n long")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"fp": F.xxhash64("text"), "sha": F.sha2("text", 256)})
    slim = written(rows.select("doc_id", "fp", "sha"), "dedup-fingerprints")
    repeated = written(repeated_fingerprints(slim, slim.count()).select("fp"), "dedup-repeated")
    suspects = rows.select("doc_id", "fp", "text").join(broadcast_if_small(repeated), "fp", "left_semi")
    groups = (
        suspects.groupBy("text")
        .agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
        .filter("group_size > 1")
        .select(F.sha2("text", 256).alias("sha"), "group_size", "keep_id")
    )
    joined = slim.select("doc_id", "sha").join(groups, "sha", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
         sha256(coalesce(text, '')) AS text_sha256
  FROM documents
  WINDOW w AS (PARTITION BY coalesce(text, ''))
)
"""
