"""Sharding by a permutation-filled lookup table.  [native]

Every shard has a preference order of the slots of a prime-sized table, a
permutation given by an offset and a step.  The shards take turns, each claiming
its most preferred free slot, until no slot is free, so shares differ by one slot
at most and a change of the shard list moves few slots.  The table depends on the
shard names alone and is bounded by ``MAX_TABLE``, so it is always broadcast:
placing a row is one hash and one look-up, with no shuffle of the rows.

Null keys hash as the empty text; equal keys always share a shard; an empty table
stays empty.  A column that has the name of an added one is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import hash60, id_text, table, without

MAX_TABLE = 1_000_003
N_SHARDS = 64
#: A prime of at least a hundred slots a shard keeps shares within 1 %.
TABLE_SIZE = 6553


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _name_hash(name: str, what: str) -> int:
    return int(hashlib.md5(f"{what}:{name}".encode()).hexdigest()[:15], 16)


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, and one at least")
    if not _is_prime(size) or not len(shards) <= size <= MAX_TABLE:
        raise ValueError(f"size must be a prime from the number of shards to {MAX_TABLE}")
    at = [_name_hash(s, "offset") % size for s in shards]
    step = [_name_hash(s, "skip") % (size - 1) + 1 for s in shards]
    slots = [-1] * size
    free = size
    while True:
        for i in range(len(shards)):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % size
            slots[at[i]] = i
            free -= 1
            if not free:
                return slots


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """The look-up table as a DataFrame (slot, shard)."""
    claimed = F.split(F.lit(",".join(map(str, lookup_table(shards, size)))), ",").cast("array<int>")
    return spark.range(1).select(F.posexplode(claimed).alias("__slot", "__shard"))


def assign_shards(
    df: DataFrame,
    key: Column,
    shards: Sequence[str],
    size: int = TABLE_SIZE,
    seed: str = "shard",
    slot_col: str = "slot",
    shard_col: str = "shard",
) -> DataFrame:
    """``df`` with the slot that each row's key hashes to and the shard that owns it."""
    places = table_frame(df.sparkSession, shards, size)
    slot = F.pmod(hash60(F.coalesce(key.cast("string"), F.lit("")), seed), F.lit(size)).cast("int")
    return (
        df.withColumn("__slot", slot)
        .join(F.broadcast(places), "__slot")
        .select(
            *without(df, (slot_col, shard_col)).columns,
            F.col("__slot").alias(slot_col),
            F.col("__shard").alias(shard_col),
        )
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return assign_shards(docs, id_text("doc_id"), shard_names(N_SHARDS))


#: The turns are replayed one claim at a time: state is the claimed slots and each
#: shard's next place in its preference order.
SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, ('0x' || md5('offset:' || name)[1:15])::BIGINT % {TABLE_SIZE} AS off,
         ('0x' || md5('skip:' || name)[1:15])::BIGINT % {TABLE_SIZE - 1} + 1 AS skip
  FROM (SELECT range AS i, format('shard-{{:05d}}', range) AS name FROM range({N_SHARDS}))
), prefs AS (
  SELECT list(off ORDER BY i) AS offs, list(skip ORDER BY i) AS skips FROM shards
), turns(n, slot, j, free, offs, skips) AS (
  SELECT 0, NULL::BIGINT, list_transform(range({N_SHARDS}), lambda x: 0::BIGINT),
         list_transform(range({TABLE_SIZE}), lambda x: true), offs, skips FROM prefs
  UNION ALL
  SELECT n + 1, s, list_concat(list_append(j[1:n % {N_SHARDS}], k + 1), j[n % {N_SHARDS} + 2:]),
         list_concat(list_append(free[1:s], false), free[s + 2:]), offs, skips
  FROM (
    SELECT *, (offs[n % {N_SHARDS} + 1] + k * skips[n % {N_SHARDS} + 1]) % {TABLE_SIZE} AS s
    FROM (
      SELECT *, list_filter(range(j[n % {N_SHARDS} + 1], {TABLE_SIZE}),
        lambda x: free[(offs[n % {N_SHARDS} + 1] + x * skips[n % {N_SHARDS} + 1]) % {TABLE_SIZE} + 1])[1] AS k
      FROM turns WHERE n < {TABLE_SIZE}
    )
  )
), places AS (
  SELECT slot, (n - 1) % {N_SHARDS} AS shard FROM turns WHERE n > 0
)
SELECT doc_id, source, n_chars, slot::INTEGER AS slot, shard::INTEGER AS shard
FROM (
  SELECT *, ('0x' || md5('shard:' || coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT % {TABLE_SIZE} AS home
  FROM documents
) JOIN places ON slot = home
"""
