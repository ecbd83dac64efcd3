"""Mixing sources to target weights.  [native]

Every source has a budget of words.  Within a source, documents stand in the order
of a hash-random key.  The key's range is cut into buckets; bucket sums and a window
over them give distributed prefix sums of token counts, and only the bucket that
holds the budget's end is sorted row by row.  That gives one cut key a source:
rows below it are taken once more than rows from it on.  Budgets above the
source's size repeat whole epochs.  No task ever holds more than a bucket of a
source, so a source with a third of all rows is dealt out like any other.

A row is taken whole or not at all in an epoch: the cut falls on the row boundary
nearest the budget, so a source's taken words miss the target by half a row's size
at most (by half a group, where rows agree in id and text: they share a key).
Null text has size 0.  A null source is a source of its own, and the last one.
Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.common import WORD, hash60, id_text, table, written

#: Buckets that a source's key range is cut into.
BUCKET_BITS = 13
#: With at most this many sources, the table of cuts is broadcast (some 100 bytes a row).
MAX_BROADCAST_SOURCES = 10_000
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """(source, source_size) with weight and target: a source's share by weight of
    ``share`` times all words, at most ``epochs`` times its size, the excess reshared.

    With sources in order of cap / weight, the capped ones are the first; each is
    tested against what is left for it and all after it.  ``sizes`` has a row a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn(
        "weight",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            (F.row_number().over(by_name) - 1).cast("int") % len(weights) + 1,
        ),
    )
    everything = Window.partitionBy()
    filling = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.lit(float(epochs)) * F.col("source_size")
    return (
        ranked.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("pool", F.lit(share) * F.sum("source_size").over(everything).cast("double"))
        .withColumn("rest", F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn(
            "open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
        )
        .withColumn("capped", F.col("cap") * F.col("open") <= F.col("rest") * F.col("weight"))
        .withColumn(
            "left", F.col("pool") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
        )
        .withColumn("among", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
        .select(
            "source",
            "source_size",
            "weight",
            F.when(F.col("capped"), F.col("cap"))
            .otherwise(F.col("left") * F.col("weight") / F.col("among"))
            .alias("target"),
        )
    )


def source_cuts(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: float = EPOCHS,
) -> DataFrame:
    """One row a source: target, whole epochs and the key below which rows count once more.

    ``docs`` has source, size, key (0 <= key < 2**60).
    """
    bucket = F.shiftright("key", 60 - BUCKET_BITS)
    sums = written(
        docs.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "mix-sums"
    )
    sizes = sums.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = written(source_targets(sizes, weights, share, epochs), "mix-targets")
    goal = (
        targets.withColumn(
            "epochs_full",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)),
        )
        .withColumn("rest", F.col("target") - F.col("epochs_full") * F.col("source_size"))
    )
    in_order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sums.withColumn("below", F.coalesce(F.sum("words").over(in_order), F.lit(0)))
        .join(goal.select(F.col("source").alias("__s"), "rest"), F.col("source").eqNullSafe(F.col("__s")))
        .filter((F.col("rest") > F.col("below")) & (F.col("rest") <= F.col("below") + F.col("words")))
        .select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), "below", "rest")
    )
    inside = docs.select("source", "size", "key", bucket.alias("bucket")).join(
        ends, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b"))
    )
    by_key = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        inside.groupBy("source", "bucket", "key", "below", "rest")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.col("below") + F.coalesce(F.sum("words").over(by_key), F.lit(0)))
        .filter(F.col("before") + F.col("words") / 2 <= F.col("rest"))
        .groupBy("source")
        .agg((F.max("key") + 1).alias("last_key"))
    )
    start = ends.select(
        F.col("__s").alias("source"), F.shiftleft(F.col("__b").cast("long"), 60 - BUCKET_BITS).alias("first_key")
    )
    near = start.alias("a").join(cuts.alias("b"), F.expr("a.source <=> b.source"), "left").select(
        F.col("a.source").alias("__s"), F.coalesce("last_key", "first_key").alias("cut_key")
    )
    return goal.join(near, F.col("source").eqNullSafe(F.col("__s")), "left").select(
        "source", "source_size", "weight", "target", "epochs_full", F.coalesce("cut_key", F.lit(0)).alias("cut_key")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    epochs: float = EPOCHS,
    seed: str = "mix",
) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, copies, taken, which replace columns of
    these names; all others pass through.  Very long texts are counted where they are."""
    added = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in added]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = hash60(F.concat(id_text("doc_id"), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))), seed)
    rows = docs.select(*kept, size.alias("size"), key.alias("__key"))
    slim = written(rows.select("source", "size", F.col("__key").alias("key")), "mix-keys")
    cuts = written(source_cuts(slim, weights, share, epochs), "mix-cuts")
    cuts = cuts.select(*[F.col(c).alias(f"__{c}") for c in cuts.columns])
    if cuts.count() <= MAX_BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    copies = F.col("__epochs_full") + (F.col("__key") < F.col("__cut_key")).cast("long")
    return rows.join(cuts, F.col("source").eqNullSafe(F.col("__source"))).select(
        *kept,
        "size",
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')))[1:15])::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
           WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS pool FROM s
), g AS (
  SELECT *, pool - coalesce(sum(cap) OVER w, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open
  FROM f WINDOW w AS (ORDER BY cap / weight, source IS NULL, encode(source)
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT *, cap * open <= rest * weight AS capped FROM g
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap ELSE
           (pool - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) * weight
           / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target
  FROM h
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_epochs FROM t
), k AS (
  SELECT source, key, sum(size) AS words FROM d GROUP BY source, key
), p AS (
  SELECT source, key, words, sum(words) OVER (PARTITION BY source ORDER BY key) - words AS before FROM k
), c AS (
  SELECT u.source, max(key) AS cut FROM p JOIN u ON u.source IS NOT DISTINCT FROM p.source
  WHERE before + words / 2 <= target - full_epochs * source_size AND before < target - full_epochs * source_size
  GROUP BY u.source
)
SELECT doc_id, size, source_size, target,
       size * (full_epochs + CASE WHEN key <= coalesce(cut, -1) THEN 1 ELSE 0 END) AS taken
FROM d JOIN u ON u.source IS NOT DISTINCT FROM d.source
LEFT JOIN c ON c.source IS NOT DISTINCT FROM d.source
"""
