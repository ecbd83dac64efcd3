"""A corpus pipeline of five of the operators: from raw documents to sharded training text.

Every stage takes the documents that its predecessor kept and, but for the last one,
returns the columns of documents; each stage's result is written as Parquet and read
again as the next one's input.  Columns besides those of documents pass through the first four stages as they are,
whatever their names; the last one adds shard.  Null, empty and very long texts, ties and repeated rows go as each operator's
docstring says; without documents there are no rows, without benchmark items or labels nothing is cut or learned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import decontaminate, jaccard, langid, mixing, sharding
from ravelin.llm.common import broadcast_if_small, id_text, release, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in none of the learned languages: without a letter, or farther from every profile than any text
    in its language is (``langid.LEAST_SCORE``).  A missing label becomes the predicted one.

    Where no row is labelled nothing can be learned: all documents with a letter stay as they are.
    """
    profiles = langid.profiles_of(docs)
    if profiles.isEmpty():
        return docs.filter(F.regexp_like("text", F.lit(r"\p{L}")))
    found = langid.identify(docs.select("text", F.struct(*docs.columns).alias("__row")), profiles)
    label = F.coalesce("__row.lang", "lang_pred")
    rest = [F.col(f"__row.{c}") if c != "lang" else label.alias("lang") for c in docs.columns]
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.LEAST_SCORE)).select(*rest)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates keep the document with the smallest id.

    Where ids are missing or repeat, rows are told apart by numbers of their own; of equal ids
    any one stays, the same in every run of the stage's table.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if ids.isEmpty():
        groups = written(jaccard.near_duplicates(docs.select("doc_id", "text")), "pipeline-groups")
        gone = written(groups.filter("doc_id <> component_id").select("doc_id"), "pipeline-gone")
        return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = written(jaccard.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")), "pipeline-groups")
    named = rows.select("__row", "doc_id").join(groups.select(F.col("doc_id").alias("__row"), "component_id"), "__row")
    smallest = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row"))
    first = named.groupBy("component_id").agg(smallest.alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; drop documents that are mostly such passages."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it, which may be never."""
    mixed = mixing.mix(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__whole")))
    again = F.explode(F.sequence(F.lit(1), F.col("copies")))
    taken = mixed.filter("copies > 0").select("__whole", again.alias("__copy"))
    return taken.select(*[F.col("__whole").getField(c).alias(c) for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, id_text("doc_id"), sharding.shard_names(sharding.N_SHARDS))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_to_targets),
    ("sharding", shard),
]

#: Language profiles and prefix joins are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
