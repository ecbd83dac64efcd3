"""Fusion of ranked lists, score filters and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.config import DEFAULT
from ravelin.functions.text import excerpt, title_of
from ravelin.operators.sparse import MAX_TERMS, small, top_k


def fused(dense: DataFrame, sparse: DataFrame, k: int = DEFAULT.rrf_k) -> DataFrame:
    """(qid, doc_id, dense_rk, sparse_rk, rrf) of all hits in either ranked list (qid, doc_id, rk).

    A union and one grouping, rather than an outer join, so hits are shuffled once.
    """
    none = F.lit(None).cast("int")
    both = dense.select("qid", "doc_id", F.col("rk").alias("d"), none.alias("s")).unionByName(
        sparse.select("qid", "doc_id", none.alias("d"), F.col("rk").alias("s"))
    )
    share = lambda r: F.coalesce(F.lit(1.0) / (k + F.col(r)), F.lit(0.0))
    return (
        both.groupBy("qid", "doc_id")
        .agg(F.max("d").alias("dense_rk"), F.max("s").alias("sparse_rk"))
        .withColumn("rrf", F.round(share("sparse_rk") + share("dense_rk"), 9))
    )


def best_fused(fusion: DataFrame, k: int = DEFAULT.top_k) -> DataFrame:
    scores = fusion.select("qid", "doc_id", F.col("rrf").alias("score"))
    return top_k(scores, "qid", "doc_id", k).select("qid", "doc_id", "score", "rk")


def scoring_at_least(hits: DataFrame, least: float = DEFAULT.min_score) -> DataFrame:
    return hits.filter((F.col("score") >= least) & ~F.isnan("score"))


def with_texts(hits: DataFrame, docs: DataFrame, most: int = MAX_TERMS) -> DataFrame:
    """Hits with the columns of their ``docs`` (doc_id, ...): up to ``most`` hits go to the texts, so these are not shuffled."""
    local = small(hits, most)
    return docs.join(hits if local is None else F.broadcast(local), "doc_id")


def citations(hits: DataFrame, docs: DataFrame, size: int = DEFAULT.excerpt) -> DataFrame:
    """(qid, rk, title, source, score, excerpt) of hits in ``docs`` (doc_id, source, content): titles and excerpts are made of hits' texts only."""
    title = title_of(F.col("content"), F.col("source")).alias("title")
    return with_texts(hits, docs).select("qid", "rk", title, "source", "score", excerpt(F.col("content"), size).alias("excerpt"))
