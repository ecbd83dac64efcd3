"""Names of all registered queries, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ravelin.plans import oracles
from ravelin.plans import queries as q

QUERIES = (
    q.tokenize_terms,
    q.sparse_tf,
    q.term_numbers,
    q.sparse_vectors,
    q.sparse_topk,
    q.stored_topk,
    q.bm25_topk,
    q.vector_norms,
    q.dense_topk,
    q.ann_topk,
    q.stored_hybrid_topk,
    q.cosine_above,
    q.legacy_cosine_filter,
    q.rrf_fusion,
    q.hybrid_topk,
    q.min_score_filter,
    q.citations,
    q.title_extract,
    q.sections,
    q.section_chunks,
    q.all_section_chunks,
    q.chunk_ids,
    q.sub_split,
    q.file_hashes,
    q.diff_deleted,
    q.diff_todo,
    q.diff_skipped,
    q.upsert,
    q.upsert_replacing,
    q.ingested,
    q.delete_by_source,
    q.dedupe_last_wins,
    q.json_store_merge,
    q.chunk_count,
    q.all_chunk_count,
    q.ingest_metrics,
    q.changed_chunk_metrics,
    q.history_window,
    q.context_join,
    q.prompt_messages,
    q.request_questions,
    q.sse_frames,
    q.sse_fold,
    q.not_found_fallback,
    q.embed_batches,
    q.all_embed_batches,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
