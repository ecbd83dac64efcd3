"""Registered queries over the given tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin import schemas
from ravelin.config import DEFAULT
from ravelin.functions.text import chunk_id, title_of, tokens
from ravelin.functions.vectors import norm
from ravelin.operators import bm25, chunking, dense, fusion, ingest, ivf, jsonstore, keyword, postings, prompt, sparse, store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- inputs derived from the tables --------------------------------------------------


def files(spark: SparkSession, d: str) -> DataFrame:
    """documents as files (source, content), with their numbers."""
    return table(spark, d, "documents").select(
        F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("source"), F.col("text").alias("content"), "doc_id"
    )


def previous(spark: SparkSession, d: str) -> DataFrame:
    """An earlier listing (source, hash): every tenth file is new since, every seventh changed, five are gone."""
    docs = table(spark, d, "documents")
    source = F.concat("source", F.lit("/"), "doc_id", F.lit(".md"))
    altered = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.filter(F.col("doc_id") % 10 != 0).select(source.alias("source"), F.md5(altered).alias("hash"))
    gone = spark.range(5).select(F.concat(F.lit("gone/"), "id", F.lit(".md")).alias("source"), F.md5(F.col("id").cast("string")).alias("hash"))
    return old.unionByName(gone)


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """conversations as Markdown files (source, title, content): a heading a conversation and turn."""
    c = table(spark, d, "conversations")
    mark = F.when(F.col("turn") % 3 == 2, F.lit("### ")).otherwise(F.lit("## "))
    part = F.concat(mark, "role", F.lit(" "), "turn", F.lit("\n\n"), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", part.alias("p"))))
    body = F.array_join(F.transform(ordered, lambda x: x["p"]), "\n\n")
    source = F.concat(F.lit("chat/"), "conv_id", F.lit(".md"))
    content = F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n\n"), "body")
    rows = c.groupBy("conv_id").agg(body.alias("body")).select(source.alias("source"), content.alias("content"))
    return rows.select("source", title_of(F.col("content"), F.col("source")).alias("title"), "content")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


# -- sparse --------------------------------------------------------------------------


def tokenize_terms(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


def sparse_tf(spark: SparkSession, d: str) -> DataFrame:
    return sparse.terms(table(spark, d, "documents"), "doc_id").select("doc_id", "term", "n", F.round("tf", 9).alias("tf"))


def term_numbers(spark: SparkSession, d: str) -> DataFrame:
    from ravelin.functions.text import term_index

    terms = table(spark, d, "documents").select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", term_index(F.col("term")).cast("long").alias("ix"))


def sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    p = sparse.vectors(table(spark, d, "documents"), "doc_id")
    return p.select("doc_id", F.col("ix").cast("long").alias("ix"), (F.floor(F.col("w") * 1e9 + 0.5) / 1e9).alias("w"))  # as SQL rounds doubles


def sparse_topk(spark: SparkSession, d: str, k: int = DEFAULT.prefetch) -> DataFrame:
    return keyword.text_search(table(spark, d, "documents").select("doc_id", "text"), asked_terms(spark, d), "qid", "doc_id", k)


def stored_topk(spark: SparkSession, d: str, k: int = DEFAULT.prefetch) -> DataFrame:
    """``sparse_topk`` over an index of postings in blocks, of which those of other terms and of hopeless texts are not read."""
    found = postings.search(built_index(spark, d, f"{_shared(spark)}/index-{uuid.uuid4().hex}"), asked_terms(spark, d), k)
    return found.withColumnRenamed("id", "doc_id")


def asked_terms(spark: SparkSession, d: str) -> DataFrame:
    return sparse.postings(questions(spark, d), "qid", "question")


def built_index(spark: SparkSession, d: str, root: str) -> store.SnapshotStore:
    """The documents' postings in blocks."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    index = postings.index_store(spark, root, "bigint")
    postings.build(index, sparse.encoded(docs, "id"))
    return index


def bm25_topk(spark: SparkSession, d: str, k: int = DEFAULT.prefetch) -> DataFrame:
    """Chunks by BM25 after the two ingests of ``ingested``; document frequencies follow the second one by what it changes."""
    chunks, sums = _two_ingests(spark, d, counted=True)
    texts = chunks.read().select("id", "sparse", "terms")
    return bm25.search(texts, sums.read(), asked_terms(spark, d), k)


def _shared(spark: SparkSession) -> str:
    """The folder that all executors share; only on one machine, where the session names none, one of the driver's own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return path.rstrip("/")


def _two_ingests(spark: SparkSession, d: str, counted: bool = False) -> tuple[store.SnapshotStore, bm25.TermSums | None]:
    """A store after two ingests: the first has an older listing, which lacks every tenth file and
    has others' older texts, the second the files as they are.  If ``counted``, sums of terms follow both."""
    root = f"{_shared(spark)}/ingest-{uuid.uuid4().hex}"
    chunks = store.SnapshotStore(spark, f"{root}/chunks", schemas.STORED_CHUNK, "metadata.source", DEFAULT.buckets)
    state = store.SnapshotStore(spark, f"{root}/state", schemas.FILE_STATE)
    docs = table(spark, d, "documents").filter(F.col("doc_id") % 10 != 0)
    older = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("# old"), "text")).otherwise(F.col("text"))
    sums = bm25.TermSums(spark, f"{root}/sums") if counted else None
    ingest.ingest(docs.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("source"), older.alias("content")), chunks, state, sums=sums)
    ingest.ingest(files(spark, d), chunks, state, sums=sums)
    return chunks, sums


def ingested(spark: SparkSession, d: str) -> DataFrame:
    """Sources in a store after two ingests, and how many of their chunks are stale."""
    chunks, _ = _two_ingests(spark, d)
    stale = F.col("metadata.title").startswith("old").cast("long")
    return chunks.read().groupBy(F.col("metadata.source").alias("source")).agg(F.sum(stale).alias("stale"))


# -- dense ---------------------------------------------------------------------------


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 9).alias("norm"))


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of documents, and of questions: the vector whose id is the item's."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = v.join(questions(spark, d), F.col("id") == F.col("qid"), "inner").select("qid", "embedding")
    return v, q


def dense_topk(spark: SparkSession, d: str, k: int = DEFAULT.prefetch, least: float | None = None) -> DataFrame:
    found = dense.vector_search(*_vectors(spark, d), k=k, least=least)
    return found.withColumnRenamed("id", "doc_id")


def built_lists(spark: SparkSession, d: str, root: str) -> ivf.InvertedLists:
    """The vectors in as many inverted lists as the square root of their number."""
    vectors = _vectors(spark, d)[0]
    lists = ivf.InvertedLists(spark, root, max(1, round(vectors.count() ** 0.5)), "bigint")
    lists.build(vectors)
    return lists


def ann_topk(spark: SparkSession, d: str, k: int = DEFAULT.prefetch) -> DataFrame:
    """``dense_topk`` by inverted lists: scores are exact, some neighbours may be missed."""
    lists = built_lists(spark, d, f"{_shared(spark)}/lists-{uuid.uuid4().hex}")
    return lists.search(_vectors(spark, d)[1], k).withColumnRenamed("id", "doc_id")


def stored_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search of one store that holds both vectors of each document, under its content's id."""
    root = f"{_shared(spark)}/hybrid-{uuid.uuid4().hex}"
    docs = files(spark, d).select("doc_id", "source", F.coalesce("content", F.lit("")).alias("content"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = docs.join(v, "doc_id", "left").select(
        chunk_id(F.col("source"), F.col("content")).alias("id"), "content", "embedding", sparse.encoded_text(F.col("content")).alias("e"), "source"
    )
    chunks = store.SnapshotStore(spark, f"{root}/chunks", schemas.STORED_CHUNK, "metadata.source", DEFAULT.buckets)
    none = F.lit(None).cast("string")
    chunks.write(
        rows.select(
            "id", "content", "embedding", "e.sparse", "e.terms",
            F.struct("source", none.alias("title"), none.alias("section_title"), F.lit(0).alias("chunk_index")).alias("metadata"),
        )
    )
    held, asked = chunks.read(), _vectors(spark, d)[1]
    by_vector = dense.vector_search(held.select("id", "embedding"), asked, skip_self=False)
    by_words = keyword.stored_search(held.select("id", "sparse"), asked_terms(spark, d))
    named = lambda hits: hits.withColumnRenamed("id", "doc_id")
    return fusion.best_fused(fusion.fused(named(by_vector), named(by_words)))


def cosine_above(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours whose cosine exceeds a bound that many have, the question's own vector among them."""
    found = dense.vector_search(*_vectors(spark, d), k=DEFAULT.top_k, least=0.25, skip_self=False)
    return found.select("qid", F.col("id").alias("doc_id"), "score")


def legacy_cosine_filter(spark: SparkSession, d: str) -> DataFrame:
    return dense_topk(spark, d, DEFAULT.top_k, DEFAULT.min_cosine).select("qid", "doc_id", "score")


# -- fusion --------------------------------------------------------------------------


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fused(dense_topk(spark, d), sparse_topk(spark, d))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return fusion.best_fused(rrf_fusion(spark, d))


def min_score_filter(spark: SparkSession, d: str) -> DataFrame:
    return fusion.scoring_at_least(hybrid_topk(spark, d), 0.016).select("qid", "doc_id", "score")


def _library(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    source = F.concat("source", F.lit("/"), "doc_id", F.lit(".md"))
    return docs.select("doc_id", source.alias("source"), F.col("text").alias("content"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    return fusion.citations(hybrid_topk(spark, d), _library(spark, d))


# -- chunking ------------------------------------------------------------------------


def title_extract(spark: SparkSession, d: str) -> DataFrame:
    return markdown(spark, d).select("source", "title")


def sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sections(markdown(spark, d)).select("source", "section_ord", "heading_path", "content")


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("source", "section_title", "chunk_index", "content")


def all_section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """``section_chunks`` with the sections' numbers."""
    return _chunks(spark, d).select("source", "section_title", "section_ord", "chunk_index", "content")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(chunking.sections(markdown(spark, d)))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return f.select("source", chunk_id(F.col("source"), F.coalesce("content", F.lit(""))).alias("id"))


def sub_split(spark: SparkSession, d: str) -> DataFrame:
    docs = files(spark, d).select("source", title_of(F.col("content"), F.col("source")).alias("title"), "content")
    made = chunking.chunks(chunking.sections(docs))
    return made.select("source", "section_title", "section_ord", "chunk_index", F.length("content").cast("long").alias("n_chars"), "content")


# -- store and ingest ----------------------------------------------------------------


def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    return ingest.hashed(files(spark, d))


def diff_deleted(spark: SparkSession, d: str) -> DataFrame:
    return ingest.deleted(ingest.hashed(files(spark, d)), previous(spark, d))


def diff_todo(spark: SparkSession, d: str) -> DataFrame:
    return ingest.todo(ingest.hashed(files(spark, d)), previous(spark, d))


def diff_skipped(spark: SparkSession, d: str) -> DataFrame:
    return ingest.skipped(ingest.hashed(files(spark, d)), previous(spark, d))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Each file's text with its content's id and a mark."""
    f = files(spark, d)
    return f.select(chunk_id(F.col("source"), F.coalesce("content", F.lit(""))).alias("id"), "source", F.md5("content").alias("content"))


def upsert(spark: SparkSession, d: str) -> DataFrame:
    old = _rows(spark, d).join(ingest.todo(ingest.hashed(files(spark, d)), previous(spark, d)), "source", "left_anti")
    new = _rows(spark, d).withColumn("content", F.concat(F.lit("new:"), "content"))
    changed = ingest.todo(ingest.hashed(files(spark, d)), previous(spark, d))
    return store.upsert(old, new.join(changed, "source", "left_semi").select("id", "source", "content")).select("id", "source", "content")


def upsert_replacing(spark: SparkSession, d: str) -> DataFrame:
    """The rows of changed files put in place of their old ones, which have the same ids."""
    old = _rows(spark, d)
    changed = ingest.todo(ingest.hashed(files(spark, d)), previous(spark, d))
    new = old.withColumn("content", F.concat(F.lit("new:"), "content")).join(changed, "source", "left_semi")
    return store.upsert(old, new.select("id", "source", "content")).select("id", "source", "content")


def delete_by_source(spark: SparkSession, d: str) -> DataFrame:
    changed = ingest.todo(ingest.hashed(files(spark, d)), previous(spark, d))
    return store.delete_sources(_rows(spark, d), changed)


def dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of the messages with one text, the last said."""
    said = table(spark, d, "conversations").select(F.md5(F.coalesce("text", F.lit(""))).alias("id"), "conv_id", "turn", "role")
    return store.last_wins(said, "id", ["conv_id", "turn"])


def json_store_merge(spark: SparkSession, d: str) -> DataFrame:
    """Messages by text in a JSON store, merged in two halves: a text keeps the place where it was first said, with who said it last."""
    said = table(spark, d, "conversations").select(
        F.md5(F.coalesce("text", F.lit(""))).alias("id"), "conv_id", "turn", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("position")
    )
    rows = jsonstore.JsonStore(spark, f"{_shared(spark)}/json-{uuid.uuid4().hex}", "id string, conv_id long, turn long, role string")
    rows.upsert(said.filter("conv_id % 2 = 0"))
    rows.upsert(said.filter("conv_id % 2 = 1"))
    return rows.positioned().select("id", "position", "conv_id", "turn", "role")


def chunk_count(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).agg(F.count("*").alias("chunks"))


def all_chunk_count(spark: SparkSession, d: str) -> DataFrame:
    """``chunk_count`` under its older name."""
    return chunk_count(spark, d)


def ingest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """What an ingest of the files over the earlier listing does, with the chunks that it makes: of the changed files only, repeated ones too."""
    current, old = ingest.hashed(files(spark, d)), previous(spark, d)
    changed = files(spark, d).join(ingest.todo(current, old), "source", "left_semi")
    docs = changed.select("source", title_of(F.col("content"), F.col("source")).alias("title"), "content")
    return ingest.metrics(current, old, chunking.chunks(chunking.sections(docs)))


def changed_chunk_metrics(spark: SparkSession, d: str) -> DataFrame:
    """``ingest_metrics`` under its older name."""
    return ingest_metrics(spark, d)


# -- prompts -------------------------------------------------------------------------


def history_window(spark: SparkSession, d: str) -> DataFrame:
    return prompt.recent(table(spark, d, "conversations")).select("conv_id", "turn", "role", "text")


def context_join(spark: SparkSession, d: str) -> DataFrame:
    return prompt.context(fusion.with_texts(hybrid_topk(spark, d), _library(spark, d).select("doc_id", "content")))


def prompt_messages(spark: SparkSession, d: str) -> DataFrame:
    """For each question: its context, and as history the conversation of the same number."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))))
    said = table(spark, d, "conversations").withColumnRenamed("conv_id", "qid").join(questions(spark, d).select("qid"), "qid", "left_semi")
    told = said.groupBy("qid").agg(F.transform(turns, lambda x: x["m"]).alias("history"))
    q = questions(spark, d).join(told, "qid", "left").join(context_join(spark, d), "qid", "left")
    return prompt.messages(q)


def request_questions(spark: SparkSession, d: str) -> DataFrame:
    """Requests as JSON, one a conversation with its first message as the question and the rest as history, read back; blank questions are left out."""
    m = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    said = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(m)), lambda x: x["m"]).alias("h"))
    body = F.to_json(F.struct(F.get("h", F.lit(0))["content"].alias("question"), F.slice("h", 2, F.size("h")).alias("history")))
    read = prompt.valid_questions(said.select("qid", body.alias("body")))
    return read.select("qid", "question", F.size("history").cast("long").alias("n_history"), F.get(F.col("history"), F.size("history") - 1)["content"].alias("last"))


def sse_frames(spark: SparkSession, d: str) -> DataFrame:
    """Event frames of an answer that repeats the question word by word."""
    words = questions(spark, d).select("qid", F.posexplode(F.split("question", " ")).alias("pos", "token"))
    return prompt.frames(citations(spark, d), words)


def sse_fold(spark: SparkSession, d: str) -> DataFrame:
    words = questions(spark, d).select(
        "qid", F.posexplode(F.transform(F.split("question", " "), lambda w, i: F.when(i == 0, w).otherwise(F.concat(F.lit(" "), w)))).alias("pos", "token")
    )
    return prompt.folded(prompt.frames(citations(spark, d), words))


def not_found_fallback(spark: SparkSession, d: str) -> DataFrame:
    return prompt.answers(questions(spark, d), fusion.scoring_at_least(hybrid_topk(spark, d), 0.03))


def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each file in batches of ten, and their sizes."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("section_ord", "chunk_index"))
    batch = F.floor((n - 1) / DEFAULT.batch)
    return _chunks(spark, d).select("source", batch.alias("batch_no")).groupBy("source", "batch_no").agg(F.count("*").alias("n"))


def all_embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """``embed_batches`` under its older name."""
    return embed_batches(spark, d)
