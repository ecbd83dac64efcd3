"""Incremental ingest: what changed between two listings, and the chunks of what did."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ravelin.config import DEFAULT, Config
from ravelin.functions.text import title_of
from ravelin.operators import chunking
from ravelin.operators.bm25 import TermSums
from ravelin.operators.sparse import encoded_text
from ravelin.operators.store import Head, SnapshotStore, last_wins


def hashed(files: DataFrame) -> DataFrame:
    """(source, hash) of files (source, content)."""
    return files.select("source", F.md5(F.encode(F.coalesce("content", F.lit("")), "UTF-8")).alias("hash"))


def deleted(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.select("source").join(current.select("source"), "source", "left_anti")


def todo(current: DataFrame, previous: DataFrame, full: bool = False) -> DataFrame:
    if full:
        return current.select("source")
    return current.join(previous, ["source", "hash"], "left_anti").select("source")


def skipped(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous, ["source", "hash"], "left_semi").select("source")


def chunked(files: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Chunks with ids of files (source, content); of equal ids, which only one source can have, the last chunk."""
    docs = files.select("source", title_of(F.col("content"), F.col("source")).alias("title"), "content")
    rows = chunking.with_ids(chunking.chunks(chunking.sections(docs), config))
    return last_wins(rows, ["source", "id"], ["section_ord", "chunk_index"])


def stored(chunks: DataFrame, embed=None) -> DataFrame:
    """Chunks as the store holds them: dense and sparse vector, nested metadata.  Each is made in its row."""
    embedding = embed("content") if embed else F.lit(None).cast("array<float>")
    rows = chunks.select("*", encoded_text(F.col("content")).alias("__e"))
    return rows.select(
        "id",
        "content",
        embedding.alias("embedding"),
        F.col("__e.sparse").alias("sparse"),
        F.col("__e.terms").alias("terms"),
        F.struct("source", "title", "section_title", "chunk_index").alias("metadata"),
    )


def metrics(current: DataFrame, previous: DataFrame, chunks: DataFrame, full: bool = False) -> DataFrame:
    """One row: processed, skipped and deleted files, and chunks made."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    done = one(todo(current, previous, full), "processed")
    kept = one(skipped(current, previous) if not full else current.limit(0), "skipped")
    gone = one(deleted(current, previous), "deleted")
    return done.join(kept, how="cross").join(gone, how="cross").join(one(chunks, "chunks"), how="cross")  # one row each


def changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(source, state) of two listings (source, hash): new, changed, same or gone; one join of both."""
    was = previous.select("source", F.col("hash").alias("__was"))
    state = (
        F.when(F.col("hash").isNull(), "gone").when(F.col("__was").isNull(), "new").when(F.col("hash") == F.col("__was"), "same").otherwise("changed")
    )
    return current.join(was, "source", "full").select("source", state.alias("state"))


def follow(sums: TermSums, chunk_store: SnapshotStore, base: Head, changed: DataFrame | None) -> None:
    """Bring ``sums`` from the store's state ``base`` to its current one, which differs in the sources ``changed`` (source)."""
    number = chunk_store.version
    if changed is not None:
        buckets = chunk_store.buckets_of(changed)
        theirs = lambda head: chunk_store.read(buckets, head).join(
            changed.select(F.col("source").alias("__source")), F.col(chunk_store.key) == F.col("__source"), "left_semi"
        )
        if sums.change(theirs(chunk_store.head()), theirs(base), base.number, number):
            return
    sums.count(chunk_store.read(), number)


def ingest(files: DataFrame, chunk_store: SnapshotStore, state: SnapshotStore, full: bool = False, embed=None, config: Config = DEFAULT, sums: TermSums | None = None) -> dict[str, int]:
    """Bring the store in step with ``files`` (source, content); counts of what was done.

    The listing with its hashes is written once, before any text is chunked, and what changed is written beside it; both
    counts come from that write.  All decisions come from these tables: a file that is edited meanwhile keeps its
    older hash and is done again by the next run.  Only buckets of changed and deleted files are rewritten.
    The chunk store's pointer moves before the state's: a crash between them repeats work
    and loses none.  ``sums``, if given, follow the change from the rows that came and went.  Where nothing changed nothing is written.  A state that cannot be read counts as empty.
    """
    base, state_base = chunk_store.head(), state.head()
    previous = state.spark.createDataFrame([], "source string, hash string") if full else state.read_or_empty()
    listed = state.stage(hashed(files))
    seen = Observation()
    one = lambda *states: F.count(F.when(F.col("state").isin(*states), 1))
    diff = changes(state.read_staged(listed), previous)
    counts = diff.observe(seen, one("new", "changed").alias("processed"), one("same").alias("skipped"), one("gone").alias("deleted"))
    differing = f"{state.root}/diff-{listed}"
    counts.filter("state <> 'same'").write.parquet(differing)
    found = {name: seen.get[name] for name in ("processed", "skipped", "deleted")}
    try:
        if not full and not found["processed"] and not found["deleted"]:
            state.drop(listed)
            return found | {"chunks": chunk_store.count()}
        changed = state.spark.read.schema("source string, state string").parquet(differing)
        todo_ = changed.filter("state <> 'gone'")
        new = stored(chunked(files.join(todo_, "source", "left_semi"), config), embed)
        if full:
            chunk_store.commit(chunk_store.stage(new), base)
        else:
            chunk_store.replace_sources(changed, new, base)
        if sums:
            follow(sums, chunk_store, base, None if full else changed)
        state.commit(listed, state_base)
    finally:
        state.drop(f"diff-{listed}")
    return found | {"chunks": chunk_store.count()}
