"""Constants that retrieval results depend on, in one object."""

from __future__ import annotations

from dataclasses import dataclass

# Words that carry no meaning for keyword search.
STOPWORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will "
    "would could should may might can this that these those it its as if then than so up out about into through during "
    "before after above below between each all both more also when where which who how what not no nor very"
).split()

# Fixed value: the namespace of chunk ids.
CHUNK_NAMESPACE = "b3d2e1f0-4a5b-6c7d-8e9f-0a1b2c3d4e5f"

NOT_FOUND = "Nothing in the documents answers this question."


@dataclass(frozen=True)
class Config:
    max_chunk: int = 1500
    overlap: int = 150
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")
    vocabulary: int = 500_000
    batch: int = 10
    #: Buckets of a chunk store: one should hold some hundred megabytes, at most what is worth rewriting for one file.
    buckets: int = 64
    dim: int = 64
    prefetch: int = 20
    top_k: int = 5
    rrf_k: int = 60
    min_score: float = 0.01
    min_cosine: float = 0.6
    history_messages: int = 6
    excerpt: int = 200
    context_separator: str = "\n\n---\n\n"
    #: A query set of at most so many rows is broadcast; a larger one goes block by block.
    query_block: int = 10_000


DEFAULT = Config()
