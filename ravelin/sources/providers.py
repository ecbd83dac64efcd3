"""Model providers behind two small interfaces, with stand-ins that need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.config import DEFAULT

Answer = TypeVar("Answer")


class Embedder(Protocol):
    def embed(self, text: str) -> list[float]: ...

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class ChatModel(Protocol):
    def chat(self, messages: list[dict[str, str]]) -> str: ...

    def stream_chat(self, messages: list[dict[str, str]]) -> Iterator[str]: ...


class HashingEmbedder:
    """Signed feature hashing of words, of unit length: deterministic, with no claim to meaning."""

    def __init__(self, dim: int = DEFAULT.dim):
        self.dim = dim

    def embed(self, text: str) -> list[float]:
        v = np.zeros(self.dim)
        for word in text.lower().split():
            h = xxhash.xxh3_64_intdigest(word)
            v[(h >> 1) % self.dim] += 1.0 if h & 1 else -1.0
        size = np.linalg.norm(v)
        return (v / size if size else v).tolist()

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [self.embed(t) for t in texts]


class ExtractiveModel:
    """Answers with the first sentence of the context."""

    def chat(self, messages: list[dict[str, str]]) -> str:
        context = messages[-1]["content"].partition("\n\n")[2]
        return context.split(". ")[0].strip()

    def stream_chat(self, messages: list[dict[str, str]]) -> Iterator[str]:
        for k, word in enumerate(self.chat(messages).split(" ")):
            yield word if k == 0 else " " + word


EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashing": HashingEmbedder}
CHAT_MODELS: dict[str, Callable[[], ChatModel]] = {"extractive": ExtractiveModel}


def make(kinds: dict[str, Callable[[], Answer]], name: str) -> Answer:
    if name not in kinds:
        raise ValueError(f"unknown provider {name!r}; known: {', '.join(sorted(kinds))}")
    return kinds[name]()


def embedding_column(embedder: Embedder, batch: int = DEFAULT.batch) -> Callable[[str], Column]:
    """A column function that embeds texts in batches; every text's vector has one dimension."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        values = texts.fillna("").tolist()
        found: list[list[float]] = []
        for i in range(0, len(values), batch):
            found += embedder.embed_batch(values[i : i + batch])
        if len({len(v) for v in found}) > 1:
            raise ValueError("embeddings differ in dimension")
        return pd.Series(found)

    return embed


def with_retry(call: Callable[[], Answer], attempts: int = 3, delay: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """The call's result; after a failure it is tried again, waiting twice as long each time."""
    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k == attempts - 1:
                raise
            sleep(delay * 2**k)
    raise ValueError("attempts must be one at least")
