"""Answers to questions, whole or as a stream, from retrieved chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.config import NOT_FOUND
from ravelin.operators import prompt
from ravelin.sources.providers import ChatModel, with_retry


def prepared(question: str, history: list[dict[str, str]], hits: DataFrame) -> tuple[list[dict[str, str]], list[dict]]:
    """Messages and sources for one question from its few hits (rk, title, source, score, content)."""
    spark = hits.sparkSession
    rows = hits.orderBy("rk").collect()
    sources = [{"title": r["title"], "source": r["source"], "score": r["score"]} for r in rows]
    asked = spark.createDataFrame(
        [(0, question, [(m["role"], m["content"]) for m in history])],
        "qid int, question string, history array<struct<role: string, content: string>>",
    )
    context = prompt.context(hits.withColumn("qid", F.lit(0)))
    found = prompt.messages(asked.join(context, "qid", "left")).orderBy("seq").collect()
    return [{"role": m["role"], "content": m["content"]} for m in found], sources


def answer(question: str, history: list[dict[str, str]], hits: DataFrame, model: ChatModel) -> tuple[str, list[dict]]:
    messages, sources = prepared(question, history, hits)
    return (with_retry(lambda: model.chat(messages)), sources) if sources else (NOT_FOUND, [])


def answer_events(question: str, history: list[dict[str, str]], hits: DataFrame, model: ChatModel) -> Iterator[str]:
    """Server-sent events: the sources, each token that is not empty, the end."""
    if not question.strip():
        raise ValueError("the question is blank")
    messages, sources = prepared(question, history, hits)
    event = lambda body: f"data: {body}\n\n"
    yield event(json.dumps({"type": "sources", "sources": sources}))
    for token in model.stream_chat(messages) if sources else (NOT_FOUND,):
        if token:
            yield event(json.dumps({"type": "token", "token": token}))
    yield event("[DONE]")
