"""Explicit schemas of the data model."""

from __future__ import annotations

RAW_DOCUMENT = "source string, title string, content string"
CHUNK = "source string, title string, section_ord int, section_title string, chunk_index int, content string"
SPARSE = "struct<indices: array<int>, values: array<double>>"
STORED_CHUNK = (
    "id string, content string, embedding array<float>, sparse struct<indices: array<int>, values: array<double>>, terms int, "
    "metadata struct<source: string, title: string, section_title: string, chunk_index: int>"
)
FILE_STATE = "source string, hash string"
CHAT_REQUEST = "question string, history array<struct<role: string, content: string>>"
