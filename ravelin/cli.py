"""Ingest of a folder from a command line: ``python -m ravelin.cli DOCS STORE [--full]``.

Prints what was done as one line of JSON.  Settings come from the environment: ``RAVELIN_BUCKETS`` and
``RAVELIN_VECTOR_SIZE``, whole numbers; what is no number counts as not set.
"""

from __future__ import annotations

import argparse
import json
import os
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from ravelin import schemas
from ravelin.config import DEFAULT
from ravelin.operators.bm25 import TermSums
from ravelin.operators.ingest import ingest
from ravelin.operators.store import SnapshotStore
from ravelin.sources.files import document_files
from ravelin.sources.providers import EMBEDDERS, HashingEmbedder, embedding_column, make


def whole_number(text: str | None, default: int) -> int:
    """The whole number that a text starts with, as ``12px`` does; the default where it starts with none."""
    found = re.match(r"\s*([+-]?\d+)", text or "")
    return int(found[1]) if found else default


def main(arguments: Sequence[str] | None = None, environment: Mapping[str, str] = os.environ) -> dict[str, int]:
    parser = argparse.ArgumentParser(prog="ravelin", description="Bring a chunk store in step with a folder of documents.")
    parser.add_argument("docs", help="folder of .md, .mdx and .txt files")
    parser.add_argument("store", help="folder of the store, of any file system that Spark writes to")
    parser.add_argument("--full", action="store_true", help="forget the last state and do all files again")
    parser.add_argument("--embedder", choices=sorted(EMBEDDERS), help="provider of dense vectors; none by default")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    buckets = whole_number(environment.get("RAVELIN_BUCKETS"), DEFAULT.buckets)
    size = whole_number(environment.get("RAVELIN_VECTOR_SIZE"), DEFAULT.dim)
    root = given.store.rstrip("/")
    chunks = SnapshotStore(spark, f"{root}/chunks", schemas.STORED_CHUNK, "metadata.source", buckets)
    state = SnapshotStore(spark, f"{root}/state", schemas.FILE_STATE)
    embedder = given.embedder and (HashingEmbedder(size) if given.embedder == "hashing" else make(EMBEDDERS, given.embedder))
    done = ingest(
        document_files(spark, given.docs), chunks, state, full=given.full, embed=embedding_column(embedder) if embedder else None, sums=TermSums(spark, f"{root}/sums")
    )
    print(json.dumps(done))
    return done


if __name__ == "__main__":
    main()
