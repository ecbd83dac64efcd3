"""Keyword search of texts where they are.

A text's terms all lie in its row, so its scores are made there: a task scores its texts against all queries' terms, in Arrow batches, and
keeps its own best k a query.  No posting is shuffled, only k rows a task and query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.config import DEFAULT
from ravelin.functions.text import token_text
from ravelin.operators.dense import Best
from ravelin.operators.sparse import MAX_TERMS, keyword_search, numbered, postings_of, repeats, rounded, stored_postings, top_k

#: Texts that are scored at once, scores of these (a row a text, a column a query), and bytes or entries in them, unless one text has more.
ROWS, CELLS, SIZE = 1_000, 2_000_000, 2_000_000


class Weights:
    """Terms of queries: those at ``place[ix]`` weigh ``weights`` in the queries numbered ``of``, ``counts`` of them from ``starts`` on."""

    def __init__(self, ix: np.ndarray, of: np.ndarray, w: np.ndarray, queries: int, vocabulary: int):
        order = np.argsort(ix, kind="stable")
        self.of, self.weights, self.queries, self.vocabulary = of[order], w[order], queries, vocabulary
        terms, self.starts, self.counts = np.unique(ix[order], return_index=True, return_counts=True)
        self.place = np.full(vocabulary, -1, np.int32)
        self.place[terms] = np.arange(len(terms))

    def scores(self, texts: pa.Array) -> np.ndarray:
        """A row a text and a column a query: what they score together, 0 where they share no term."""
        sizes, row, ix = numbered(texts, self.vocabulary)
        place = self.place[ix]
        asked = place >= 0
        keys, counts = np.unique(row[asked] * len(self.starts) + place[asked], return_counts=True)
        row, place = keys // max(1, len(self.starts)), keys % max(1, len(self.starts))
        return self.products(row, place, rounded(counts / sizes[row], 12), len(texts))

    def products(self, row: np.ndarray, place: np.ndarray, share: np.ndarray, texts: int) -> np.ndarray:
        """As ``scores``, of entries: each has a text's number, the place of a term that is asked for, and its share."""
        out = np.zeros(texts * self.queries)
        met = self.counts[place]
        ends = np.cumsum(met)
        for lo, hi in self._spans(ends):
            n = met[lo:hi]
            at = np.repeat(self.starts[place[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out += np.bincount(np.repeat(row[lo:hi] * self.queries, n) + self.of[at], np.repeat(share[lo:hi], n) * self.weights[at], len(out))
        return out.reshape(texts, self.queries)

    @staticmethod
    def _spans(ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of entries that meet ``CELLS`` weights or so together."""
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")))
            yield lo, hi
            lo = hi


def _slices(found: pa.Array, rows: int) -> Iterator[slice]:
    """Runs of up to ``rows`` texts or lists of ``SIZE`` bytes or entries at most, unless one alone has more."""
    sizes = found.value_lengths() if pa.types.is_list(found.type) else pc.binary_length(found)
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        until = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SIZE, "right"))
        hi = min(max(until, lo + 1), lo + rows)
        yield slice(lo, hi)
        lo = hi


def of_texts(weights: Weights, part: pa.RecordBatch) -> np.ndarray:
    return weights.scores(part.column(1))


def searched(docs: DataFrame, asked: pa.Table, qid: T.StructField, key: str, k: int, vocabulary: int, scored=of_texts) -> DataFrame:
    """(qid, key, score) of the best ``k`` texts of each task for the queries in ``asked`` (qid, ix, w).

    ``docs`` has the key, then the text, or a list an entry of which is a term; ``scored`` gives a slice's scores.
    """
    named = asked.column(0).combine_chunks().dictionary_encode("encode")
    qids, of = named.dictionary, named.indices.to_numpy()
    weights = Weights(asked.column(1).to_numpy(), of, asked.column(2).to_numpy(), len(qids), vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast((qids, weights))
    rows = min(ROWS, max(1, CELLS // len(qids)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, weights = shared.value
        best, every = Best(qids, None, k, None, False), np.arange(len(qids))
        for batch in batches:
            for s in _slices(batch.column(1), rows):
                part = batch.slice(s.start, s.stop - s.start)
                scores = scored(weights, part)
                best.offer(part.column(0), rounded(scores + 1e-12, 9), every, scores > 0)
        for found in best.result():
            yield found.rename_columns([qid.name, key, "score"])

    schema = T.StructType([qid, docs.schema[key], T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(search, schema)


def text_search(
    docs: DataFrame,
    queries: DataFrame,
    qid: str,
    key: str,
    k: int = DEFAULT.prefetch,
    text: str = "text",
    vocabulary: int = DEFAULT.vocabulary,
    most: int = MAX_TERMS,
    block: int = DEFAULT.query_block,
) -> DataFrame:
    """(qid, key, score, rk): the texts of ``docs`` that share terms with a query (qid, ix, w), by dot product, as ``keyword_search``.

    Queries go in blocks of ``block``.  Where their terms are more than ``most`` rows, or where texts' keys repeat, so that rows of one
    key add up, postings are shuffled instead.
    """
    asked = queries.select(qid, "ix", "w")
    local = asked.limit(most + 1).toArrow()
    if local.num_rows > most or repeats(docs, key):
        return keyword_search(postings_of(docs, queries, key, text, vocabulary), queries, qid, key, k)
    return in_blocks(docs.select(key, token_text(F.col(text)).alias("__t")), local, asked.schema[qid], key, k, vocabulary, block)


def stored_search(
    rows: DataFrame,
    queries: DataFrame,
    qid: str = "qid",
    key: str = "id",
    k: int = DEFAULT.prefetch,
    vocabulary: int = DEFAULT.vocabulary,
    most: int = MAX_TERMS,
    block: int = DEFAULT.query_block,
) -> DataFrame:
    """As ``text_search``, of stored ``rows`` (key, sparse): their vectors are scored as they were written, no text is read.

    Rows without a vector are left out.  As there, postings are shuffled only where queries have more than ``most`` terms or keys repeat.
    """
    asked = queries.select(qid, "ix", "w")
    local = asked.limit(most + 1).toArrow()
    held = rows.filter(F.size("sparse.indices") > 0)
    if local.num_rows > most or repeats(held, key):
        return keyword_search(stored_postings(held, key), queries, qid, key, k)

    def scored(weights: Weights, part: pa.RecordBatch) -> np.ndarray:
        sizes = part.column(1).value_lengths().to_numpy()
        row, place = np.repeat(np.arange(len(sizes)), sizes), weights.place[part.column(1).flatten().to_numpy()]
        at = np.flatnonzero(place >= 0)
        return weights.products(row[at], place[at], part.column(2).flatten().to_numpy()[at], len(sizes))

    entries = held.select(key, F.col("sparse.indices").alias("ixs"), F.col("sparse.values").alias("shares"))
    return in_blocks(entries, local, asked.schema[qid], key, k, vocabulary, block, scored)


def in_blocks(docs: DataFrame, local: pa.Table, qid: T.StructField, key: str, k: int, vocabulary: int, block: int = DEFAULT.query_block, scored=of_texts) -> DataFrame:
    """(qid, key, score, rk): ``searched`` for ``block`` queries at a time."""
    number = local.column(0).combine_chunks().dictionary_encode("encode").indices.to_numpy() if local.num_rows else np.zeros(0, np.int32)
    out = docs.sparkSession.createDataFrame([], T.StructType([qid, docs.schema[key], T.StructField("score", T.DoubleType())]))
    for b in range(0, int(number.max(initial=-1)) + 1, block):
        one = searched(docs, local.filter(pa.array((number >= b) & (number < b + block))), qid, key, k, vocabulary, scored)
        out = one if b == 0 else out.unionByName(one)
    return top_k(out, qid.name, key, k).select(qid.name, key, "score", "rk")
