"""Approximate dense search: a trained coarse quantiser and inverted lists that hold every vector.

Spherical k-means gives the lists' centres.  It is fitted on a sample of ``SAMPLE`` vectors at most, chosen by a hash of
the id; each round is one Spark job, whose tasks send a sum a list, not vectors.  Then every vector goes to
the list of its nearest centre, and the lists are the buckets of a ``SnapshotStore``.  A query probes the lists
whose centres are nearest to it: only their folders are read, and each list's vectors
meet only the queries that probe it.  Lists of any size are read by as many tasks as they have splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.config import DEFAULT
from ravelin.operators.dense import ROWS, Best, by_blocks, matrix_of, prepared, unit, vector_search
from ravelin.operators.store import SnapshotStore

#: Vectors that the centres are fitted on, at most.
SAMPLE = 100_000
ROUNDS = 10
#: Stored vectors that are searched for exactly to find how many lists must be probed, and the share to be found.
TRIED = 256
RECALL = 0.95


def nearest(rows: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """For each row the numbers of its ``n`` nearest centres, the nearest first; ties to the smaller number."""
    out = np.empty((len(rows), min(n, len(centres))), np.int64)
    step = max(1, 4_000_000 // len(centres))
    for lo in range(0, len(rows), step):
        near = np.round(rows[lo : lo + step] @ centres.T, 12)
        out[lo : lo + step] = near.argmax(axis=1)[:, None] if n == 1 else np.argsort(-near, axis=1, kind="stable")[:, :n]
    return out


def sampled(vectors: DataFrame, most: int = SAMPLE, seed: int = 11) -> DataFrame:
    """``most`` vectors at most (give or take chance), all if there are no more; the same ones for the same ids."""
    share = min(1.0, most / max(1, vectors.count()))
    key = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 30))
    return vectors.filter(key < int(share * (1 << 30)))


def train(vectors: DataFrame, lists: int, sample: int = SAMPLE, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """The centres of ``lists`` lists, rows of length one, from ``vectors`` (id, embedding)."""
    context = vectors.sparkSession.sparkContext
    rows = sampled(prepared(vectors, "id"), sample, seed).persist()
    try:
        first = rows.orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(lists).select("embedding").toArrow()
        if not first.num_rows:
            raise ValueError("there are no vectors to fit lists on")
        centres = unit(matrix_of(first.column(0)))
        dim = centres.shape[1]
        for _ in range(rounds):
            shared = context.broadcast(centres)

            def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                centres = shared.value
                total, n = np.zeros_like(centres), np.zeros(len(centres), np.int64)
                for batch in batches:
                    for lo in range(0, batch.num_rows, ROWS):
                        m = unit(matrix_of(batch.column(1).slice(lo, ROWS)))
                        of = nearest(m, centres)[:, 0]
                        np.add.at(total, of, m)
                        n += np.bincount(of, minlength=len(centres))
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.float64()))], ["list", "n", "total"])

            part = rows.mapInArrow(sums, "list long, n long, total array<double>")
            each = part.select("list", F.posexplode("total").alias("pos", "x")).groupBy("list", "pos").agg(F.sum("x").alias("x"))
            moved = centres.copy()
            found = each.toArrow()  # a number a list and dimension
            moved[np.unique(found.column("list").to_numpy())] = 0
            moved[found.column("list").to_numpy(), found.column("pos").to_numpy()] = found.column("x").to_numpy()
            moved = np.where(np.linalg.norm(moved, axis=1, keepdims=True) > 0, unit(moved), centres)
            shared.unpersist()
            if np.abs(moved - centres).max() < 1e-9:
                break
            centres = moved
        return centres.reshape(-1, dim)
    finally:
        rows.unpersist()


class InvertedLists:
    """Vectors (id, embedding) by list, with the lists' centres and how many lists a query probes."""

    def __init__(self, spark: SparkSession, root: str, lists: int, id_type: str = "string"):
        self.spark, self.lists = spark, lists
        self.vectors = SnapshotStore(spark, f"{root}/vectors", f"list int, id {id_type}, embedding array<float>", "list", lists, by=lambda key, n: F.pmod(key, F.lit(n)))
        self.centres = SnapshotStore(spark, f"{root}/centres", "list int, centre array<double>, probes int")

    def build(self, vectors: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, k: int = DEFAULT.prefetch, recall: float = RECALL) -> int:
        """Fit the centres, put every vector into its list, and return the probes that reach ``recall`` at ``k``; null
        vectors are in no list."""
        centres = train(vectors, self.lists, sample, rounds)
        self.vectors.write(self.placed(vectors, centres))
        probes = self.probes_for(vectors, centres, k, recall)
        self.centres.write(self.spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], self.centres.schema))
        return probes

    def probes_for(self, vectors: DataFrame, centres: np.ndarray, k: int, recall: float) -> int:
        """The least number of lists in which ``TRIED`` stored vectors, at most, find a share of ``recall`` of their
        true neighbours, which an exact search of all vectors gives."""
        tried = sampled(prepared(vectors, "id"), TRIED, 13)
        queries = tried.select(F.col("id").alias("qid"), "embedding")
        hits = vector_search(vectors, queries, k).select("qid", "id")
        met = self.vectors.read().select("id", "list").join(F.broadcast(hits), "id").toArrow()  # TRIED * k rows
        asked = queries.toArrow()
        order = nearest(unit(matrix_of(asked.column(1))), centres, len(centres)) if asked.num_rows else np.zeros((0, len(centres)), np.int64)
        place = np.argsort(order, axis=1)
        row = {q: i for i, q in enumerate(asked.column(0).to_pylist())}
        found = np.array([place[row[q], c] for q, c in zip(met.column("qid").to_pylist(), met.column("list").to_pylist(), strict=True)], np.int64)
        shares = np.cumsum(np.bincount(found, minlength=len(centres))) / max(1, len(found))
        return int(np.searchsorted(shares, recall) + 1) if len(found) else len(centres)

    def placed(self, vectors: DataFrame, centres: np.ndarray) -> DataFrame:
        shared = self.spark.sparkContext.broadcast(centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    of = nearest(unit(matrix_of(part.column(1))), shared.value)[:, 0] if part.num_rows else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), *part.columns], ["list", "id", "embedding"])

        rows = vectors.filter("embedding IS NOT NULL").select("id", F.col("embedding").cast("array<float>"))
        return rows.mapInArrow(place, self.vectors.schema.replace("id string", f"id {rows.schema['id'].dataType.simpleString()}"))

    def _centres(self) -> tuple[np.ndarray, int]:
        found = self.centres.read().orderBy("list").toArrow()
        return np.array(found.column("centre").to_pylist()), found.column("probes")[0].as_py()

    def probed(self, queries: DataFrame, probes: int | None = None) -> list[int]:
        """The lists that any of the queries probes."""
        centres, most = self._centres()
        probes = probes or most

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_pydict({"list": np.unique(nearest(unit(matrix_of(batch.column(1))), centres, probes)).astype(np.int32)})

        found = prepared(queries.select("qid", "embedding"), "qid").mapInArrow(of, "list int").distinct()
        return sorted(r["list"] for r in found.collect())  # as many numbers as lists, at most

    def search(self, queries: DataFrame, k: int = DEFAULT.prefetch, probes: int | None = None, block: int = DEFAULT.query_block, skip_self: bool = True) -> DataFrame:
        """(qid, id, score, rk): for each query (qid, embedding) the k nearest vectors of the ``probes`` lists it probes,
        by default as many as ``build`` found to do.

        Scores are exact; what lies in other lists is missed.  With as many probes as lists the search is exact.
        """
        centres, most = self._centres()
        probes = probes or most
        context = self.spark.sparkContext
        rows = self.vectors.read(self.probed(queries, probes)).select("id", F.col("embedding").cast("array<double>").alias("embedding"), "list")

        def searcher(qids: pa.Array, matrix: np.ndarray):
            lists = nearest(matrix, centres, probes)
            of = {int(c): np.flatnonzero((lists == c).any(axis=1)) for c in np.unique(lists)}
            shared = context.broadcast((qids, matrix, of))

            def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                qids, matrix, of = shared.value
                best = Best(qids, matrix, k, None, skip_self)
                for batch in batches:
                    lists = batch.column(2).to_numpy()
                    for c in np.unique(lists):
                        if int(c) not in of:
                            continue
                        at = np.flatnonzero(lists == c)
                        for lo in range(0, len(at), ROWS):
                            part = batch.take(pa.array(at[lo : lo + ROWS]))
                            m = unit(matrix_of(part.column(1)))
                            for q in range(0, len(of[int(c)]), ROWS):
                                best.meet(part.column(0), m, of[int(c)][q : q + ROWS])
                yield from best.result()

            return search

        return by_blocks(rows, queries, k, block, searcher)
