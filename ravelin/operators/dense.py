"""Dense search: exact, by blocks of queries against all vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.config import DEFAULT
from ravelin.operators.sparse import top_k


def matrix_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def unit(m: np.ndarray) -> np.ndarray:
    size = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


#: Vectors and queries that are multiplied at once.
ROWS = 2_000


class Best:
    """The best ``k`` rows of each query that a task has met: score, ties by id.

    What is worse than a query's k-th best is not kept; the rest is cut down to k a query whenever
    it has doubled, so a task holds and sends k rows a query.
    """

    def __init__(self, qids: pa.Array, matrix: np.ndarray | None, k: int, least: float | None, skip_self: bool):
        self.qids, self.matrix, self.k, self.least, self.skip_self = qids, matrix, k, least, skip_self
        self.bound = np.full(len(qids), -np.inf)
        self.held: list[pa.Table] = []
        self.rows, self.most = 0, 2 * k * max(1, len(qids))

    def meet(self, ids: pa.Array, rows: np.ndarray, of: np.ndarray) -> None:
        """Score vectors against the queries numbered ``of``."""
        scores = np.round(rows @ self.matrix[of].T, 9)
        keep = np.ones(scores.shape, bool)
        if self.least is not None:
            keep &= scores > self.least
        if self.skip_self:
            same = pc.index_in(ids.cast(self.qids.type), value_set=self.qids.take(pa.array(of))).to_pylist()
            for at, q in enumerate(same):
                if q is not None:
                    keep[at, q] = False
        self.offer(ids, scores, of, keep)

    def offer(self, ids: pa.Array, scores: np.ndarray, of: np.ndarray, keep: np.ndarray) -> None:
        """Take from scores, a row an id and a column a query numbered ``of``, what is marked in ``keep`` and among the best."""
        keep &= scores >= self.bound[of]
        scores[~keep] = -np.inf
        if len(ids) > self.k:
            keep &= scores >= np.partition(scores, len(ids) - self.k, axis=0)[len(ids) - self.k]
        at, q = np.nonzero(keep)
        self.held.append(pa.table({"q": of[q], "id": ids.take(pa.array(at)), "score": scores[at, q]}))
        self.rows += len(at)
        if self.rows > self.most:
            self.cut()

    def cut(self) -> pa.Table:
        found = pa.concat_tables(self.held).combine_chunks().sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        q = found.column("q").to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        found = found.filter(pa.array(place < self.k))
        q, score = found.column("q").to_numpy(), found.column("score").to_numpy()
        last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1)
        self.bound[q[last]] = score[last]
        self.held, self.rows = [found], len(q)
        return found

    def result(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            found = self.cut()
            table = pa.table({"qid": self.qids.take(found.column("q").combine_chunks()), "id": found.column("id"), "score": found.column("score")})
            yield from table.combine_chunks().to_batches()


def prepared(rows: DataFrame, key: str) -> DataFrame:
    """Ids and vectors as doubles, without null vectors."""
    return rows.filter("embedding IS NOT NULL").select(key, F.col("embedding").cast("array<double>"))


def by_blocks(
    rows: DataFrame, queries: DataFrame, k: int, block: int, searcher: Callable[[pa.Array, np.ndarray], Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]
) -> DataFrame:
    """(qid, id, score, rk): what ``searcher`` finds in ``rows`` for the queries, a block of these at a time."""
    spark = rows.sparkSession
    asked = prepared(queries.select("qid", "embedding"), "qid")
    schema = T.StructType([T.StructField("qid", asked.schema["qid"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b)
        table = part.toArrow().combine_chunks()
        if not table.num_rows:
            continue
        one = rows.mapInArrow(searcher(table.column("qid").combine_chunks(), unit(matrix_of(table.column("embedding")))), schema)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], schema)
    return top_k(found, "qid", "id", k).select("qid", "id", "score", "rk")


def vector_search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT.prefetch,
    least: float | None = None,
    block: int = DEFAULT.query_block,
    skip_self: bool = True,
) -> DataFrame:
    """(qid, id, score, rk): for each query the ``k`` nearest vectors by cosine.  The vector that has the
    query's id is left out, unless ``skip_self`` is false, as for queries that are no stored vectors.

    ``vectors`` has (id, embedding), ``queries`` (qid, embedding); ids keep their types.  The query set is stated
    and goes in blocks of ``block`` rows; each task multiplies its vectors with the block and
    keeps its own best k, so k rows a task and query are shuffled.  Scores are rounded to 9
    digits before they are ranked; ties go to the smaller id.  Only scores above
    ``least`` count, if it is given.  Vectors of another dimension than the first query's
    are an error; null vectors are left out; a vector without length scores 0.
    """
    context = vectors.sparkSession.sparkContext

    def searcher(qids: pa.Array, matrix: np.ndarray):
        shared = context.broadcast((qids, matrix))
        every = np.arange(len(qids))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(*shared.value, k, least, skip_self)
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    rows = unit(matrix_of(part.column(1)))
                    for q in range(0, len(every), ROWS):
                        best.meet(part.column(0), rows, every[q : q + ROWS])
            yield from best.result()

        return search

    return by_blocks(prepared(vectors, "id"), queries, k, block, searcher)
