"""BM25 over stored texts, with document frequencies that follow every change without a full pass.

What a weight needs of the corpus is how many texts have a term, how many texts there are and how long they are
together.  All are sums over texts, so a change adds what comes and takes off what goes.  The table of sums has a row a term number,
as many as the vocabulary at most, and is rewritten at each change; the texts that stay are not read.
It names the version of the texts that it counts: if that is not the store's current one, as after a crash between the two
commits, it is counted anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.config import DEFAULT
from ravelin.operators.keyword import Weights, in_blocks
from ravelin.operators.sparse import repeats, top_k
from ravelin.operators.store import SnapshotStore

#: Rows of the table of sums that are no terms: texts, their terms together, and the version counted.
TEXTS, LENGTH, VERSION = -1, -2, -3
K1, B = 1.2, 0.75


def sums_of(texts: DataFrame, sign: int = 1) -> DataFrame:
    """(ix, n) of texts (sparse, terms), to be added or taken off; combined in each task before the shuffle."""
    rows = texts.select(F.col("sparse.indices").alias("ixs"), F.col("terms").cast("long").alias("terms"))
    each = F.concat(
        F.transform("ixs", lambda i: F.struct(i.alias("ix"), F.lit(1).cast("long").alias("n"))),
        F.array(F.struct(F.lit(TEXTS).alias("ix"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(LENGTH).alias("ix"), F.col("terms").alias("n"))),
    )
    return rows.select(F.explode(each).alias("e")).groupBy("e.ix").agg((F.sum("e.n") * sign).alias("n"))


class TermSums:
    """The sums of a table of texts, by the version of that table."""

    def __init__(self, spark: SparkSession, root: str):
        self.store = SnapshotStore(spark, root, "ix int, n long")

    def version(self) -> int | None:
        found = self.store.read().filter(F.col("ix") == VERSION).first()
        return found["n"] if found else None

    def _write(self, sums: DataFrame, version: int) -> None:
        mark = self.store.spark.createDataFrame([(VERSION, version)], "ix int, n long")
        self.store.write(sums.filter("n <> 0").coalesce(1).unionByName(mark))

    def count(self, texts: DataFrame, version: int) -> None:
        self._write(sums_of(texts), version)

    def change(self, added: DataFrame, removed: DataFrame, before: int, version: int) -> bool:
        """Add and take off texts; False, with nothing done, if the sums are not those of version ``before``."""
        if self.version() != before:
            return False
        kept = self.store.read().filter(F.col("ix") != VERSION)
        both = kept.unionByName(sums_of(added)).unionByName(sums_of(removed, -1))
        self._write(both.groupBy("ix").agg(F.sum("n").alias("n")), version)
        return True

    def read(self) -> DataFrame:
        return self.store.read().filter(F.col("ix") != VERSION)


def weights(sums: DataFrame, asked: DataFrame) -> tuple[DataFrame, float]:
    """(qid, ix, w) with inverse document frequencies as weights of the terms in ``asked`` (qid, ix), and the mean length."""
    whole = {r["ix"]: r["n"] for r in sums.filter(F.col("ix").isin(TEXTS, LENGTH)).collect()}
    n = whole.get(TEXTS, 0)
    df = sums.filter(F.col("ix") >= 0).withColumnRenamed("n", "df")
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.select("qid", "ix").distinct().join(df, "ix").select("qid", "ix", idf.alias("w")), whole.get(LENGTH, 0) / max(1, n)


def search(texts: DataFrame, sums: DataFrame, asked: DataFrame, k: int = DEFAULT.prefetch, k1: float = K1, b: float = B, most: int = 500_000) -> DataFrame:
    """(qid, id, score, rk) of the k best ``texts`` (id, sparse, terms) for ``asked`` (qid, ix).

    A text is scored in its row against all queries, whose terms go to the texts by broadcast, up to ``most`` of them; beyond, or where
    ids repeat, entries of the queries' terms are shuffled.
    """
    found, mean = weights(sums, asked)
    local = found.limit(most + 1).toArrow()
    rows = texts.filter("terms > 0")
    if local.num_rows <= most and not repeats(rows, "id"):
        held = rows.select("id", F.col("sparse.indices").alias("ixs"), F.col("sparse.values").alias("shares"), "terms")

        def scored(weights_: Weights, part: pa.RecordBatch) -> np.ndarray:
            sizes = part.column(1).value_lengths().to_numpy()
            row, place = np.repeat(np.arange(len(sizes)), sizes), weights_.place[part.column(1).flatten().to_numpy()]
            at = np.flatnonzero(place >= 0)
            row, terms_ = row[at], part.column(3).to_numpy()[row[at]]
            n = np.rint(part.column(2).flatten().to_numpy()[at] * terms_)
            return weights_.products(row, place[at], n * (k1 + 1) / (n + k1 * (1 - b + b * terms_ / mean)), len(sizes))

        return in_blocks(held, local, found.schema["qid"], "id", k, DEFAULT.vocabulary, scored=scored)
    entry = F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("e")
    entries = rows.select("id", "terms", entry).select("id", "terms", F.col("e.indices").alias("ix"), F.col("e.values").alias("share"))
    n = F.round(F.col("share") * F.col("terms"))
    part = F.col("w") * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("terms") / F.lit(mean)))
    scores = entries.join(F.broadcast(found) if local.num_rows <= most else found, "ix").groupBy("qid", "id").agg(F.round(F.sum(part) + 1e-12, 9).alias("score"))
    return top_k(scores, "qid", "id", k).select("qid", "id", "score", "rk")
