"""Resampling towards a target distribution by importance weights of hashed n-grams.

A text's separators collapse to single spaces, and one overlapped regular-expression scan, bounded by lookarounds,
emits the spans of all n-grams: a match starts at every word and takes the longest run of up to ``n``
words; its groups are the words, so that the CRC of each shorter run is on the way to that of the longest.
CRCs modulo ``buckets`` are counted a text, and a table of these counts is written once.

From it come the corpus's totals a bucket (added up in each task before the shuffle), and with the target's totals the gain
of each bucket, ``buckets`` numbers that go to all tasks.  A document's weight is the floored mean gain of its n-grams; Gumbel noise
from a hash of its id turns the highest scores into a draw without replacement with chances in proportion
to exp(weight / 1000).  Ranks are global without any task seeing all rows: rows are sorted by ranges of
(score, id, row), ranges are counted, and a row's rank is its place in its range after all
ranges before.  The row's number, written with the counts, splits rows that agree in all else.

Null and empty texts have no n-grams: their weight is 0.  Documents with fewer than ``min_words`` words get a score
but are never drawn.  Ties go to the smaller id, null ids last (their noise is that of an empty
id).  Repeated rows are drawn each for itself.  Very long texts are counted as a
stream.  Columns other than id and text are not read.  Empty tables, of either kind, are allowed.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.llm.common import broadcast_if_small, id_text, sliced, table, text_bytes, written

N = 2
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7

#: Bytes of words stay, A-Z in lower case; all others become spaces.
_TO_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Texts up to this size are collapsed by way of a list of their words.
_LISTED = 1 << 22


def collapsed(text: bytes) -> bytes:
    """The words of a text with single spaces between them."""
    plain = text.translate(_TO_WORDS)
    return b" ".join(plain.split()) if len(plain) <= _LISTED else re.sub(rb" +", b" ", plain).strip(b" ")


def scanner(n: int) -> regex.Pattern:
    """At each word the longest run of up to ``n`` words; a group a word, with the space before it."""
    more = b""
    for _ in range(n - 1):
        more = rb"(?:( [^ ]++)" + more + rb")?"
    return regex.compile(rb"(?<![^ ])([^ ]++)" + more + rb"(?![^ ])")


def crcs(words: bytes, pattern: regex.Pattern) -> Iterator[int]:
    """CRC-32 of every n-gram of a collapsed text, repeats and all."""
    crc32 = zlib.crc32
    for match in pattern.finditer(words, overlapped=True):
        crc = 0
        for part in match.groups():
            if part is None:
                break
            crc = crc32(part, crc)
            yield crc


def bucket_counts(words: bytes, pattern: regex.Pattern, buckets: int) -> np.ndarray:
    counts = np.zeros(buckets, np.int64)
    found = crcs(words, pattern)
    while len(some := np.fromiter(islice(found, 1 << 16), np.int64)):
        counts += np.bincount(some % buckets, minlength=buckets)
    return counts


def features(docs: DataFrame, n: int = N, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets, counts) of ``docs`` (doc_id, text): the buckets that a text has, and how often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = scanner(n)
        for batch in sliced(batches):
            sizes, totals, places, values = [], [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            ends = [0]
            for text in text_bytes(batch.column(1)):
                words = collapsed(text)
                counts = bucket_counts(words, pattern, buckets)
                at = np.flatnonzero(counts)
                sizes.append(words.count(b" ") + 1 if words else 0)
                totals.append(int(counts.sum()))
                places.append(at.astype(np.int32))
                values.append(counts[at])
                ends.append(ends[-1] + len(at))
            ends = pa.array(ends, pa.int32())
            columns = [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(totals, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places))),
                pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "buckets", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_words long, n_features long, buckets array<int>, counts array<long>")


def totals(found: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in ``features``' rows; one number a bucket reaches the driver."""
    each = found.select(F.explode(F.arrays_zip("buckets", "counts")).alias("e")).select("e.buckets", "e.counts")
    out = np.zeros(buckets, np.int64)
    for bucket, n in each.groupBy("buckets").agg(F.sum("counts")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target, with one added to every count."""
    all_s, all_t, n = float(corpus.sum()), float(target.sum()), float(len(corpus))
    ratios = ((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``features``' rows (with a number, row) with their weights in place of their buckets."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            worth = gain[lists.flatten().to_numpy()] * batch.column("counts").flatten().to_numpy()
            sums = np.concatenate([[0], np.cumsum(worth)])[ends]
            n = batch.column("n_features").to_numpy()
            weight = np.where(n > 0, np.diff(sums) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(weight, pa.int64())], [*keep, "weight"])

    keep = ["row", "doc_id", "n_words", "n_features"]
    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(weigh, f"row long, doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: int) -> F.Column:
    """Thousandths of a standard Gumbel variable, from a hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_text("doc_id")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[F.Column]) -> DataFrame:
    """``rows`` with their rank, from 1, in the whole table's order, which must be total."""
    parts = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "importance-order")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__place", place).join(F.broadcast(starts), "__part").withColumn("rank", F.col("__place") + F.col("__start")).drop("__part", "__place", "__start")


def resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = N,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of ``docs`` (doc_id, text).

    ``target`` (text) is what the drawn documents should be like.  rank is null for rows that are not drawn; ``percent`` of
    the rows with ``min_words`` words or more are.
    """
    found = written(features(docs, n, buckets).withColumn("row", F.monotonically_increasing_id()), "importance-features")
    aim = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets)
    gain = gains(totals(found, buckets), totals(aim, buckets))
    scored = written(weighted(found, gain).withColumn("score", F.col("weight") + noise(seed)), "importance-scores")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")]
    places = ranked(able, order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return places.unionByName(short).drop("row")


def drawn_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ids ``resample`` drew; rows that share an id go together."""
    ids = written(found.filter("rank IS NOT NULL").select("doc_id").distinct(), "importance-drawn")
    return docs.join(broadcast_if_small(ids), "doc_id", "left_semi").select(*docs.columns)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BYTES = "list_transform(range(1, length(hex(encode(f))) // 2 + 1), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)"
#: The CRC's table of 256 entries by its rule: eight steps of the reflected polynomial.
_TABLE = "SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT) ORDER BY b) AS t FROM range(256) r(b)"


def _counted(name: str, key: str) -> str:
    return f"""{name}_w AS (SELECT {key} AS id, {_WORDS} AS w FROM {name}
), {name}_f AS (
  SELECT id, unnest(w) AS f FROM {name}_w
  UNION ALL SELECT id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM {name}_w
)"""


SQL = f"""
WITH {_counted("documents", "doc_id")}, {_counted("benchmark", "item_id")}, crc AS ({_TABLE}
), named AS (
  SELECT f, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT f, {_BYTES} AS b FROM (SELECT f FROM documents_f UNION SELECT f FROM benchmark_f)), crc
), s AS (SELECT bucket, count(*) AS n FROM documents_f JOIN named USING (f) GROUP BY bucket
), t AS (SELECT bucket, count(*) AS n FROM benchmark_f JOIN named USING (f) GROUP BY bucket
), gains AS (
  SELECT range AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM documents_f) + 10000)
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM benchmark_f) + 10000))))::BIGINT AS gain
  FROM range(10000) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range
), weights AS (
  SELECT id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM documents_f JOIN named USING (f) JOIN gains USING (bucket) GROUP BY id
), scored AS (
  SELECT d.id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents_w d LEFT JOIN weights USING (id)
), able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) * 25 // 100 FROM able) THEN rank END AS rank
FROM scored LEFT JOIN able USING (doc_id)
"""
