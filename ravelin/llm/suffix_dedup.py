"""Removal of repeated byte strings by blockwise suffix sorting over a cover sample.

A byte goes if a string of ``LENGTH`` bytes over it also starts earlier: in a document with
a smaller id, or earlier in its own.  Whole suffixes of all documents can't be moved
to where they sort, so a sample of positions covers them: among the ``SPAN`` places of a
string of ``LENGTH`` bytes at which a gram of ``GRAM`` bytes starts, the one with the least hash
(the last of equals) is in the sample and stands for the string.  The choice depends on the
string alone, so equal strings have a sample position at the same place, as a difference
cover has for any two suffixes.  Sample positions whose gram occurs once take no part.

The rest fall into buckets by gram, and a task sorts one block of buckets at a time.  In a
bucket, the suffixes at the sample positions are sorted, and so are the reversed
prefixes before them; neighbours' common lengths then give ranks at every depth.
Two strings that start j bytes before their sample positions are equal when their
left ranks at depth j and their right ranks at depth LENGTH - j are: long ties are
settled by these ranks, and no string is compared twice.  Memory is bounded by the
block (``BLOCK_ROWS`` contexts).  Equal contexts are combined in each task before the
shuffle, so that the thousandth copy of a passage costs no more than the second; a
gram with more than ``HOT`` positions has a bucket for each ``STEP`` offsets and each text
that all strings at these offsets have in common.

Later copies of a whole text need no sorting: the first copy decides (of 100 bytes or more
they go altogether).

Null counts as empty; texts shorter than ``LENGTH`` keep all.  Rows that repeat id and text are one
document; rows that share an id only are told apart by their text's hash; a null id
comes before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import broadcast_if_small, discard, release, table, text_bytes, written

LENGTH, GRAM = 100, 32
#: Contexts that are sorted at once, and positions of one gram beyond which its bucket is cut up.
BLOCK_ROWS, HOT = 100_000, 50_000
#: Offsets of strings from a frequent gram that share a bucket.
STEP = 9
#: Bytes of text whose sample is drawn at once.
_SEGMENT = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64(_SEGMENT - 1)
#: A position is stored with its distances from the first and last string that it stands for.
_OFFSET_BITS = 12
_OFFSET = (1 << _OFFSET_BITS) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes (a power of two) from each position, by doubling."""
    h = _mixed((data.astype(np.uint64) + np.uint64(1)) * _ODD)
    width = 1
    while width < GRAM:
        h = _mixed(h[:-width] * _ODD + h[width:])
        width *= 2
    return h


def sample(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sample positions of a text, their grams' hashes, and the first and last string that
    each stands for: every string of ``length`` bytes has one position that it chose."""
    parts = []
    span = length - GRAM + 1
    for start in range(0, max(len(data) - length + 1, 0), _SEGMENT - length + 1):
        h = gram_hashes(data[start : start + _SEGMENT])
        key = (h & ~_LOW) | (_LOW - np.arange(len(h), dtype=np.uint64))
        least, width = key, 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        at = (_LOW - (least & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(first[1:], len(at)) - 1
        parts.append((at[first] + start, h[at[first]].view(np.int64), first + start, last + start))
    if not parts:
        return (np.empty(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


# -- sample positions ---------------------------------------------------------------


def _sampler(length: int):
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places, grams = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                place, gram, first, last = sample(np.frombuffer(text, np.uint8), length)
                keys.append(np.full(len(place), key, np.int64))
                places.append((((place << _OFFSET_BITS) | (place - first)) << _OFFSET_BITS) | (place - last))
                grams.append(gram)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (grams, keys, places)], ["gram", "key", "place"])

    return draw


def _repeated(positions: DataFrame) -> DataFrame:
    """The positions whose gram has several, with their number n.

    The counts are a table of their own, so that Spark can split a gram that a large
    share of the positions has.
    """
    many = written(positions.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-grams")
    release(positions.sparkSession)
    return positions.join(many, "gram")


# -- contexts -----------------------------------------------------------------------

_CONTEXT = "bucket long, key long, place long, before int, bytes binary, until long"
_CONTEXT_NAMES = ["bucket", "key", "place", "before", "bytes", "until"]
_CONTEXT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())


def _pieces(text: bytes, at: int, far: int, near: int, length: int, gram: int, hot: bool) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the contexts of a sample position that stands for the strings that
    start ``far`` to ``near`` bytes before it: one, or, for a frequent gram, one for each ``STEP``
    such offsets, bucketed by what strings at these offsets have in common."""
    if not hot:
        yield gram, at - far, at - near + length
        return
    for low in range(near - near % STEP, far + 1, STEP):
        high = low + STEP - 1
        common = text[at - low : at + length - high]  # within the text, as part of each of these strings
        yield xxhash.xxh3_64_intdigest(common, seed=low + 1) - 2**63, at - min(high, far), at - max(low, near) + length


def _contexts(length: int, hot: int):
    """The bytes around each position, and, in place of contexts that repeat an earlier one of the task, what they remove."""

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CONTEXT_TYPES, strict=True)], _CONTEXT_NAMES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, tuple[int, int]] = {}
        rows: list[tuple] = []
        for batch in batches:
            order = np.argsort(batch.column(0).to_numpy(), kind="stable").tolist()
            for i in order:
                key, text = batch.column(0)[i].as_py(), text_bytes(batch.column(1).slice(i, 1))[0]
                gone = []
                for p in batch.column(2)[i].as_py():
                    at, far, near = p["place"] >> 2 * _OFFSET_BITS, p["place"] >> _OFFSET_BITS & _OFFSET, p["place"] & _OFFSET
                    for bucket, a, b in _pieces(text, at, far, near, length, p["gram"], p["n"] > hot):
                        data = text[a:b]
                        print_ = xxhash.xxh3_128_digest(data + (at - a).to_bytes(2, "little") + bucket.to_bytes(8, "little", signed=True))
                        first = seen.get(print_)
                        if first is not None and first < (key, at):
                            gone.append((a, b))
                            continue
                        if len(seen) < 300_000:
                            seen[print_] = (key, at)
                        rows.append((bucket, key, at, at - a, data, None))
                rows += [(key, key, a, None, None, b) for a, b in joined_spans(gone)]
                if len(rows) >= 20_000:
                    yield packed(rows)
                    rows = []
        yield packed(rows)

    return cut


# -- blockwise sorting --------------------------------------------------------------


def _ranks(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes, and common lengths of neighbours in that order."""
    width = -(-strings.shape[1] // 8) * 8
    padded = np.zeros((len(strings), width), np.uint8)
    padded[:, : strings.shape[1]] = strings
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    ordered = strings[order]
    differs = ordered[1:] != ordered[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), strings.shape[1])
    return order, common


def _depth(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Each row's rank when only its first ``depth`` bytes count: equal for ties."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(common < depth)))
    return rank


def sort_block(bucket: np.ndarray, key: np.ndarray, place: np.ndarray, before: np.ndarray, data: list[bytes], length: int = LENGTH):
    """(key, start, end) of all strings in a block of buckets that also start earlier."""
    reach = length - GRAM
    rows = np.lexsort((place, key))
    bucket, key, place, before = bucket[rows], key[rows], place[rows], before[rows]
    n = len(rows)
    left, right = np.zeros((n, reach), np.uint8), np.zeros((n, length), np.uint8)
    after = np.empty(n, np.int64)
    for i, r in enumerate(rows.tolist()):
        raw = np.frombuffer(data[r], np.uint8)
        b = int(before[i])
        left[i, :b] = raw[:b][::-1]
        after[i] = len(raw) - b
        right[i, : after[i]] = raw[b:]
    left_order, left_common = _ranks(left)
    right_order, right_common = _ranks(right)
    low, high = np.full(n, length, np.int64), np.full(n, -1, np.int64)
    found = []
    for j in range(reach + 1):
        fits = np.flatnonzero((before >= j) & (after >= length - j))
        if len(fits) < 2:
            continue
        whole = _depth(left_order, left_common, j)[fits] * n + _depth(right_order, right_common, length - j)[fits]
        _, first = np.unique(whole, return_index=True)
        again = np.ones(len(fits), bool)
        again[first] = False
        hit = fits[again]
        broken = hit[(high[hit] >= 0) & (high[hit] != j - 1)]  # offsets apart by a gap are spans of their own
        if len(broken):
            found.append((key[broken], place[broken] - high[broken], place[broken] - low[broken] + length))
            low[broken] = length
        low[hit] = np.minimum(low[hit], j)
        high[hit] = j
    hit = np.flatnonzero(high >= 0)
    found.append((key[hit], place[hit] - high[hit], place[hit] - low[hit] + length))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _marker(length: int, block_rows: int):
    """Contexts sorted by bucket -> spans that go.  A block ends with a bucket."""

    def spans_of(rows: pa.Table) -> pa.RecordBatch:
        known = rows.filter(pa.compute.is_valid(rows.column("until")))
        open_ = rows.filter(pa.compute.is_null(rows.column("until")))
        bucket = open_.column("bucket").to_numpy()
        new = np.append(True, bucket[1:] != bucket[:-1]) if len(bucket) else np.empty(0, bool)
        run = np.cumsum(new) - 1
        many = (np.bincount(run) > 1)[run] if len(run) else np.empty(0, bool)
        open_ = open_.filter(pa.array(many, pa.bool_()))
        parts = [(known.column("key").to_numpy(), known.column("place").to_numpy(), known.column("until").to_numpy())]
        if len(open_):
            columns = [open_.column(c).to_numpy() for c in ("bucket", "key", "place", "before")]
            parts.append(sort_block(*columns, open_.column("bytes").to_pylist(), length))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)], ["key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < block_rows:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            bucket = rows.column("bucket").to_numpy()
            apart = np.flatnonzero(bucket != bucket[-1])
            cut = int(apart[-1]) + 1 if len(apart) else 0
            if cut:
                yield spans_of(rows.slice(0, cut))
            held, n = rows.slice(cut).to_batches(), n - cut
        if held:
            yield spans_of(pa.Table.from_batches(held).combine_chunks())

    return run


# -- results --------------------------------------------------------------------------


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, last = [], 0
    for s, e in spans:
        out.append(data[last:s])
        last = e
    return b"".join([*out, data[last:]])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, marks in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            spans = joined_spans([(m["start"], m["end"]) for m in marks])
            kept = kept_bytes(text, spans)
            rows.append((key, len(text) - len(kept), [{"start": s, "end": e} for s, e in spans], hashlib.sha256(kept).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "n_removed", "spans", "kept"])


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, text) of all distinct documents, and (key, doc_id, sha, n_bytes) of all rows.

    The key orders documents; it is the doc_id itself where ids are unique and not null.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    facts = written(
        rows.select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "suffix-rows"
    )
    odd = facts.filter("doc_id IS NULL").limit(1).unionByName(
        facts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit("").alias("sha"), F.lit(0).cast("long").alias("n_bytes")).limit(1)
    )
    if odd.isEmpty():
        return rows.withColumnRenamed("doc_id", "key"), facts.withColumn("key", F.col("doc_id"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("sha")]
    distinct = facts.distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    keys = written(distinct.withColumn("key", F.monotonically_increasing_id()), "suffix-keys").select(
        F.col("doc_id").alias("__d"), F.col("sha").alias("__s"), "key"
    )
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("sha") == F.col("__s"))
    one = rows.dropDuplicates().withColumn("sha", F.sha2("text", 256))
    return one.join(keys, same).select("key", "text"), facts.join(keys, same).select("key", "doc_id", "sha", "n_bytes")


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (of bytes, start and end) and kept_sha256 of every row of ``docs`` (doc_id, text)."""
    if not GRAM < length <= _OFFSET:
        raise ValueError(f"length must be over {GRAM} and at most {_OFFSET} bytes")
    spark = docs.sparkSession
    texts, facts = _keyed(docs)
    # texts that occur once are their own first
    firsts = written(facts.groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "suffix-firsts")
    facts = written(facts.join(broadcast_if_small(firsts), "sha", "left").withColumn("first", F.coalesce("first", "key")), "suffix-facts")
    later = facts.filter("key <> first").select("key").distinct()
    positions = written(texts.mapInArrow(_sampler(length), "gram long, key long, place long"), "suffix-sample")
    some = written(_repeated(positions), "suffix-repeated")
    discard(positions)
    release(spark)
    some = written(_repeated(some.drop("n").join(later, "key", "left_anti")), "suffix-positions")
    release(spark)
    by_text = some.groupBy("key").agg(F.collect_list(F.struct("place", "gram", "n")).alias("places"))
    contexts = texts.join(by_text, "key").select("key", "text", "places").mapInArrow(_contexts(length, hot), _CONTEXT)
    marks = written(
        contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_marker(length, block_rows), "key long, start long, end long"),
        "suffix-marks",
    )
    discard(some)
    release(spark)
    by_text = marks.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("marks"))
    spans = "spans array<struct<start: long, end: long>>"
    changed = texts.join(by_text, "key").select("key", "text", "marks").mapInArrow(_removed, f"key long, n_removed long, {spans}, kept string")
    changed = written(changed, "suffix-changed")
    release(spark)
    copy = (F.col("key") != F.col("first")) & (F.col("n_bytes") >= length)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    return facts.join(changed, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: Bytes as hexadecimal text, two characters each.
SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, p, hash(h[2 * p + 1:2 * p + 200]) AS s, md5(h[2 * p + 1:2 * p + 200]) AS m
  FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS p FROM d WHERE len(h) >= 200)
), r AS (
  SELECT doc_id, p FROM (
    SELECT doc_id, p, row_number() OVER (PARTITION BY s, m ORDER BY doc_id, p) AS k FROM w) WHERE k > 1
), g AS (
  SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM r
), n AS (
  SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g
), spans AS (
  SELECT doc_id, span, min(p) AS s, max(p) + 100 AS e FROM n GROUP BY doc_id, span
), kept AS (
  SELECT doc_id, string_agg(h[2 * lo + 1:2 * hi], '' ORDER BY lo) AS k FROM (
    SELECT doc_id, e AS lo, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), len(h) // 2) AS hi, h
    FROM spans JOIN d USING (doc_id)
    UNION ALL
    SELECT doc_id, 0, min(s), any_value(h) FROM spans JOIN d USING (doc_id) GROUP BY doc_id)
  GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
