"""Sparse encoding and keyword search over an inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelin.config import DEFAULT, STOPWORDS
from ravelin.functions.text import term_index, token_text, tokens


#: Terms of queries that are broadcast at most (some 40 bytes each).
MAX_TERMS = 500_000
#: Parts that a heavy term's postings are dealt out in.
WAYS = 64
#: Characters of a term that are numbered together with other terms'.
LONG = 64


def terms(docs: DataFrame, key: str, text: str = "text", keep_code: bool = False) -> DataFrame:
    """(key, term, n, tf): how often a term occurs in a text and its share of the text's terms.

    Terms of a text are counted where its row is, so nothing but (key, term) is shuffled.
    """
    found = docs.select(key, tokens(F.col(text), keep_code).alias("__t"))
    return (
        found.select(key, F.size("__t").alias("total"), F.explode("__t").alias("term"))
        .groupBy(key, "term", "total")
        .agg(F.count("*").alias("n"))
        .select(key, "term", "n", (F.col("n") / F.col("total")).alias("tf"))
    )


def postings(docs: DataFrame, key: str, text: str = "text", vocabulary: int = DEFAULT.vocabulary) -> DataFrame:
    """(key, ix, w): the inverted index's entries; terms of a text that share a number add up."""
    return (
        terms(docs, key, text)
        .select(key, term_index(F.col("term"), vocabulary).alias("ix"), "tf")
        .groupBy(key, "ix")
        .agg(F.round(F.sum("tf"), 12).alias("w"))
    )


def postings_of(docs: DataFrame, asked: DataFrame, key: str, text: str = "text", vocabulary: int = DEFAULT.vocabulary) -> DataFrame:
    """As ``postings``, of those term numbers only that ``asked`` (ix) has.

    A first pass numbers the corpus's distinct terms and keeps those asked for; in a second one these
    go to the terms where they are, before any is counted or shuffled, up to ``MAX_TERMS`` of them.
    """
    found = docs.select(key, tokens(F.col(text)).alias("__t"))
    terms_ = found.select(F.explode("__t").alias("term")).distinct().select("term", term_index(F.col("term"), vocabulary).alias("ix"))
    wanted = terms_.join(asked.select("ix").distinct(), "ix", "left_semi")
    local = wanted.limit(MAX_TERMS + 1).toArrow()  # the first pass; it is done again only where there are more
    small = local.num_rows <= MAX_TERMS
    if small:
        wanted = docs.sparkSession.createDataFrame(local, wanted.schema)
    return (
        found.select(key, F.size("__t").alias("total"), F.explode("__t").alias("term"))
        .join(F.broadcast(wanted) if small else wanted, "term")
        .groupBy(key, "ix", "total")
        .agg(F.count("*").alias("n"))
        .select(key, "ix", F.round(F.col("n") / F.col("total"), 12).alias("w"))
    )


def stored_postings(chunks: DataFrame, key: str = "id") -> DataFrame:
    """(key, ix, w) of stored rows that hold a sparse vector: the index as it was written, nothing is tokenised again."""
    entry = F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("e")
    entries = chunks.select(key, entry).select(key, F.col("e.indices").alias("ix"), F.col("e.values").alias("tf"))
    return entries.groupBy(key, "ix").agg(F.round(F.sum("tf"), 12).alias("w"))


def term_number(term: str, vocabulary: int = DEFAULT.vocabulary) -> int:
    """``functions.text.term_index`` of one term."""
    return int(term_numbers(pa.array([term], pa.string()), vocabulary)[0])


def term_numbers(terms_: pa.StringArray, vocabulary: int = DEFAULT.vocabulary) -> np.ndarray:
    """``functions.text.term_index`` of each term, all terms a character at a time; the few longer than ``LONG`` one by one from there on."""
    offsets = np.frombuffer(terms_.buffers()[1], np.int32)[terms_.offset : terms_.offset + len(terms_) + 1] if len(terms_) else np.zeros(1, np.int32)
    data = np.frombuffer(terms_.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = offsets[:-1][order].astype(np.int64), sizes[order]
    h = np.full(len(order), 5381, np.uint32)
    for place in range(min(LONG, int(sizes[0]) if len(sizes) else 0)):
        n = np.searchsorted(-sizes, -place)  # the terms that have a character there
        h[:n] = h[:n] * np.uint32(33) + data[starts[:n] + place]
    for k in range(np.searchsorted(-sizes, -LONG)):
        value = int(h[k])
        for c in data[starts[k] + LONG : starts[k] + sizes[k]].tolist():
            value = (value * 33 + c) & 0xFFFFFFFF
        h[k] = value
    out = np.empty(len(order), np.int64)
    out[order] = np.abs(h.view(np.int32).astype(np.int64)) % vocabulary
    return out


#: For each byte the letter or digit that it is in lower case, else 0.
_FOLD = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _FOLD[[_c, ord(chr(_c).upper())]] = _c
#: Bytes whose terms are numbered together, unless one term is longer.
BLOCK = 1 << 20


def _as_number(term: str) -> int:
    return int.from_bytes(term.encode(), "little")


def _hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The 32-bit hash of each term chars[start:end], terms in order and apart.

    The multiplier has an inverse modulo 2**32, so that the hash of any part follows from sums over all characters before its
    start and before its end.
    """
    out = np.empty(len(starts), np.uint32)
    n = max(min(BLOCK, len(chars)), int((ends - starts).max(initial=0))) + 1
    up, down = (np.cumprod(np.r_[np.uint32(1), np.full(n - 1, x, np.uint32)], dtype=np.uint32) for x in (33, pow(33, -1, 1 << 32)))
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK, "right")))
        part = chars[starts[lo] : ends[hi - 1]]
        s, e = starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo]
        sums = np.zeros(len(part) + 1, np.uint32)
        np.cumsum(part * down[: len(part)], dtype=np.uint32, out=sums[1:])
        out[lo:hi] = up[e - 1] * (sums[e] - sums[s]) + up[e - s] * np.uint32(5381)
        lo = hi
    return out


def numbered(texts: pa.Array, vocabulary: int = DEFAULT.vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many tokens each text (as ``token_text`` has it) has, and of each token its text and its term's number.

    Tokens are those of ``functions.text.tokens``: runs of letters and digits in the texts' bytes, all texts at once.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    chars = np.zeros(len(data) + 8, np.uint8)
    np.take(_FOLD, data, out=chars[: len(data)])
    on = chars[: len(data)] != 0
    begins, closes = on.copy(), on.copy()
    begins[1:] &= ~on[:-1]
    closes[:-1] &= ~on[1:]
    whole = np.diff(bounds) > 0
    first, last = bounds[:-1][whole], bounds[1:][whole] - 1
    begins[first], closes[last] = on[first], on[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    more = ends - starts > 1
    starts, ends = starts[more], ends[more]
    ix = np.abs(_hashes(chars, starts, ends).view(np.int32).astype(np.int64)) % vocabulary
    # a stopword has one of few numbers; what has such a number is compared, as up to eight characters in one integer
    stop = np.sort(np.array([_as_number(w) for w in STOPWORDS], np.uint64))
    likely = np.zeros(vocabulary, bool)
    likely[term_numbers(pa.array(STOPWORDS, pa.string()), vocabulary)] = True
    at = np.flatnonzero(likely[ix] & (ends - starts <= 8))
    if len(at):
        eight = np.ndarray(len(data) + 1, "<u8", chars, strides=(1,))[starts[at]]
        size = (ends[at] - starts[at]).astype(np.uint64)
        eight &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * size)
        place = np.minimum(np.searchsorted(stop, eight), len(stop) - 1)
        kept = np.ones(len(ix), bool)
        kept[at[stop[place] == eight]] = False
        starts, ix = starts[kept], ix[kept]
    sizes = np.diff(np.searchsorted(starts, bounds))
    return sizes, np.repeat(np.arange(n), sizes), ix


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves go up, as in SQL."""
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def encode_texts(texts: pa.Array, vocabulary: int = DEFAULT.vocabulary) -> pa.StructArray:
    """(sparse, terms) of each text: term numbers, ascending, with their shares, and how many tokens there are.

    One sort of (row, number) gives all rows' runs.
    """
    n = len(texts)
    sizes, row, ix = numbered(texts, vocabulary)
    keys, counts = np.unique(row * vocabulary + ix, return_counts=True)
    row = keys // vocabulary
    ends = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
    indices = pa.ListArray.from_arrays(ends, pa.array((keys % vocabulary).astype(np.int32)))
    values = pa.ListArray.from_arrays(ends, pa.array(rounded(counts / sizes[row], 12)))
    sparse = pa.StructArray.from_arrays([indices, values], ["indices", "values"])
    return pa.StructArray.from_arrays([sparse, pa.array(sizes.astype(np.int32))], ["sparse", "terms"])


def encoded_text(text: F.Column, vocabulary: int = DEFAULT.vocabulary) -> F.Column:
    """(sparse, terms): a text's term numbers, ascending, with their shares of its terms, and how many terms it has.

    Terms that share a number add up.  Made in the row, without a shuffle.  Texts are split and numbered in Arrow batches, as Spark takes
    over a microsecond a token for its list of tokens, and some twenty for a number.
    """

    @F.arrow_udf("struct<sparse: struct<indices: array<int>, values: array<double>>, terms: int>")
    def encode(texts: pa.Array) -> pa.Array:
        return encode_texts(texts, vocabulary)

    return encode(token_text(text))


def encoded(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sparse) of every row, without a shuffle."""
    return docs.select(key, encoded_text(F.col(text))["sparse"].alias("sparse"))


def vectors(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """As ``postings``, made in the rows without a shuffle, unless rows' keys repeat, whose weights add up."""
    if repeats(docs, key):
        return postings(docs, key, text)
    entry = F.explode(F.arrays_zip("sparse.indices", "sparse.values")).alias("e")
    return encoded(docs, key, text).select(key, entry).select(key, F.col("e.indices").alias("ix"), F.col("e.values").alias("w"))


def top_k(scores: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The ``k`` best rows of each group, ranked from 1; ties by key.  Spark cuts to k before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return scores.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= k)


def small(rows: DataFrame, most: int = MAX_TERMS) -> DataFrame | None:
    """``rows`` as a local table, if there are ``most`` at most."""
    found = rows.limit(most + 1).toArrow()
    return rows.sparkSession.createDataFrame(found, rows.schema) if found.num_rows <= most else None


def repeats(docs: DataFrame, key: str) -> bool:
    """Whether several rows have one key; nothing but keys is read."""
    return not docs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def heavy_terms(index: DataFrame, share: float) -> DataFrame:
    """(ix) of the terms that have more than ``share`` of all postings: 1 / share of them at most."""
    counts = index.groupBy("ix").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") > share * index.count()).select("ix")


def salted(index: DataFrame, queries: DataFrame, key: str, ways: int = WAYS) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``salt`` to join on besides ix: postings of heavy terms are dealt out in ``ways`` parts by
    their texts, and the queries' rows of such terms go to all parts; light terms stay as they are."""
    heavy = F.broadcast(heavy_terms(index, 1 / (2 * ways)).withColumn("__heavy", F.lit(True)))
    part = F.when(F.col("__heavy"), F.pmod(F.xxhash64(key), F.lit(ways))).otherwise(F.lit(0))
    parts = F.explode(F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(ways - 1))).otherwise(F.array(F.lit(0))))
    return (
        index.join(heavy, "ix", "left").withColumn("salt", part.cast("int")).drop("__heavy"),
        queries.join(heavy, "ix", "left").withColumn("salt", parts).drop("__heavy"),
    )


def keyword_search(index: DataFrame, queries: DataFrame, qid: str, key: str, k: int = DEFAULT.prefetch, most: int = MAX_TERMS) -> DataFrame:
    """(qid, key, score, rk): the texts that share terms with a query, by dot product.

    ``index`` is the corpus's postings, ``queries`` the queries' own.  Scores are rounded to 9
    digits before they are ranked; what is added first keeps the rounding of exact halves
    from depending on the order of addition.  Up to ``most`` rows of queries go to the postings by broadcast; beyond, both
    sides are shuffled by term, and terms that many texts have by term and part.
    """
    q = queries.select(qid, "ix", F.col("w").alias("qw"))
    if q.limit(most + 1).count() <= most:
        met = index.join(F.broadcast(q), "ix")
    else:
        postings_, q = salted(index, q, key)
        met = postings_.join(q, ["ix", "salt"])
    scores = (
        met.groupBy(qid, key)
        .agg(F.round(F.sum(F.col("qw") * F.col("w")) + 1e-12, 9).alias("score"))
    )
    return top_k(scores, qid, key, k).select(qid, key, "score", "rk")
