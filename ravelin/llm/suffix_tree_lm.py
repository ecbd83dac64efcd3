"""Language-model scoring by a probabilistic suffix tree.

Symbols are words (A-Z lower-cased) and one end a text.  The tree's nodes are contexts
of up to ``DEPTH`` words.  A context is a candidate with each symbol that follows it ``MIN_COUNT`` times
or more, at any size of the corpus; it is retained if its next-symbol distribution diverges
from that of its longest proper suffix by more than its parameters cost: the gain in
log-likelihood must exceed half the logarithm of the context's count for each symbol.
A retained context's distribution is smoothed by absolute discounting, the discounted
mass going to its suffix's; at the root, add-one counts over all words.  A text is
scored from its longest suffix states, one for each symbol.

The tree grows with the corpus, so it is never gathered.  A word's key is its hash; that of a longer
n-gram is made of the keys of the n-gram without its last word (its context) and without its first
(the same symbol by the suffix).  A key's leading bits come from the context, so all that follows a
context is in one range of keys; contexts of ``hot_count`` occurrences or more (65,536 at most) are spread over
``SALTS`` ranges, and their sums added up over these.  All tables are packed: a row a range, with
its n-grams as arrays.  Texts are tokenized once, into batches of word numbers with a dictionary each.
Level by level, tasks add up their own n-grams, only those whose context is frequent, as far as a bit map of
fixed size tells (where it fills up, more n-grams are counted, none is lost); a range's task adds these up,
asks the ranges of the suffixes for their probabilities, and tests and smooths its contexts.

A text's score is a sum over its n-grams: each retained context that it holds adds the weight of its
suffix's distribution (the end is never within a context, so a symbol follows it), each n-gram stored there what it
adds to that.  Batches add up the most frequent n-grams themselves and send the others, each with its text,
to their ranges, which answer with sums a text; no text is shuffled.

Null and empty texts are one end symbol.  With no training texts all counts are 0.
Rows that repeat are scored alike; null ids count as empty text where held-out rows are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import discard, hand_back, id_text, release, sliced, table, written

#: Words of the longest contexts.
DEPTH = 3
#: No n-gram seen less often is kept.
MIN_COUNT = 2
DISCOUNT = 0.7
END = b"\n"  # no word holds white space
#: Bytes and texts of a batch at most (one text at least).
BATCH_BYTES, BATCH_TEXTS = 8_000_000, 50_000
#: Distinct n-grams that one merge task gets on average; n-grams that a task holds unsorted.
PER_RANGE, HELD = 2_000_000, 2_000_000
#: Ranges of a context that is seen very often.
SALTS = 64
#: Frequent n-grams and contexts, and frequent words, that every task has at hand, at most (16 bytes each).
CACHE = 1 << 20
#: Shares of the texts that ask one after another, so that the questions of one share at a time are on disk.
ASK_PASSES = 2
#: log2 of the bits of a map of n-grams, and of the number of ranges, at most.
MAP_BITS, RANGE_BITS = 27, 20
_BITS = np.int64(21)
_MASK = np.int64((1 << 21) - 1)
_LOW = np.uint64((1 << 40) - 1)
_LN10 = float(np.log(10.0))


def _packed(x: np.ndarray) -> bytes:
    """An array as bytes: first bytes of all its numbers, then second ones and so on, compressed."""
    if not len(x):
        return b""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type | np.dtype) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    columns = np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(columns.T).view(kind).ravel()


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def held_out() -> Column:
    return F.pmod(F.crc32(id_text("doc_id")), F.lit(7)) == 2


# -- texts as numbers ----------------------------------------------------------------


def encoded(docs: DataFrame, train: Column) -> DataFrame:
    """A table of batches of ``docs`` (with text): rows without text, whether each trains the
    model, and their symbols as places in the batch's dictionary of word hashes."""
    names = [c for c in docs.columns if c != "text"]
    rows = docs.select(*names, "text", train.alias("__train"))
    row = docs.select(*names).schema.add("__at", T.IntegerType())
    schema = T.StructType([T.StructField("rows", T.ArrayType(row)), T.StructField("symbols", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("train", "words", "codes", "sizes"))])

    def batch_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        n = len(whole)
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(whole.column("text").chunk(0), "")))
        every = split.flatten()
        real = pc.greater(pc.binary_length(every), 0)  # white space at either side of a text leaves empty strings
        of = np.repeat(np.arange(n), pc.list_value_length(split).to_numpy())[real.to_numpy(zero_copy_only=False)]
        words = every.filter(real).dictionary_encode()
        sizes = np.bincount(of, minlength=n) + 1
        codes = np.full(len(of) + n, len(words.dictionary), np.uint32)  # the end, where no word is
        codes[np.arange(len(of)) + of] = words.indices.to_numpy()
        del split, every, real
        hashes = np.fromiter(map(word_hash, [*words.dictionary.cast(pa.binary()).to_pylist(), END]), np.uint64, len(words.dictionary) + 1)
        order = np.argsort(-np.bincount(codes), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        columns = [whole.column(k).chunk(0) for k in range(len(names))] + [pa.array(range(n), pa.int32())]
        values = pa.StructArray.from_arrays(columns, [*names, "__at"])
        trains = np.array(whole.column("__train").to_pylist(), bool)
        binary = [pa.array([_packed(x)], pa.binary()) for x in (trains, hashes[order], rank[codes], sizes)]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, n], values), pa.array([len(codes)], pa.int64()), *binary], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, held = [], 0, 0
        for batch in sliced(batches):
            start = 0
            for k, size in enumerate(pc.fill_null(pc.binary_length(batch.column(len(names))), 0).to_pylist()):
                if n and (held + size > BATCH_BYTES or n >= BATCH_TEXTS):
                    if k > start:
                        parts.append(batch.slice(start, k - start))
                    yield batch_of(parts)
                    parts, n, held, start = [], 0, 0, k
                n += 1
                held += size
            if batch.num_rows > start:
                parts.append(batch.slice(start))
        if n:
            yield batch_of(parts)

    return written(rows.mapInArrow(run, schema).withColumn("batch", F.monotonically_increasing_id()), "lm-texts")


class _Batch:
    """Symbols of a batch's texts: the keys of words, each one's place in its text, the texts' starts."""

    def __init__(self, words: bytes, codes: bytes, sizes: bytes):
        self.words = _unpacked(words, np.uint64)
        self.codes = _unpacked(codes, np.uint32)
        self.sizes = _unpacked(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.places = np.arange(len(self.codes)) - np.repeat(self.starts, self.sizes)

    def grams(self, hot: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Level by level, for all symbols: whether an n-gram of that length ends there, its context, suffix and key."""
        suffix = self.words[self.codes]
        for level, often in enumerate(hot, 1):
            context = np.concatenate((suffix[:1], suffix[:-1]))
            keys = gram_key(context, suffix, often)
            yield self.places >= level, context, suffix, keys
            suffix = keys


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
    return x ^ (x >> np.uint64(29))


def gram_key(context: np.ndarray, suffix: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The key of an n-gram, from those of the n-grams without its last and without its first word.

    ``hot``: sorted keys of contexts whose n-grams are spread over several ranges.
    """
    pair = _mixed(context * np.uint64(0xD6E8FEB86659FD93) + (suffix ^ np.uint64(0xA0761D6478BD642F)))
    lead = context
    if len(hot):
        # most contexts' last bits are those of no hot one
        maybe = np.zeros(1 << 16, bool)
        maybe[hot & np.uint64(0xFFFF)] = True
        at = np.flatnonzero(maybe[context & np.uint64(0xFFFF)])
        at = at[_within(hot, context[at])[0]]
        lead = context.copy()
        lead[at] ^= (pair[at] % np.uint64(SALTS) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return (_mixed(lead) & ~_LOW) | (pair & _LOW)


def _range_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def _by_range(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The ranges that sorted keys are in, and where."""
    which = _range_of(keys, bits)
    cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(keys)]
    for lo, hi in zip(cuts, cuts[1:]) if len(keys) else ():  # noqa: B905
        yield int(which[lo]), slice(lo, hi)


def _spots(keys: np.ndarray, bits: int, map_bits: int) -> np.ndarray:
    """Places of keys in a map: by range, then by all their bits."""
    inner = np.uint64(map_bits - bits)
    return ((keys >> np.uint64(64 - bits)) << inner | (_mixed(keys) >> (np.uint64(64) - inner))).astype(np.int64)


class GramMap(NamedTuple):
    """A bit map of n-grams, of 2 ** MAP_BITS bits at most at any input size."""

    marks: np.ndarray
    bits: int
    map_bits: int

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for all keys that were put in, and for few others."""
        at = _spots(keys, self.bits, self.map_bits)
        return (self.marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _range_bits(n_tokens: int) -> int:
    return min(RANGE_BITS, max(4, (n_tokens // PER_RANGE).bit_length()))


def _map_bits(n_tokens: int, bits: int) -> int:
    return min(MAP_BITS, max(bits + 3, (4 * n_tokens).bit_length()))


def hot_count(n_tokens: int) -> int:
    """Occurrences from which a context is spread over several ranges; fewer than 2 ** 16 have so many."""
    return max(PER_RANGE // 16, n_tokens >> 16)


def _slice_of_map(keys: np.ndarray, bits: int, map_bits: int) -> bytes:
    """Of the map, what belongs to the range that all of the keys are in."""
    marks = np.zeros(1 << (map_bits - bits), bool)
    marks[_spots(keys, bits, map_bits) & ((1 << (map_bits - bits)) - 1)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _map_of(slices: DataFrame, bits: int, map_bits: int) -> GramMap:
    out = np.zeros(1 << (map_bits - 3), np.uint8)
    size = len(out) >> bits
    found = slices.select("range", "map").toArrow()
    for k, part in zip(found.column("range").to_pylist(), found.column("map").to_pylist(), strict=True):
        out[k * size : (k + 1) * size] = np.frombuffer(part, np.uint8)
    return GramMap(out, bits, map_bits)


def _within(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted key is among the sorted keys, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def _row(**columns) -> pa.RecordBatch:
    """One row of numbers and packed arrays."""
    arrays = [pa.array([v], pa.int64()) if isinstance(v, int) else pa.array([_packed(v)], pa.binary()) for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _joined(packed, kind: type | np.dtype) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(_unpacked(x, kind) for x in packed)])


def _frame(row: dict) -> pd.DataFrame:
    """As ``_row``, for pandas."""
    hand_back()
    return pd.DataFrame([{k: _packed(v) if isinstance(v, np.ndarray) else v for k, v in row.items()}])


# -- counting ------------------------------------------------------------------------


def _add(keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, their counts added up, and what else goes with a key."""
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    total = np.add.reduceat(counts[order], starts) if len(starts) else counts
    return (keys[starts], total, *(x[order[starts]] for x in more))


def _add_held(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """As ``_add``, of several parts; a column's parts go as soon as it is added up, so that no more than one is there twice."""
    columns = [list(c) for c in zip(*held, strict=True)]
    held.clear()

    def whole(column: list[np.ndarray]) -> np.ndarray:
        out = np.concatenate(column)
        column.clear()
        return out

    keys = whole(columns[0])
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    keys = keys[starts]
    counts = whole(columns[1])
    counts = np.add.reduceat(counts[order], starts) if len(starts) else counts
    first = order[starts]
    del order, starts
    return (keys, counts, *(whole(c)[first] for c in columns[2:]))


def _counter(of_batch, out):
    """A task that adds up what ``of_batch`` finds in batches' training texts, and now and then hands it to ``out``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n = 0
        for batch in sliced(batches, 1):
            train, *packed = (batch.column(c)[0].as_py() for c in ("train", "words", "codes", "sizes"))
            found = _Batch(*packed)
            held.append(of_batch(found, np.repeat(_unpacked(train, bool), found.sizes)))
            del found, packed, train
            n += len(held[-1][0])
            if n > HELD:
                held.append(_add_held(held))
                n = len(held[0][0])
                if n > HELD // 2:
                    yield from out(*held.pop())
                    n = 0
        if held:
            yield from out(*_add_held(held))

    return run


def _words_counted(bits: int):
    def of_batch(found: _Batch, train: np.ndarray) -> tuple[np.ndarray, ...]:
        counts = np.bincount(found.codes[train], minlength=len(found.words))
        return found.words[counts > 0], counts[counts > 0]

    def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, part in _by_range(keys, bits):
            yield _row(range=k, keys=keys[part], counts=counts[part])

    return _counter(of_batch, out)


def _merge_words(group: pd.DataFrame) -> pd.DataFrame:
    keys, counts = _add(_joined(group["keys"], np.uint64), _joined(group["counts"], np.int64))
    return _frame({"range": group["range"].iloc[0], "keys": keys, "counts": counts, "n": int(counts.sum()), "v": len(keys)})


_WORDS = "range long, keys binary, counts binary, n long, v long"
_PARTS = "range long, contexts binary, runs binary, suffixes binary, counts binary"
_GRAMS = _PARTS + ", totals binary, sums binary, often binary, map binary"


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values without repeats next to each other, and how often each stood there."""
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
    return values[starts], np.diff(np.append(starts, len(values))).astype(np.uint32)


def _grams_counted(frequent: Broadcast | None, hot: list[Broadcast], bits: int):
    """Counts of the n-grams whose contexts are frequent, packed by key range."""

    def of_batch(found: _Batch, train: np.ndarray) -> tuple[np.ndarray, ...]:
        for there, context, suffix, keys in found.grams([h.value for h in hot]):  # noqa: B007
            pass
        use = there & train
        if frequent is not None:
            use[use] = frequent.value.holds(context[use])
        return _add(keys[use], np.ones(int(use.sum()), np.int64), context[use], suffix[use])

    def out(keys: np.ndarray, counts: np.ndarray, context: np.ndarray, suffix: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, part in _by_range(keys, bits):
            contexts, runs = _runs(context[part])
            yield _row(range=k, contexts=contexts, runs=runs, suffixes=suffix[part], counts=counts[part])

    return _counter(of_batch, out)


_SUMS = np.dtype([("key", "u8"), ("total", "f8"), ("spent", "f8"), ("seen", "f8"), ("symbols", "f8")])


def _merger(hot: Broadcast, bits: int, map_bits: int, often: int):
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        context = np.concatenate([np.repeat(_unpacked(c, np.uint64), _unpacked(r, np.uint32)) for c, r in zip(group["contexts"], group["runs"], strict=True)])
        suffix = _joined(group["suffixes"], np.uint64)
        keys, counts, context, suffix = _add(gram_key(context, suffix, hot.value), _joined(group["counts"], np.int64), context, suffix)
        every, where = np.unique(context, return_inverse=True)
        totals = np.bincount(where, counts, len(every))
        order = np.flatnonzero(counts >= MIN_COUNT)
        order = order[np.argsort(where[order], kind="stable")]
        n, at = counts[order], where[order]
        contexts, runs = _runs(context[order])
        parts = np.flatnonzero(_within(hot.value, every)[0])  # what is here of hot contexts
        sums = np.zeros(len(parts), _SUMS)
        sums["key"], sums["total"] = every[parts], totals[parts]
        for name, x in (("spent", n - DISCOUNT), ("seen", n), ("symbols", np.ones(len(n)))):
            sums[name] = np.bincount(at, x, len(every))[parts]
        row = {"range": group["range"].iloc[0], "contexts": contexts, "runs": runs, "suffixes": suffix[order], "counts": n, "totals": totals[_runs(at)[0]], "sums": sums}
        return _frame(row | {"often": keys[order][n >= often], "map": _slice_of_map(keys[order], bits, map_bits)})

    return merge


# -- the tree -------------------------------------------------------------------------


class Level(NamedTuple):
    """Retained contexts of one length, with the log10 weight of their suffix's
    distribution, and the log10 probabilities of their symbols."""

    contexts: np.ndarray
    weights: np.ndarray
    keys: np.ndarray
    scores: np.ndarray


class Words(NamedTuple):
    """Sorted hashes of all words, and their counts; a word's place is its number."""

    hashes: np.ndarray
    counts: np.ndarray


def _scored(level: Level, context: np.ndarray, symbol: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """log10 probabilities given contexts, where the suffix's are ``suffix``."""
    kept, at = _within(level.contexts, context)
    stored, where = _within(level.keys, (context << _BITS) | symbol)
    out = suffix + np.where(kept, level.weights[at] if len(level.weights) else 0.0, 0.0)
    return np.where(kept & stored, level.scores[where] if len(level.scores) else 0.0, out)


class Tree:
    """A learned tree.

    ``counts`` has the words and their counts, ``levels`` a table for each length of context, ``hot`` the contexts
    that are spread over ranges, ``model`` what scoring asks for: of each range the retained contexts and
    their n-grams, ``known`` a map of all of these, ``cache`` the most frequent of them.  ``words``, ``root``, ``one`` and ``two``
    gather the first levels of a small tree, to look at.
    """

    def __init__(self, packed: DataFrame, n: int, v: int):
        self.packed, self.n, self.v = packed, n, v
        self.levels: list[DataFrame] = []
        self.hot: list[Broadcast] = []
        self.kept_hot: list[np.ndarray] = []
        self.bits = _range_bits(n)
        self.model: DataFrame | None = None
        self.known: Broadcast | None = None
        self.cache: Broadcast | None = None

    @property
    def scale(self) -> float:
        return float(np.log10(self.n + self.v + 1.0))

    @cached_property
    def counts(self) -> DataFrame:
        """(word, n): the keys of all words, and how often they occur."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(_unpacked(keys, np.int64)), pa.array(_unpacked(counts, np.int64))], ["word", "n"])

        return self.packed.select("keys", "counts").mapInArrow(unpack, "word long, n long")

    @cached_property
    def words(self) -> Words:
        found = self.counts.orderBy("word").toArrow()
        return Words(found.column("word").to_numpy(), found.column("n").to_numpy())

    @cached_property
    def root(self) -> np.ndarray:
        return np.log10(self.words.counts + 1.0) - self.scale

    def _numbered(self, level: int) -> tuple[Level, dict[int, int]]:
        """A level by numbers of words, and the numbers of its n-grams' keys."""
        up = dict(zip(self.words.hashes.view(np.uint64).tolist(), range(self.v), strict=True)) if level == 1 else self._numbered(level - 1)[1]
        number, kept, contexts = {}, [], {}
        for row in self.levels[level - 1].collect():
            context, suffix, keys, lp, _, weight, is_kept = _resolved(row, self.hot[level - 1].value, self.kept_hot[level - 1])
            for c, s, k, x, w, use in zip(*(y.tolist() for y in (context, suffix, keys, lp, weight, is_kept)), strict=True):
                number[k] = up[c] << int(_BITS) | up[s] & int(_MASK)
                if use:
                    kept.append((number[k], x))
                    contexts[up[c]] = w
        kept.sort()
        ordered = sorted(contexts.items())
        ints, floats = (lambda x, k: np.array([y[k] for y in x], np.int64)), (lambda x, k: np.array([y[k] for y in x], float))
        return Level(ints(ordered, 0), floats(ordered, 1), ints(kept, 0), floats(kept, 1)), number

    @cached_property
    def one(self) -> Level:
        return self._numbered(1)[0]

    @cached_property
    def two(self) -> Level:
        return self._numbered(2)[0]

    def shorter(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 P(symbol | one word)."""
        return _scored(self.one, context, symbol, self.root[symbol])


_LEVEL = "range long, contexts binary, runs binary, suffixes binary, lp binary, below binary, weights binary, kept binary, gains binary, counts binary, totals binary"
_KEPT_LATER = 2
_GAINS = np.dtype([("key", "u8"), ("gain", "f8")])


def _resolved(row, hot: np.ndarray, kept_hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """context, suffix, key, log10 probability in the context and by the suffix, weight, and whether
    the context is retained, of each n-gram in a row of a level."""
    contexts, runs, weights, flags = (_unpacked(row[c], t) for c, t in (("contexts", np.uint64), ("runs", np.uint32), ("weights", float), ("kept", np.uint8)))
    kept = np.where(flags == _KEPT_LATER, _within(kept_hot, contexts)[0], flags == 1)
    context, suffix = np.repeat(contexts, runs), _unpacked(row["suffixes"], np.uint64)
    lp, below = _unpacked(row["lp"], float), _unpacked(row["below"], float)
    return context, suffix, gram_key(context, suffix, hot), lp, below, np.repeat(weights, runs), np.repeat(kept, runs)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _shorter_words(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for row in _rows(batch):
                yield _row(range=row["range"], keys=_unpacked(row["keys"], np.uint64), lp=np.log10(_unpacked(row["counts"], np.int64) + 1.0) - scale)

    return run


def _shorter_level(hot: Broadcast, kept_hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for row in _rows(batch):
                _, _, keys, lp, below, _, kept = _resolved(row, hot.value, kept_hot)
                order = np.argsort(keys)
                yield _row(range=row["range"], keys=keys[order], lp=np.where(kept, lp, below)[order])

    return run


def _asks(bits: int):
    """The suffixes that a range has to ask others for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for row in _rows(batch):
                keys = np.unique(_unpacked(row["suffixes"], np.uint64))
                for k, part in _by_range(keys, bits):
                    yield _row(range=k, asker=row["range"], keys=keys[part])

    return run


def _tell(asked: pd.DataFrame, shorter: pd.DataFrame) -> pd.DataFrame:
    keys, lp = _joined(shorter["keys"], np.uint64), _joined(shorter["lp"], float)
    rows = [(a, r, _packed(lp[np.searchsorted(keys, _unpacked(k, np.uint64))])) for a, r, k in zip(asked["asker"], asked["range"], asked["keys"], strict=True)]
    return pd.DataFrame(rows, columns=["asker", "range", "lp"])


def _grader(hot_sums: np.ndarray):
    """Divergence tests and smoothing of the contexts of a range; those of hot contexts are finished when their gains are added up."""

    def grade(mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(mine["suffixes"].iloc[0]):
            return pd.DataFrame(columns=[c.split()[0] for c in _LEVEL.split(", ")])
        row = mine.iloc[0]
        contexts, runs, suffix = (_unpacked(row[c], t) for c, t in (("contexts", np.uint64), ("runs", np.uint32), ("suffixes", np.uint64)))
        n, total = _unpacked(row["counts"], np.int64), _unpacked(row["totals"], float)
        below = _joined(told.sort_values("range")["lp"], float)[np.unique(suffix, return_inverse=True)[1]]
        at = np.repeat(np.arange(len(contexts)), runs)
        hot, where = _within(hot_sums["key"], contexts)
        whole = lambda own, name: np.where(hot, hot_sums[name][where], own) if len(hot_sums) else own
        total = whole(total, "total")
        spent, seen, symbols = whole(np.bincount(at, n - DISCOUNT), "spent"), whole(np.bincount(at, n), "seen"), whole(runs.astype(float), "symbols")
        left = np.maximum(1.0 - spent / total, 1e-9)
        p = (n - DISCOUNT) / total[at] + left[at] * 10.0**below
        gain = np.bincount(at, n * (np.log(p) - below * _LN10))
        kept = np.where(hot, _KEPT_LATER, _worth(gain, total, seen, symbols)).astype(np.uint8)
        gains = np.zeros(int(hot.sum()), _GAINS)
        gains["key"], gains["gain"] = contexts[hot], gain[hot]
        return _frame({"range": row["range"], "contexts": contexts, "runs": runs, "suffixes": suffix, "lp": np.log10(p), "below": below, "weights": np.log10(left), "kept": kept, "gains": gains, "counts": n, "totals": total})

    return grade


def _worth(gain: np.ndarray, total: np.ndarray, seen: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Whether contexts gain more by distributions of their own than these cost."""
    left = np.maximum(1.0 - (seen - DISCOUNT * symbols) / total, 1e-9)
    return gain + (total - seen) * np.log(left) > 0.5 * np.log(total) * symbols


def _summed(rows: np.ndarray) -> np.ndarray:
    """Structured rows added up by key."""
    keys, where = np.unique(rows["key"], return_inverse=True)
    out = np.zeros(len(keys), rows.dtype)
    out["key"] = keys
    for name in rows.dtype.names[1:]:
        out[name] = np.bincount(where, rows[name], len(keys))
    return out


def _collected(table: DataFrame, column: str, kind: np.dtype) -> np.ndarray:
    """What a packed column has about hot contexts: ``SALTS`` rows for each of them at most."""
    return _joined((r[0] for r in table.select(column).filter(F.length(column) > 0).collect()), kind)


def _hot_words(often: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for row in _rows(batch):
                yield _row(often=_unpacked(row["keys"], np.uint64)[_unpacked(row["counts"], np.int64) >= often])

    return run


_MODEL = "range long, keys binary, adds binary, counts binary, map binary"


def _modelled(hot: Broadcast, kept_hot: np.ndarray, bits: int):
    """Of a level, what scoring asks for: n-grams with what they add to their suffix's probability,
    and retained contexts with their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for row in _rows(batch):
                context, _, keys, lp, below, weight, kept = _resolved(row, hot.value, kept_hot)
                n, total = _unpacked(row["counts"], np.int64), _unpacked(row["totals"], float).astype(np.int64)
                own = (lp - below - weight)[kept].astype(np.float32)
                yield _row(range=row["range"], keys=keys[kept], own=own, next=np.zeros_like(own), counts=n[kept])
                contexts, first = np.unique(context[kept], return_index=True)
                after = weight[kept][first].astype(np.float32)
                total = np.repeat(total, _unpacked(row["runs"], np.uint32))[kept][first]
                for k, part in _by_range(contexts, bits):
                    yield _row(range=k, keys=contexts[part], own=np.zeros_like(after[part]), next=after[part], counts=total[part])

    return run


def _merge_model(bits: int, map_bits: int):
    """A range of the model: its keys in order, each with what an occurrence adds to a text's score (as an n-gram, and as the
    context of the symbol after it), and how often it occurs; its part of the map."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        keys, where = np.unique(_joined(group["keys"], np.uint64), return_inverse=True)
        values = {}
        for name, kind in (("own", np.float32), ("next", np.float32), ("counts", np.int64)):
            values[name] = np.zeros(len(keys), kind)
            found = _joined(group[name], kind)
            used = found != 0  # a hot context comes from several ranges, with one weight
            values[name][where[used]] = found[used]
        row = {"range": group["range"].iloc[0], "keys": keys, "adds": values["own"] + values["next"], "counts": values["counts"]}
        return _frame(row | {"map": _slice_of_map(keys, bits, map_bits)})

    return merge


class Cache(NamedTuple):
    """The model's most frequent keys and the most frequent words, ``CACHE`` of each at most, which tasks have at hand."""

    keys: np.ndarray
    adds: np.ndarray
    words: np.ndarray
    counts: np.ndarray


def _most_frequent(packed: DataFrame, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of a packed table whose counts have so many binary digits that there are ``CACHE`` at most."""

    def digits(row: dict) -> np.ndarray:
        return np.frexp(_unpacked(row["counts"], np.int64).astype(float))[1]

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for row in _rows(batch):
                n = np.bincount(digits(row), minlength=65)
                yield pa.RecordBatch.from_arrays([pa.array(range(65), pa.int64()), pa.array(n, pa.int64())], ["digits", "n"])

    of = packed.select("counts").mapInArrow(lengths, "digits long, n long").groupBy("digits").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(65, np.int64)
    n[[r["digits"] for r in of]] = [r["n"] for r in of]
    least = int(np.flatnonzero(np.cumsum(n[::-1])[::-1] <= CACHE)[0])

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            for row in _rows(batch):
                use = digits(row) >= least
                yield _row(keys=_unpacked(row["keys"], np.uint64)[use], values=_unpacked(row[column], kind)[use])

    names = ["keys", *{column, "counts"}]
    rows = packed.select(*names).mapInArrow(frequent, "keys binary, values binary").collect()
    keys, values = _joined((r[0] for r in rows), np.uint64), _joined((r[1] for r in rows), kind)
    order = np.argsort(keys)
    return keys[order], values[order]


def _learn(texts: DataFrame, views: bool = True) -> Tree:
    """The tree; without ``views`` its levels' own tables go once the model is made."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast
    source = texts.select("train", "words", "codes", "sizes")
    bits = _range_bits(int(texts.agg(F.sum("symbols")).first()[0] or 0))
    counted = source.mapInArrow(_words_counted(bits), "range long, keys binary, counts binary")
    packed = written(counted.groupBy("range").applyInPandas(_merge_words, _WORDS), "lm-words")
    release(spark)
    totals = packed.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tree = Tree(packed, int(totals["n"] or 0), int(totals["v"] or 0))
    tree.bits = bits
    map_bits, often = _map_bits(tree.n, bits), hot_count(tree.n)
    shorter = packed.mapInArrow(_shorter_words(tree.scale), "range long, keys binary, lp binary")
    hot = _joined((r[0] for r in packed.mapInArrow(_hot_words(often), "often binary").filter(F.length("often") > 0).collect()), np.uint64)
    frequent, parts = None, []

    def modelled(level: int) -> None:
        its = tree.levels[level - 1]
        rows = its.mapInArrow(_modelled(tree.hot[level - 1], tree.kept_hot[level - 1], bits), "range long, keys binary, own binary, next binary, counts binary")
        parts.append(written(rows, f"lm-part-{level}"))
        if not views:
            discard(its)

    for level in range(1, DEPTH + 1):
        tree.hot.append(shared(np.sort(hot)))
        found = source.mapInArrow(_grams_counted(frequent, list(tree.hot), bits), _PARTS)
        grams = written(found.groupBy("range").applyInPandas(_merger(tree.hot[-1], bits, map_bits, often), _GRAMS), f"lm-grams-{level}")
        release(spark)
        asked = grams.select("range", "suffixes").mapInArrow(_asks(bits), "range long, asker long, keys binary")
        told = written(asked.groupBy("range").cogroup(shorter.groupBy("range")).applyInPandas(_tell, "asker long, range long, lp binary"), f"lm-told-{level}")
        if level > 1:
            modelled(level - 1)
        release(spark)
        sums = _summed(_collected(grams, "sums", _SUMS))
        mine = grams.select("range", "contexts", "runs", "suffixes", "counts", "totals")
        graded = mine.groupBy("range").cogroup(told.groupBy("asker")).applyInPandas(_grader(sums), _LEVEL)
        tree.levels.append(written(graded, f"lm-level-{level}"))
        gains = _summed(_collected(tree.levels[-1], "gains", _GAINS))
        its = sums[np.isin(sums["key"], gains["key"])]
        tree.kept_hot.append(gains["key"][_worth(gains["gain"], its["total"], its["seen"], its["symbols"])])
        if frequent is not None:
            frequent.destroy()  # its files, one an executor
        if level < DEPTH:
            frequent = shared(_map_of(grams.filter(F.length("map") > 0), bits, map_bits))
            hot = _collected(grams, "often", np.dtype(np.uint64))
            shorter = tree.levels[-1].mapInArrow(_shorter_level(tree.hot[-1], tree.kept_hot[-1]), "range long, keys binary, lp binary")
        discard(told)
        discard(grams)
        release(spark)
    modelled(DEPTH)
    model = reduce(DataFrame.unionByName, parts).groupBy("range").applyInPandas(_merge_model(bits, map_bits), _MODEL)
    tree.model = written(model, "lm-model")
    tree.known = shared(_map_of(tree.model, bits, map_bits))
    tree.cache = shared(Cache(*_most_frequent(tree.model, "adds", np.float32), *_most_frequent(tree.packed, "counts", np.int64)))
    for t in parts:
        discard(t)
    del model, counted, shorter, asked, graded, mine, found
    release(spark)
    return tree


def learn(train: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree of the training texts, and the table (word, n) of all word counts."""
    tree = _learn(encoded(train.select("text"), F.lit(True)))
    return tree, tree.counts


# -- scoring ----------------------------------------------------------------------------


#: What a text's known words and n-grams add up to: words known, logarithms of their counts, logarithms of weights.
_TEXT = np.dtype([("text", "u4"), ("known", "i8"), ("base", "f8"), ("score", "f8")])


def _questions(found: _Batch, known: GramMap, cache: Cache, hot: list[np.ndarray]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """What tasks can add up of a batch's texts themselves; the other words and n-grams that the tree may know, sorted by key, each with its text."""
    texts = np.repeat(np.arange(len(found.sizes), dtype=np.uint32), found.sizes)
    sums = np.zeros(len(found.sizes), _TEXT)
    sums["text"] = np.arange(len(sums))

    def at_hand(table: np.ndarray, values: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, at = _within(table, keys)
        out = np.zeros(len(keys), values.dtype)
        out[have] = values[at[have]]
        return have, out

    def add(name: str, which: np.ndarray, values: np.ndarray) -> None:
        sums[name] += np.bincount(which, values, len(sums)).astype(sums[name].dtype)

    def sorted_by_key(keys: list[np.ndarray], which: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, which = np.concatenate(keys), np.concatenate(which)
        order = np.argsort(keys, kind="stable")
        return keys[order], which[order]

    have, counts = at_hand(cache.words, cache.counts, found.words)
    add("known", texts, (counts > 0)[found.codes])
    add("base", texts, np.log10(counts + 1.0)[found.codes])
    rest = np.flatnonzero(~have[found.codes])
    words = sorted_by_key([found.words[found.codes[rest]]], [texts[rest]])
    # words as contexts, then n-grams level by level
    have, adds = at_hand(cache.keys, cache.adds, found.words)
    add("score", texts, adds[found.codes])
    rest = np.flatnonzero((known.holds(found.words) & ~have)[found.codes])
    keys, which = [found.words[found.codes[rest]]], [texts[rest]]
    for there, _, _, grams in found.grams(hot):
        at = np.flatnonzero(there)
        at = at[known.holds(grams[at])]
        at = at[np.argsort(grams[at])]
        have, adds = at_hand(cache.keys, cache.adds, grams[at])
        add("score", texts[at], adds)
        keys.append(grams[at[~have]])
        which.append(texts[at[~have]])
    return sums, [words, sorted_by_key(keys, which)]


_ASKED = "range long, batch long, words binary, word_texts binary, grams binary, gram_texts binary, sums binary"


def _asked(known: Broadcast, cache: Broadcast, hot: list[Broadcast], bits: int):
    """Words and n-grams of each batch with their texts, packed by key range, and what needs no answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, which = np.empty(0, np.uint64), np.empty(0, np.uint32)
        for batch in sliced(batches, 1):
            number, *packed = (batch.column(c)[0].as_py() for c in ("batch", "words", "codes", "sizes"))
            sums, asks = _questions(_Batch(*packed), known.value, cache.value, [h.value for h in hot])
            rows: dict[int, list[np.ndarray]] = {}
            for j, (every, texts) in enumerate(asks):
                for k, part in _by_range(every, bits):
                    rows.setdefault(k, [keys, which, keys, which])[2 * j : 2 * j + 2] = every[part], texts[part]
            for k, (w, wt, g, gt) in rows.items():
                yield _row(range=k, batch=number, words=w, word_texts=wt, grams=g, gram_texts=gt, sums=sums[:0])
            some = int(_range_of(_mixed(np.array([number], np.uint64)), bits)[0])
            yield _row(range=some, batch=number, words=keys, word_texts=which, grams=keys, gram_texts=which, sums=sums)

    return run


def _answer(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """For each batch what a range's words and n-grams add to its texts, summed by text."""
    rows = [known[known["adds"].notna()], known[known["adds"].isna()]]
    keys, numbers = _joined(rows[0]["keys"], np.uint64), _joined(rows[1]["keys"], np.uint64)
    adds, counts = _joined(rows[0]["adds"], np.float32), _joined(rows[1]["counts"], np.int64)
    out = []
    for number, batch, sums, *packed in zip(*(asked[c] for c in ("range", "batch", "sums", "words", "word_texts", "grams", "gram_texts")), strict=True):
        if sums:
            out.append((batch, -1, sums))
            continue
        words, word_texts, grams, gram_texts = (_unpacked(x, t) for x, t in zip(packed, (np.uint64, np.uint32) * 2, strict=True))
        have, at = _within(numbers, words)
        n, word_texts = counts[at[have]], word_texts[have]
        have, at = _within(keys, grams)
        more, gram_texts = adds[at[have]], gram_texts[have]
        texts, where = np.unique(np.concatenate((word_texts, gram_texts)), return_inverse=True)
        found = np.zeros(len(texts), _TEXT)
        found["text"] = texts
        of_words, of_grams = where[: len(n)], where[len(n) :]
        found["known"] = np.bincount(of_words, minlength=len(texts))
        found["base"] = np.bincount(of_words, np.log10(n + 1.0), len(texts))
        found["score"] = np.bincount(of_grams, more, len(texts))
        if len(found):
            out.append((batch, number, _packed(found)))
    hand_back()
    return pd.DataFrame(out, columns=["batch", "range", "sums"])


_ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def _score_encoded(texts: DataFrame, tree: Tree, only_use: bool = False) -> DataFrame:
    """The scores; with ``only_use`` the tree's tables go when all questions are answered."""
    spark = texts.sparkSession
    row = T.StructType(texts.schema["rows"].dataType.elementType.fields[:-1])
    names, scale = row.names, tree.scale
    known = tree.model.select("range", "keys", "adds").unionByName(tree.packed.select("range", "keys", "counts"), allowMissingColumns=True)
    answers = []
    for turn in range(ASK_PASSES):
        asking = texts.select("batch", "words", "codes", "sizes").filter(F.pmod(F.xxhash64("batch"), F.lit(ASK_PASSES)) == turn)
        asked = asking.mapInArrow(_asked(tree.known, tree.cache, list(tree.hot), tree.bits), _ASKED)
        told = asked.groupBy("range").cogroup(known.groupBy("range")).applyInPandas(_answer, "batch long, range long, sums binary")
        answers.append(written(told, "lm-answers"))
        release(spark)
    answers = reduce(DataFrame.unionByName, answers)
    if only_use:
        discard(tree.model)
        discard(tree.packed)
    packed = answers.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("range", "sums"))).alias("answers"))
    schema = T.StructType([*row.fields, T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            sizes = _unpacked(batch.column("sizes")[0].as_py(), np.int64)
            sums = np.zeros(len(sizes), _TEXT)
            for x in batch.column("answers")[0]:
                found = _unpacked(x["sums"].as_py(), _TEXT)
                for name in ("known", "base", "score"):
                    sums[name][found["text"]] += found[name]
            base = sums["base"] - scale * sizes
            rows = batch.column("rows")[0].values
            columns = [rows.field(j) for j in range(len(names))]
            whole = pa.RecordBatch.from_arrays([*columns, *map(pa.array, (sizes, sums["known"].copy(), base, base + sums["score"]))], schema.names)
            for i in range(0, whole.num_rows, 10_000):
                yield whole.slice(i, 10_000)

    scored = texts.select("batch", "rows", "sizes").join(packed, "batch").mapInArrow(run, schema)
    return scored.select(*names, "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), "base_score", "score")


def score_texts(docs: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """``docs`` (with text) without its text, with n_tokens, n_known, train_tokens, base_score, score."""
    kept = docs.select(*[c for c in docs.columns if c not in _ADDED])
    return _score_encoded(encoded(kept, F.lit(False)), tree)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out())
    texts = encoded(docs, ~F.col("held_out"))
    return _score_encoded(texts, _learn(texts, views=False), only_use=True)
