"""Benchmark decontamination by a generalised suffix automaton.

The benchmark's items, lower-cased and cut into words, go into one suffix automaton
over word numbers.  Documents stream through it: each word moves the automaton to
the state of the longest suffix that some item contains, and its length.  A length
of ``WINDOW`` or more marks that many words; so does a whole item that is shorter.
Runs of words in which some neighbours never stand next to each other in any item
can't reach that length, so numpy skips them before the automaton sees them.

The automaton is built from at most ``MAX_WORDS`` words and broadcast.  A larger
benchmark is split over several automata, applied one after another to the same
rows; that needs no shuffle either.  Long items are cut into pieces that overlap, so that
every window is whole in one of them.

Null and wordless texts have no hits.  Items without words are ignored.  Items with
equal text are all reported.  Ids of items sort as text; a null item_id is the empty
text.  Rows that repeat are judged alike; columns that have the name of an added one
are replaced.  An empty benchmark hits nothing, empty documents give an empty result; very
long texts are streamed whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import id_text, sliced, table, text_bytes, without

WINDOW = 10
#: Words of benchmark text that one automaton takes (some 200 bytes each).
MAX_WORDS = 500_000
#: A document whose hit words are more than this share of it is dropped whole.
MAX_COVERAGE = 0.5

#: Word characters are digits, a-z and all beyond ASCII; A-Z counts as a-z.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items behind each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.items = [i for i, _ in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []  # state, item, words: one for every place of an item
        pairs: set[tuple[int, int]] = set()
        shortest = window
        for k, (_, words) in enumerate(items):
            codes = [self.ids.setdefault(w, len(self.ids)) for w in words]
            pairs.update(zip(codes, codes[1:], strict=False))
            if codes:
                shortest = min(shortest, len(codes))
            last = 0
            for n, c in enumerate(codes, 1):
                last = self._extend(last, c)
                ends.append((last, k, n))
        self.shortest = shortest
        self._mark(ends, [len(w) for _, w in items])
        self.n_ids = max(1, len(self.ids))
        self.pairs = np.unique(np.array([a * self.n_ids + b for a, b in pairs], np.int64))

    def _copy(self, state: int, length: int) -> int:
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        found = self.next[last].get(c)
        if found is not None:
            if self.length[found] == self.length[last] + 1:
                return found
            split = self._copy(found, self.length[last] + 1)
            self.link[found] = split
            self._redirect(last, c, found, split)
            return split
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        new, p = len(self.next) - 1, last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                split = self._copy(q, self.length[p] + 1)
                self.link[q] = self.link[new] = split
                self._redirect(p, c, q, split)
        return new

    def _redirect(self, p: int, c: int, old: int, new: int) -> None:
        while p >= 0 and self.next[p].get(c) == old:
            self.next[p][c] = new
            p = self.link[p]

    def _mark(self, ends: list[tuple[int, int, int]], sizes: list[int]) -> None:
        """For each state: the items whose window ends here, and the short items it contains.

        Every place of an item is a prefix, whose suffix links lead to all strings that
        end there; the one state among them that holds the suffix of ``window`` words
        gets the item.
        """
        self.windows: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for state, item, n in ends:
            if sizes[item] < self.window:
                if n == sizes[item]:
                    short.setdefault(state, []).append((n, item))
            elif n >= self.window:
                while self.length[self.link[state]] >= self.window:
                    state = self.link[state]
                self.windows.setdefault(state, set()).add(item)
        self.shorts: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = tuple(short.get(state, ()))
            self.shorts[state] = own + self.shorts[self.link[state]]

    def scan(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words (start, end) that windows cover, and the items they're from."""
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        state = n = 0
        for i, c in enumerate(codes):
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            state = self.next[state].get(c, 0)
            n = n + 1 if state else 0
            hit = 0
            if n >= self.window:
                hit, at = n, state
                while self.length[self.link[at]] >= self.window:
                    at = self.link[at]
                items |= self.windows.get(at, set())
            for size, item in self.shorts[state]:
                if size <= n:
                    hit = max(hit, size)
                    items.add(item)
            if hit:
                start = i + 1 - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, items

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """As ``scan``, after skipping runs of neighbours that no item has."""
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        if self.shortest == 1:
            good = codes >= 0
            lo, hi = _runs(good, 1)
        else:
            if not len(self.pairs) or len(codes) < 2:
                return [], set()
            pair = codes[:-1] * self.n_ids + codes[1:]
            pair[(codes[:-1] < 0) | (codes[1:] < 0)] = -1
            where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            lo, hi = _runs(self.pairs[where] == pair, self.shortest - 1)
            hi = hi + 1
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            found, which = self.scan(codes[a:b].tolist())
            spans += [(a + s, a + e) for s, e in found]
            items |= which
        return spans, items


def _runs(good: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true values, ``least`` long at least."""
    edge = np.diff(np.concatenate(([0], good.view(np.int8), [0])))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = hi - lo >= least
    return lo[long], hi[long]


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ADDED = ("n_words", "spans", "item_ids")


def _pieces(benchmark: DataFrame, window: int, most: int) -> DataFrame:
    """(item, words, n): the items' words, an item of more than ``most`` words in pieces that share
    ``window - 1`` words with the next, so that each window is in one piece at least."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate("text", upper, lower), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    most = max(most, window)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(most))
    return (
        benchmark.select(id_text("item_id").alias("item"), words.alias("words"))
        .filter(F.size("words") > 0)
        .select("item", "words", F.explode(starts).alias("at"))
        .select("item", F.slice("words", F.col("at") + 1, F.lit(most + window - 1)).alias("words"))
        .select("item", F.array_join("words", " ").alias("words"), F.size("words").alias("n"))
    )


def _automata(benchmark: DataFrame, window: int, max_words: int) -> Iterator[tuple[bool, SuffixAutomaton]]:
    """One automaton after another, each of ``max_words`` words or so at most, and whether it is the last."""
    items = _pieces(benchmark, window, max(1, max_words // 8))
    total = items.agg(F.sum("n").alias("n")).first()["n"] or 0
    parts = 1 + 2 * total // max_words
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == k).select("item", "words").collect()
        yield k + 1 == parts, SuffixAutomaton([(r.item, r.words.encode().split()) for r in sorted(rows)], window)


#: Names of what one automaton hands on to the next, beside the rows' own columns.
_PASSED = ("__decon_words", "__decon_spans", "__decon_items")


def _streamed(docs: DataFrame, benchmark: DataFrame, window: int, max_words: int, schema: T.StructType, finish) -> DataFrame:
    """``docs`` after all automata, in one pass over the rows for each: ``finish`` makes the
    result's batch of a batch of rows, their counts of words, spans and items."""
    context = docs.sparkSession.sparkContext
    at, n = docs.columns.index("text"), len(docs.columns)
    kinds = (T.LongType(), _SPANS, T.ArrayType(T.StringType()))
    passed = T.StructType([*docs.schema, *(T.StructField(c, t) for c, t in zip(_PASSED, kinds, strict=True))])
    found = docs
    for last, automaton in _automata(benchmark, window, max_words):
        shared = context.broadcast(automaton)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            automaton: SuffixAutomaton = shared.value
            for batch in sliced(batches):
                before = list(zip(*(batch.column(n + k).to_pylist() for k in (1, 2)), strict=True)) if batch.num_columns > n else [((), ())] * batch.num_rows
                counts, spans, items = [], [], []
                for text, (old, ids) in zip(text_bytes(batch.column(at)), before, strict=True):
                    words = words_of(text)
                    new, which = automaton.match(words)
                    counts.append(len(words))
                    spans.append(_joined([*((x["start"], x["end"]) for x in old), *new]))
                    items.append(sorted({*ids, *(automaton.items[i] for i in which)}))
                rows = batch.select(range(n))
                yield finish(rows, counts, spans, items) if last else _with(rows, counts, spans, items, _PASSED)

        found = found.mapInArrow(scan, schema if last else passed)
    return found


def _with(rows: pa.RecordBatch, counts: list, spans: list, items: list, names: tuple[str, ...] = ADDED) -> pa.RecordBatch:
    as_structs = [[{"start": s, "end": e} for s, e in x] for x in spans]
    arrays = [*rows.columns, pa.array(counts, pa.int64()), pa.array(as_structs, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(arrays, [*rows.schema.names, *names])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with n_words, spans (of hit words, joined) and item_ids (sorted as text)."""
    docs = without(docs, ADDED)
    schema = T.StructType(
        [*docs.schema, T.StructField("n_words", T.LongType()), T.StructField("spans", _SPANS), T.StructField("item_ids", T.ArrayType(T.StringType()))]
    )
    return _streamed(docs, benchmark, window, max_words, schema, _with)


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given spans of words; what stands between words goes with them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : at[s][0]])
        last = at[e][0] if e < len(at) else len(text)
    return b"".join([*out, text[last:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` with all hit spans cut out of their texts; those covered beyond
    ``max_coverage``, or left without a word, are dropped.  Clean rows stay as they are.

    Columns stay those of ``docs``, whatever their names; n_chars follows the cut text.
    """
    at = docs.columns.index("text")
    sized = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cut(rows: pa.RecordBatch, counts: list, spans: list, _: list) -> pa.RecordBatch:
        if not any(spans):
            return rows
        texts = [cut_spans(t, s).decode("utf-8", "replace") if s else None for t, s in zip(text_bytes(rows.column(at)), spans, strict=True)]
        dirty = pa.array([bool(s) for s in spans])
        columns = list(rows.columns)
        for k, values in ((at, texts), (sized, [t if t is None else len(t) for t in texts])):
            if k is not None:
                kind = columns[k].type
                new = pa.array(values, pa.string()) if k == at else pa.array(values, pa.int64())
                columns[k] = pc.if_else(dirty, new.cast(kind), columns[k])
        kept = [not s or sum(e - b for b, e in s) <= max_coverage * n and sum(e - b for b, e in s) < n for n, s in zip(counts, spans, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=rows.schema).filter(pa.array(kept))

    return _streamed(docs, benchmark, window, max_words, docs.schema, cut)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_SQL_WORDS} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, len(v) AS n, array_to_string(v, ' ') AS v FROM (
    SELECT item, unnest(CASE WHEN len(w) < 10 THEN [w]
      ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS v
    FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, {_SQL_WORDS} AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS v FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes)
), hits AS (
  SELECT doc_id, i, p.n, item FROM places p JOIN windows USING (v)
), marked AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS at FROM (SELECT DISTINCT doc_id, i, n FROM hits))
  GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
