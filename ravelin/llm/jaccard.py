"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of five-word shingles.  All sets order their shingles alike, by
estimated document frequency and then by hash, so that rare ones come first.  A
document's prefix is its first ``n - ceil(t n) + l`` shingles.  Of two sets that overlap
in o, the one whose prefix ends first misses at most ``n - o`` of its prefix in the other, so
both prefixes share ``l + o - ceil(t n)`` shingles at least.  A document whose short
prefix holds frequent shingles costs many candidates; it gets a longer prefix (l up to
``MAX_MATCHES``) and its partners must share that much more of it.  Two documents
are compared only when they share as many prefix shingles as that, at places that
still allow the overlap they need.
The frequencies come from a count-min row of fixed size (``CELLS``) over all texts;
it steers the cost and never the result.

One row a document comes back, with the smallest id reachable by links.  Large groups
of copies are never expanded into pairs: star rounds compare each document with one
member of its most shared shingles and join what links, and pairs are formed only
between documents that are still in different groups.  Postings of frequent
shingles are salted, so that no task gets more than ``SALT_ROWS`` or so of one shingle.

Lower-casing touches A-Z only; words are runs of anything but ASCII white space.
Null, empty and wordless texts have no shingles and link with nothing.  Rows without
a doc_id are returned with a null component.  Rows that share a doc_id are one node.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import broadcast_if_small, discard, release, sliced, table, text_bytes, written
from ravelin.llm.components import components
from ravelin.llm.shingles import WordHashes, shingle_set

#: Similarity in hundredths, as 100 * shared >= PERCENT * union.
PERCENT = 75
MAX_MATCHES = 4
#: Cells of the frequency sketch, and the slices in which it is added up.
CELLS, SLICES = 1 << 20, 16
SALT_ROWS = 20_000
#: Pairs are formed once those that share a shingle number no more than so many times the postings.
PAIRS_A_ROW = 50
STAR_ROUNDS = 6
#: Star rounds go on while they link this share of what they compare.
STAR_YIELD = 0.25
_CELL_SHIFT = np.uint64(44)
_PLACE_BITS, _MATCH_BITS = 28, 4


# -- profiles and the frequency sketch ---------------------------------------------


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document (doc_id, n), and the task's cells of the sketch, packed by slice."""
    hashes = WordHashes()
    cells = np.zeros(CELLS, np.uint32)
    names = ["doc_id", "n", "slice", "cells"]
    for batch in sliced(batches):
        sets = [shingle_set(t, hashes) for t in text_bytes(batch.column(1))]
        if sets:
            cells += np.bincount((np.concatenate(sets) >> _CELL_SHIFT).astype(np.int64), minlength=CELLS).astype(np.uint32)
        sizes = pa.array([len(s) for s in sets], pa.int64())
        nothing = pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), sizes, *nothing], names)
    if cells.any():
        packed = [zlib.compress(c.tobytes(), 1) for c in np.split(cells, SLICES)]
        empty = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [empty, empty, pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names
        )


def _sum_cells(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CELLS // SLICES, np.uint64)
    for packed in group["cells"]:
        total += np.frombuffer(zlib.decompress(packed), np.uint32)
    return pd.DataFrame({"slice": [key[0]], "cells": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def _sketch(profiles: DataFrame) -> np.ndarray:
    """The whole sketch, of fixed size, on the driver."""
    rows = (
        profiles.filter("slice IS NOT NULL")
        .select("slice", "cells")
        .groupBy("slice")
        .applyInPandas(_sum_cells, "slice int, cells binary")
        .collect()
    )
    parts = {r["slice"]: np.frombuffer(r["cells"], np.uint32) for r in rows}
    blank = np.zeros(CELLS // SLICES, np.uint32)
    return np.concatenate([parts.get(k, blank) for k in range(SLICES)])


# -- prefixes -----------------------------------------------------------------------


def required(n: int, percent: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def prefix(codes: np.ndarray, sketch: np.ndarray, noise: int, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The set's prefix in the common order, its estimated frequencies, and how many of it must be shared.

    A posting costs 1; a candidate costs its comparison, and fewer of them are left
    the more matches are asked for.
    """
    n = len(codes)
    counts = sketch[(codes >> _CELL_SHIFT).astype(np.int64)]
    order = np.argsort(np.frexp(counts.astype(np.float64))[1].astype(np.uint8), kind="stable")  # codes are sorted
    most = min(MAX_MATCHES, required(n, percent))
    shortest = n - required(n, percent)
    others = np.cumsum(np.maximum(counts[order[: shortest + most]].astype(np.int64) - noise, 0))
    cost = [shortest + k + others[shortest + k - 1] / k**2 for k in range(1, most + 1)]
    matches = 1 + int(np.argmin(cost))
    taken = order[: shortest + matches]
    return codes[taken], counts[taken], matches


def _postings(sketch, percent: int, salt_rows: int):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        cells = sketch.value
        noise = 4 * int(np.median(cells)) + 4
        for batch in sliced(batches):
            tokens, nodes, metas, salts = [], [], [], []
            for node, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                codes = shingle_set(text, hashes)
                if not len(codes) or node is None:
                    continue
                taken, counts, matches = prefix(codes, cells, noise, percent)
                tokens.append(taken)
                nodes.append(np.full(len(taken), node, np.int64))
                metas.append(((np.int64(len(codes)) << _PLACE_BITS | np.arange(len(taken))) << _MATCH_BITS) | matches)
                shares = counts.astype(np.int64) // salt_rows + 1
                salt = 1 + np.int64(node * 0x9E3779B1 & 0x7FFFFFFF) % shares
                salts.append(np.where(shares > 1, salt, 0).astype(np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(np.concatenate(salts)),
                        pa.array(np.concatenate(nodes)),
                        pa.array(np.concatenate(metas)),
                    ],
                    ["token", "salt", "node", "meta"],
                )

    return post


def _members(percent: int):
    """Of postings sorted by token, salt and node, those with another node of fitting size
    in their run, with the run's first node (the hub) and its meta.

    The run that a batch ends in waits for the next batch; salting bounds it.
    Salted shingles always pass: their other runs are elsewhere.
    """

    def shared(rows: pa.Table) -> pa.RecordBatch | None:
        token, salt, node, meta = (rows.column(c).to_numpy() for c in ("token", "salt", "node", "meta"))
        new = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
        keep = np.append(False, ~new[1:]) | np.append(~new[1:], False) | (salt > 0)
        if not keep.any():
            return None
        run = np.cumsum(new) - 1
        size = meta >> (_PLACE_BITS + _MATCH_BITS)
        ordered = np.sort((run << 30) | size)
        least = np.searchsorted(ordered, (run << 30) | -(-percent * size // 100))
        most = np.searchsorted(ordered, (run << 30) | np.minimum(100 * size // percent, (1 << 30) - 1), "right")
        keep &= (most - least > 1) | (salt > 0)
        if not keep.any():
            return None
        first = np.flatnonzero(new)[run]
        kept = rows.filter(pa.array(keep))
        kept = kept.append_column("hub", pa.array(node[first][keep])).append_column("hub_meta", pa.array(meta[first][keep]))
        return kept.combine_chunks().to_batches()[0]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            token, salt = rows.column("token").to_numpy(), rows.column("salt").to_numpy()
            apart = np.flatnonzero((token != token[-1]) | (salt != salt[-1]))
            last = int(apart[-1]) + 1 if len(apart) else 0
            rest = rows.slice(last)
            if last and (found := shared(rows.slice(0, last).combine_chunks())) is not None:
                yield found
        if rest is not None and (found := shared(rest.combine_chunks())) is not None:
            yield found

    return select


# -- comparisons ---------------------------------------------------------------------


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in sliced(batches):
        sets = [shingle_set(t, hashes).tobytes() for t in text_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "codes"])


def _linked(percent: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    keep.append(False)
                    continue
                where = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[where] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return compare


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, that link.

    While the pairs' ids can be broadcast, only sets that take part are shuffled.  A node that
    many others are compared with is on one side of a join that Spark splits.
    """
    firsts = broadcast_if_small(written(pairs.select(F.col("a").alias("node")).distinct(), "jaccard-nodes"))
    left = sets.join(firsts, "node", "left_semi").select(F.col("node").alias("a"), F.col("codes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("codes").alias("y"))
    both = right.join(broadcast_if_small(pairs.select("a", "b")), "b").join(left, "a").select("a", "b", "x", "y")
    return both.mapInArrow(_linked(percent), "a long, b long")


def _size(meta: str) -> Column:
    return F.shiftright(meta, _PLACE_BITS + _MATCH_BITS)


def _place(meta: str) -> Column:
    return F.shiftright(meta, _MATCH_BITS).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))


def _matches(meta: str) -> Column:
    return F.col(meta).bitwiseAND(F.lit((1 << _MATCH_BITS) - 1))


def _possible(m1: str, m2: str, percent: int) -> Column:
    """Sizes and places still allow the overlap; the places are those of any shared shingle,
    whose earlier shared ones may number up to the lower place."""
    n1, n2, p1, p2 = _size(m1), _size(m2), _place(m1), _place(m2)
    bound = F.least(p1, p2) + F.least(n1 - p1, n2 - p2)
    return (
        (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent)
        & (bound * (100 + percent) >= (n1 + n2) * percent)
    )


def _needed(m1: str, m2: str, percent: int) -> Column:
    """Prefix shingles that two documents must share: see above."""
    n1, n2 = _size(m1), _size(m2)
    overlap = F.ceil((n1 + n2) * percent / (100 + percent) - 1e-9)
    spare = lambda n, m: _matches(m) - F.ceil(n * percent / 100 - 1e-9)
    return F.greatest(F.lit(1), overlap + F.least(spare(n1, m1), spare(n2, m2)))


def _first_ones(m1: str, m2: str, percent: int) -> tuple[Column, Column]:
    """How many shared shingles to count, a third of those needed, and whether a shared shingle
    may be among the first so many: these leave room for the overlap after them."""
    n1, n2 = _size(m1), _size(m2)
    overlap = F.ceil((n1 + n2) * percent / (100 + percent) - 1e-9)
    enough = F.ceil(_needed(m1, m2, percent) / 3)
    return enough, (_place(m1) <= n1 - overlap + enough - 1) & (_place(m2) <= n2 - overlap + enough - 1)


def _fetched(pairs: DataFrame, rows: DataFrame, sets: DataFrame | None) -> DataFrame:
    """The sets of all nodes in ``pairs``, those in ``sets`` already and the rest from their texts."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    if sets is not None:
        nodes = nodes.join(sets.select("node"), "node", "left_anti")
    nodes = written(nodes, "jaccard-nodes")
    if nodes.isEmpty() and sets is not None:
        return sets
    texts = rows.join(broadcast_if_small(nodes), F.col("doc_id") == F.col("node"), "left_semi")
    more = written(texts.mapInArrow(_sets, "node long, codes binary"), "jaccard-sets")
    release(rows.sparkSession)
    return more if sets is None else sets.unionByName(more)


def _grouped(nodes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``nodes`` with comp, the group so far of its node (itself at first)."""
    if groups is None:
        return nodes.withColumn("comp", F.col("node"))
    return nodes.join(broadcast_if_small(groups.select("node", F.col("comp").alias("__c"))), "node", "left").select(
        *nodes.columns, F.coalesce("__c", "node").alias("comp")
    )


def _joined(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """Groups after further links, given between nodes."""
    if groups is None:
        return components(links)
    at = groups.select("node", "comp")
    ends = (
        links.join(at.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left")
        .join(at.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        .filter("a <> b")
    )
    merged = components(ends).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    old = at.join(merged, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    new = merged.select(F.col("comp").alias("node"), F.col("root").alias("comp")).join(at.select("node"), "node", "left_anti")
    return written(old.unionByName(new), "jaccard-groups")


def _active(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of shingles that still meet more than one group."""
    rows = _grouped(members.select("token", "node", "meta"), groups)
    open_tokens = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("token")
    return written(rows.join(open_tokens, "token", "left_semi"), "jaccard-active")


def _pairs_left(active: DataFrame) -> tuple[int, int]:
    """Rows, and pairs of different groups that share a shingle, counted without forming them."""
    by_group = active.groupBy("token", "comp").agg(F.count("*").alias("m"))
    by_token = by_group.groupBy("token").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("own"))
    r = by_token.agg(F.sum("m").alias("rows"), F.sum((F.col("m") * F.col("m") - F.col("own")) / 2).alias("pairs")).first()
    return int(r["rows"] or 0), int(r["pairs"] or 0)


def _most_shared(candidates: DataFrame, percent: int) -> DataFrame:
    """Of (node, meta, hub, hub_meta), for each node the hub it shares most shingles with,
    if they are enough, as pairs."""
    return (
        candidates.filter(_possible("meta", "hub_meta", percent))
        .groupBy("node", "hub")
        .agg(F.count("*").alias("n"), F.min(_needed("meta", "hub_meta", percent)).alias("least"))
        .filter("n >= least")
        .groupBy("node")
        .agg(F.max(F.struct("n", F.negative("hub").alias("h"))).alias("best"))
        .select((-F.col("best.h")).alias("a"), F.col("node").alias("b"))
    )


def link_groups(docs: DataFrame, percent: int = PERCENT, salt_rows: int = SALT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, n_shingles) of every row of ``docs`` (doc_id, text), and (node, comp) of
    the nodes that were candidates (None if there are none)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profiles = written(rows.mapInArrow(_profile, "doc_id long, n long, slice int, cells binary"), "jaccard-profiles")
    sizes = profiles.filter("slice IS NULL").select("doc_id", F.col("n").alias("n_shingles"))
    sketch = spark.sparkContext.broadcast(_sketch(profiles))
    # -- candidates: postings of prefixes, of which those are kept that two nodes share
    postings = rows.mapInArrow(_postings(sketch, percent, salt_rows), "token long, salt int, node long, meta long")
    members = written(
        postings.repartition("token", "salt")
        .sortWithinPartitions("token", "salt", "node")
        .mapInArrow(_members(percent), "token long, salt int, node long, meta long, hub long, hub_meta long"),
        "jaccard-members",
    )
    release(spark)
    if members.isEmpty():
        return sizes, None
    # -- the first star round: each node against the hub of most of its shingles
    salted = members.filter("salt > 0")
    tops = salted.groupBy("token").agg(F.min(F.struct("hub", "hub_meta")).alias("top"))
    across = (
        salted.select("token", F.col("hub").alias("node"), F.col("hub_meta").alias("meta"))
        .distinct()
        .join(tops, "token")
        .select("node", "meta", "top.hub", "top.hub_meta")
    )
    stars = members.select("node", "meta", "hub", "hub_meta").unionByName(across).filter("node <> hub")
    pairs = written(_most_shared(stars, percent), "jaccard-pairs")
    sets = _fetched(pairs, rows, None)
    groups = _joined(None, written(_verified(pairs, sets, percent), "jaccard-links"))
    # -- more star rounds, with hubs drawn at random, while many pairs are left
    active = _active(members, groups)
    discard(members)
    release(spark)
    for k in range(STAR_ROUNDS):
        n_rows, n_pairs = _pairs_left(active)
        if n_pairs <= PAIRS_A_ROW * n_rows:
            break
        drawn = active.groupBy("token").agg(
            F.max(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "comp", "meta")).alias("hub")
        )
        met = (
            active.join(drawn.withColumnRenamed("hub", "drawn"), "token")
            .filter(F.col("comp") != F.col("drawn.comp"))
            .select("node", "meta", F.col("drawn.node").alias("hub"), F.col("drawn.meta").alias("hub_meta"))
        )
        pairs = written(_most_shared(met, percent), "jaccard-pairs")
        if pairs.isEmpty():
            break
        sets = _fetched(pairs, rows, sets)
        links = written(_verified(pairs, sets, percent), "jaccard-links")
        n_links = links.count()
        if n_links:
            groups = _joined(groups, links)
            old, active = active, _active(active, groups)
            discard(old)
            release(spark)
        if n_links < STAR_YIELD * pairs.count():
            break  # what is left are texts that share passages and do not link
    # -- what is left: all pairs of different groups that share enough of their prefixes
    x = active.select("token", F.col("node").alias("a"), F.col("meta").alias("ma"), F.col("comp").alias("ca"))
    y = active.select("token", F.col("node").alias("b"), F.col("meta").alias("mb"), F.col("comp").alias("cb"))
    enough, among = _first_ones("ma", "mb", percent)
    pairs = written(
        x.join(y, "token")
        .filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _possible("ma", "mb", percent) & among)
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.min(enough).alias("least"))
        .filter("n >= least")
        .select("a", "b"),
        "jaccard-pairs",
    )
    release(spark)
    if not pairs.isEmpty():
        links = written(_verified(pairs, _fetched(pairs, rows, sets), percent), "jaccard-links")
        if not links.isEmpty():
            groups = _joined(groups, links)
    release(spark)
    return sizes, groups


def near_duplicates(docs: DataFrame, percent: int = PERCENT, salt_rows: int = SALT_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    sizes, groups = link_groups(docs, percent, salt_rows)
    if groups is None:
        return sizes.withColumn("component_id", F.col("doc_id"))
    return sizes.join(groups, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id")
    )


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(v, ' ')) AS v FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [w]
      ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS v
    FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y USING (v)
    WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * m >= 75 * (p.n + q.n - m)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) USING (doc_id)
"""
