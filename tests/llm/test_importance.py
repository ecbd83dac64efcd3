"""Importance resampling: n-grams, weights and draws against the plain definition."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest

from ravelin.llm import importance as im
from tests.compare import SMALL, check


def words_of(text: str | None) -> list[bytes]:
    lower = (text or "").encode()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in lower)
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def grams(text: str | None, n: int) -> list[bytes]:
    w = words_of(text)
    return [b" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=2, buckets=10_000, least=20, percent=25, seed=7):
    bucket = lambda g: zlib.crc32(g) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for g in grams(text, n):
                counts[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        found = [gain[bucket(g)] for g in grams(text, n)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(words_of(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r, ranks.get(id(r))) for r in rows]


def text_of(rng: random.Random) -> str:
    words = ["Alpha", "beta", "Éa", "ÉA", "x1", "日本", "don't", "a_b", "the", "of"]
    return "".join(rng.choice(words) + rng.choice([" ", ", ", "\n\n", " - ", "  "]) for _ in range(rng.choice([0, 1, 5, 19, 20, 60])))


@pytest.mark.parametrize("n, buckets, percent", [(2, 10_000, 25), (1, 7, 50), (3, 100, 100), (2, 10_000, 0)])
def test_all_rows_against_brute_force(spark, n, buckets, percent):
    rng = random.Random(n)
    docs = [(k, text_of(rng)) for k in range(150)] + [(900, None), (901, ""), (902, " .,! "), (None, "null " * 30), (903, "w " * 30_000)]
    target = [text_of(rng) for _ in range(9)] + [None, ""]
    d = spark.createDataFrame([(*x, "a", 1) for x in docs], "doc_id long, text string, row string, n_words int").repartition(5)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = im.resample(d, t, n, buckets, percent=percent)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, target, n, buckets, percent=percent), key=key)
    kept = im.drawn_documents(d, got)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in got.collect() if r[5] is not None and r[0] is not None}


def test_spans_of_a_scan():
    pattern = im.scanner(3)
    for text in (b"", b"one", b"one two", b"a a a a", b"x yy zzz wwww v"):
        assert sorted(im.crcs(text, pattern)) == sorted(map(zlib.crc32, grams(text.decode(), 3)))
    long = b"A,b;  " * 1_000_000
    assert im.collapsed(long) == im.collapsed(long[:600])[:4] + b"a b " * 999_998 + b"a b"
    assert im.bucket_counts(im.collapsed(long), im.scanner(2), 100).sum() == 2 * 2_000_000 - 1


def test_ties_copies_and_empty_tables(spark):
    schema = "doc_id long, text string"
    same = spark.createDataFrame([(5, "w " * 20)] * 8 + [(6, "w " * 20)] * 4, schema)
    rows = im.resample(same, spark.createDataFrame([], "text string"), percent=50).collect()
    assert len(rows) == 12 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3, 4, 5, 6]
    first = max(rows, key=lambda r: r["score"])["doc_id"]
    assert {r["doc_id"] for r in rows if r["rank"] in (1, 2, 3, 4)} == {first}
    empty = im.resample(same.limit(0), same.select("text"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_draws_follow_the_weights(spark):
    """Documents in the target's words are drawn before those in others."""
    docs = spark.createDataFrame([(k, ("sun moon star " if k % 4 == 0 else "mud clay sand ") * 10) for k in range(400)], "doc_id long, text string")
    found = im.resample(docs, spark.createDataFrame([("star sun moon " * 50,)], "text string")).filter("rank IS NOT NULL").collect()
    assert len(found) == 100 and sum(r["doc_id"] % 4 == 0 for r in found) >= 90


def test_ranks_over_many_ranges(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS score")
    from pyspark.sql import functions as F

    got = {r["id"]: r["rank"] for r in im.ranked(rows, [F.desc("score"), F.col("id")]).collect()}
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert got == {i: k + 1 for k, i in enumerate(want)}


def test_importance_sql(spark):
    check(spark, im.op11_importance_resampling, im.SQL)


def test_whole_small_table_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    want = sorted((r[0], r[2], r[3], r[4], r[5]) for r in brute(docs, target))
    assert sorted(map(tuple, im.op11_importance_resampling(spark, SMALL).collect())) == want
