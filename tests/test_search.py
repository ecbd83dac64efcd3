"""Search over stored indexes: blocks of postings, inverted lists, BM25."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.operators import bm25, dense, ivf, keyword, postings, sparse
from ravelin.plans import queries, registry

MIDDLE, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def hits(df, key="id"):
    return sorted((r["qid"], r["rk"], r[key], r["score"]) for r in df.collect())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def texts_of(spark, n, seed=3):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(60)]
    rows = [(f"t{k:04d}", " ".join(rng.choices(words, [60 - w for w in range(60)], k=rng.choice([1, 3, 10, 80])) + ["everywhere"])) for k in range(n)]
    return spark.createDataFrame([*rows, ("empty", ""), ("none", None)], "id string, text string")


@pytest.mark.parametrize("first, range_texts", [(1, 8), (4, 8), (2, 10_000)])
def test_block_search_equals_a_full_search(spark, tmp_path, first, range_texts):
    docs = texts_of(spark, 400)
    index = postings.index_store(spark, str(tmp_path / "x"), buckets=16)
    postings.build(index, sparse.encoded(docs, "id"), range_texts)
    asked = spark.createDataFrame([(1, "word1 word7 everywhere"), (2, "word59"), (3, "unheard"), (4, ""), (5, "word3 word3 word4")], "qid long, text string")
    terms = sparse.postings(asked, "qid")
    for k in (3, 500):
        want = sparse.keyword_search(sparse.postings(docs, "id"), terms, "qid", "id", k)
        assert hits(postings.search(index, terms, k, first)) == hits(want)


def test_block_search_reads_and_scores_little(spark, tmp_path):
    index = queries.built_index(spark, MIDDLE, str(tmp_path / "x"))
    one = spark.createDataFrame([(7, "a quiet river runs past the mill")], "qid long, text string")
    terms = sparse.postings(one, "qid")
    search = postings.Search(index, terms, first=2)
    buckets = {r["ix"] % 64 for r in terms.collect()}
    read = {int(f.split("bucket=")[1].split("/")[0]) for f in search.index.inputFiles()}
    assert read == buckets & set(index.head().versions) and len(read) < 10
    scored = plan(search._scores(search.first_ranges()))
    joins = scored[: scored.rindex("FileScan")]
    assert "BroadcastHashJoin" in joins and "SortMergeJoin" not in joins
    below = scored[scored.index("BroadcastHashJoin") :]
    assert "Exchange hashpartitioning" not in below  # no posting is shuffled before it has met the terms


def test_blocks_are_skipped(spark, tmp_path):
    """Long texts, whose shares are small, cannot reach short ones that have the term."""
    rows = [(f"a{k}", "rare " + "x%d " % k) for k in range(40)] + [(f"b{k}", "rare " + " ".join(f"y{j}" for j in range(200))) for k in range(400)]
    docs = spark.createDataFrame(rows, "id string, text string")
    index = postings.index_store(spark, str(tmp_path / "x"))
    postings.build(index, sparse.encoded(docs, "id"), 16)
    search = postings.Search(index, spark.createDataFrame([(1, "rare", 1.0)], "qid long, t string, w double").select("qid", _ix("rare").alias("ix"), "w"), k=20, first=3)
    found = search.hits().collect()
    assert len(found) == 20 and all(r["id"].startswith("a") for r in found)
    bounds = search.bounds().collect()
    assert sum(r["most"] >= 0.3 for r in bounds) < len(bounds) / 4
    heavy = search.index.groupBy("ix").agg(F.max("n").alias("n")).agg(F.max("n")).first()[0]
    assert heavy < 60  # a term of every text is split over all ranges


def test_a_word_in_every_text_fills_no_task(spark):
    rows = [(k, f"everywhere {' '.join(f'w{(k * 7 + j) % 900}' for j in range(2))}") for k in range(3000)]
    index = sparse.postings(spark.createDataFrame(rows, "id long, text string"), "id").cache()
    asked = sparse.postings(spark.createDataFrame([(1, "everywhere w5 w9"), (2, "w700"), (3, "everywhere")], "qid long, text string"), "qid")
    assert [r["ix"] for r in sparse.heavy_terms(index, 0.1).collect()] == [spark.range(1).select(_ix("everywhere").alias("i")).first()["i"]]
    parts, _ = sparse.salted(index, asked, "id")
    sizes = lambda df, *by: sorted(r["count"] for r in df.repartition(8, *by).groupBy(F.spark_partition_id()).count().collect())
    plain, dealt = sizes(index, "ix"), sizes(parts, "ix", "salt")
    assert plain[-1] > 2 * plain[4] and dealt[-1] <= 2 * dealt[4] and sum(dealt) == sum(plain)
    for k in (4, 10_000):
        assert hits(sparse.keyword_search(index, asked, "qid", "id", k, most=0)) == hits(sparse.keyword_search(index, asked, "qid", "id", k))
    index.unpersist()


def _ix(term):
    from ravelin.functions.text import term_index

    return term_index(F.lit(term))


def test_inverted_lists_find_most_neighbours(spark, tmp_path):
    lists = queries.built_lists(spark, LARGE, str(tmp_path / "x"))
    vectors, asked = queries._vectors(spark, LARGE)
    assert lists.vectors.count() == vectors.count()  # every vector is in a list
    true = {(r["qid"], r["id"]) for r in dense.vector_search(vectors, asked).collect()}
    found = {(r["qid"], r["id"]) for r in lists.search(asked).collect()}
    assert len(true & found) >= 0.9 * len(true)
    assert hits(lists.search(asked, probes=lists.lists)) == hits(dense.vector_search(vectors, asked))
    one = asked.limit(1)
    few = lists.search(one, probes=3)
    read = {int(f.split("bucket=")[1].split("/")[0]) for f in few.inputFiles()}
    assert read == set(lists.probed(one, 3)) and len(read) == 3


def test_lists_of_clusters_copies_and_string_ids(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16)) * 5
    rows = [(f"v{k:03d}", (centres[k % 6] + rng.normal(size=16)).tolist()) for k in range(300)]
    rows += [(f"w{k:03d}", rows[0][1]) for k in range(150)] + [("null", None), ("zero", [0.0] * 16)]  # a third are copies
    vectors = spark.createDataFrame(rows, "id string, embedding array<float>")
    lists = ivf.InvertedLists(spark, str(tmp_path / "x"), 6)
    assert 1 <= lists.build(vectors, sample=200) <= 3
    assert lists.vectors.count() == len(rows) - 1
    asked = vectors.filter("id < 'v012'").withColumnRenamed("id", "qid")
    found = {(r["qid"], r["id"]) for r in lists.search(asked, 5).collect()}
    true = {(r["qid"], r["id"]) for r in dense.vector_search(vectors, asked, 5).collect()}
    assert len(true & found) >= 0.9 * len(true) and ("v000", "w000") in found
    again = ivf.InvertedLists(spark, str(tmp_path / "y"), 6)
    again.build(vectors.repartition(7), sample=200)
    assert np.allclose(again._centres()[0], lists._centres()[0])
    with pytest.raises(ValueError):
        lists.build(vectors.limit(0))


def test_ann_query(spark):
    true = {(r["qid"], r["doc_id"]) for r in registry.queries()["dense_topk"](spark, MIDDLE).collect()}
    found = {(r["qid"], r["doc_id"]) for r in registry.queries()["ann_topk"](spark, MIDDLE).collect()}
    assert len(true & found) >= 0.9 * len(true)


def test_a_task_keeps_k_rows_a_query():
    import pyarrow as pa

    best = dense.Best(pa.array(["q"]), np.ones((1, 2)) / 2**0.5, 3, None, True)
    for k in range(50):
        best.meet(pa.array([f"{k:03d}-{j}" for j in range(40)] + ["q"]), np.ones((41, 2)) / 2**0.5, np.arange(1))
        assert best.rows <= 6
    (batch,) = best.result()
    assert batch.column("id").to_pylist() == ["000-0", "000-1", "000-10"]  # ties by id


def plain_bm25(texts, asked, k1=1.2, b=0.75):
    lengths = {i: sum(c.values()) for i, c in texts.items()}
    mean, n = sum(lengths.values()) / len(texts), len(texts)
    df = Counter(t for c in texts.values() for t in c)
    out = {}
    for i, c in texts.items():
        score = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * lengths[i] / mean)) for t in asked if c[t])
        if any(c[t] for t in asked):
            out[i] = score
    return out


def test_bm25_against_the_formula_and_after_changes(spark, tmp_path):
    docs = texts_of(spark, 120)
    made = lambda d: d.select("id", sparse.encoded_text(F.col("text")).alias("e")).select("id", "e.sparse", "e.terms")
    all_ = made(docs)
    sums, once = bm25.TermSums(spark, str(tmp_path / "s")), bm25.TermSums(spark, str(tmp_path / "t"))
    older = made(docs.filter("id < 't0100'").withColumn("text", F.when(F.col("id") < "t0030", F.concat("text", F.lit(" stale stale"))).otherwise(F.col("text"))))
    sums.count(older, 4)
    assert not sums.change(all_, older, 3, 5) and sums.version() == 4
    changed = "id < 't0030' OR id >= 't0100'"
    assert sums.change(all_.filter(changed), older.filter(changed), 4, 5) and sums.version() == 5
    once.count(all_, 5)
    rows = lambda s: sorted(map(tuple, s.store.read().collect()))
    assert rows(sums) == rows(once)
    asked = spark.createDataFrame([(1, "word1 word7 everywhere word1"), (2, "unheard")], "qid long, text string")
    got = bm25.search(all_, sums.read(), sparse.postings(asked, "qid"), 1000).collect()
    counts = {r["id"]: Counter((r["text"] or "").split()) for r in docs.collect()}
    want = plain_bm25(counts, {"word1", "word7", "everywhere"})
    assert {r["id"]: r["score"] for r in got} == {i: pytest.approx(s, abs=2e-9) for i, s in want.items()} and {r["qid"] for r in got} == {1}


def test_sums_are_counted_anew_after_a_crash(spark, tmp_path):
    from ravelin import schemas
    from ravelin.operators import ingest
    from ravelin.operators.store import SnapshotStore

    chunks = SnapshotStore(spark, str(tmp_path / "c"), schemas.STORED_CHUNK, "metadata.source", 4)
    state, sums = SnapshotStore(spark, str(tmp_path / "d"), schemas.FILE_STATE), bm25.TermSums(spark, str(tmp_path / "s"))
    listing = lambda *texts: spark.createDataFrame([(f"{k}.md", t) for k, t in enumerate(texts)], "source string, content string")
    ingest.ingest(listing("one two", "three"), chunks, state, sums=sums)
    ingest.ingest(listing("one four", "three"), chunks, state)  # as if it ended before the sums
    assert sums.version() != chunks.version
    ingest.ingest(listing("one four", "five six", "seven"), chunks, state, sums=sums)
    assert sums.version() == chunks.version
    got = {r["ix"]: r["n"] for r in sums.read().collect()}
    assert got[bm25.TEXTS] == 3 and got[bm25.LENGTH] == chunks.read().agg(F.sum("terms")).first()[0]


def test_texts_are_scored_in_their_rows(spark, monkeypatch):
    docs = texts_of(spark, 400)
    asked = spark.createDataFrame([(1, "word1 word7 everywhere"), (2, "word59"), (3, "unheard"), (4, ""), (5, "word3 word3 word4")], "qid long, text string")
    terms = sparse.postings(asked, "qid")
    monkeypatch.setattr(keyword, "CELLS", 40)
    for rows in (docs, docs.unionByName(docs.limit(30))):  # rows of one key add up
        for k, block in ((3, 10_000), (500, 2)):
            want = sparse.keyword_search(sparse.postings(rows, "id"), terms, "qid", "id", k)
            assert hits(keyword.text_search(rows, terms, "qid", "id", k, block=block)) == hits(want)
    assert hits(keyword.text_search(docs, terms.filter("qid = 4"), "qid", "id")) == []
    assert hits(keyword.text_search(docs, terms, "qid", "id", most=2)) == hits(keyword.text_search(docs, terms, "qid", "id"))


def test_no_text_or_posting_of_a_search_is_shuffled(spark):
    for name in ("sparse_topk", "citations", "context_join"):
        found = plan(registry.queries()[name](spark, MIDDLE))
        assert "MapInArrow" in found or name != "sparse_topk"
        for part in found.split("Exchange hashpartitioning")[1:]:
            above_scan = part.split("FileScan")[0]
            assert "MapInArrow" in above_scan or "BroadcastHashJoin" in above_scan or "FileScan" not in part


def test_long_terms_are_numbered_as_sql_does(spark):
    import pyarrow as pa

    from ravelin.functions.text import term_index

    found = ["ab", "router", "z9" * 40, "x" * 64, "y" * 65, "a" * 1000, "", "caf"]
    want = spark.createDataFrame([(t,) for t in found], "t string").select(term_index(F.col("t")).alias("i")).collect()
    assert sparse.term_numbers(pa.array(["left out", *found]).slice(1), 500_000).tolist() == [r["i"] for r in want]
    assert sparse.term_numbers(pa.array([], pa.string()), 500_000).tolist() == []


def test_block_search_when_bounds_differ_between_runs(spark, tmp_path, monkeypatch):
    """Sums in another order make ranges of copies take turns; none may be scored twice or missed."""
    import random as noise

    docs = spark.createDataFrame([(k, "one two three") for k in range(300)], "id long, text string")
    index = postings.index_store(spark, str(tmp_path / "x"), "bigint")
    postings.build(index, sparse.encoded(docs, "id"), 10)
    monkeypatch.setattr(postings, "MAX_BLOCKS", 0)
    jitter = F.udf(lambda: noise.SystemRandom().random() * 1e-12, "double").asNondeterministic()
    exact = postings.Search.bounds
    monkeypatch.setattr(postings.Search, "bounds", lambda self: exact(self).withColumn("most", F.col("most") + jitter()))
    terms = sparse.postings(spark.createDataFrame([(1, "one three")], "qid long, text string"), "qid")
    for _ in range(3):
        assert [r["id"] for r in postings.search(index, terms, 200, 2).orderBy("rk").collect()] == list(range(200))


def test_vectors_are_made_without_a_shuffle(spark):
    docs = texts_of(spark, 100)
    assert "Exchange" not in plan(registry.queries()["sparse_vectors"](spark, MIDDLE))
    entries = lambda df: sorted(map(tuple, df.select("id", "ix", "w").collect()))
    for rows in (docs, docs.unionByName(docs.limit(30))):
        assert entries(sparse.vectors(rows, "id")) == entries(sparse.postings(rows, "id"))


def test_bm25_scores_texts_in_their_rows(spark):
    docs = texts_of(spark, 120).select("id", sparse.encoded_text(F.col("text")).alias("e")).select("id", "e.sparse", "e.terms")
    sums = bm25.sums_of(docs)
    asked = sparse.postings(spark.createDataFrame([(1, "word1 word7 everywhere word1"), (2, "unheard"), (3, "word9")], "qid long, text string"), "qid")
    found = bm25.search(docs, sums, asked, 7)
    assert "MapInArrow" in plan(found) and hits(found) == hits(bm25.search(docs, sums, asked, 7, most=0))


def test_texts_are_split_and_numbered_in_their_bytes_as_sql_does(spark, monkeypatch):
    from ravelin.config import STOPWORDS
    from ravelin.functions.text import token_text, tokens

    rng = random.Random(5)
    parts = [*"abzAZ019 .\n`", "the", "Through", "é", "K", "İ", "\U0001f600", " no ", "norm", "az c8 ", "```", *STOPWORDS]
    rows = ["", None, "a", "ab", "the", "y" * 5000, "`cat` dog", "﻿One", *map(chr, [*range(0xD800), *range(0xE000, 0x20000)])]
    rows += ["".join(rng.choices(parts, k=rng.choice([1, 3, 40]))) for _ in range(3000)]
    rows += [f"q{chr(c)}q" for c in range(0x250)]
    docs = spark.createDataFrame(list(enumerate(rows)), "id long, text string").repartition(4).cache()
    both = docs.select("id", tokens(F.col("text")).alias("t"), token_text(F.col("text")).alias("text")).orderBy("id").toArrow()
    found = both.column("t").combine_chunks()
    for block in (sparse.BLOCK, 9):
        monkeypatch.setattr(sparse, "BLOCK", block)
        for texts in (both.column("text").combine_chunks(), both.column("text").slice(7, 200).combine_chunks()):
            sizes, row, ix = sparse.numbered(texts)
            want = found if len(texts) == len(found) else found.slice(7, 200)
            assert sizes.tolist() == want.value_lengths().to_pylist() and row.tolist() == np.repeat(np.arange(len(sizes)), sizes).tolist()
            assert ix.tolist() == sparse.term_numbers(want.flatten()).tolist()
    docs.unpersist()


def test_a_search_makes_no_list_of_tokens(spark):
    for name in ("sparse_topk", "hybrid_topk", "sparse_vectors"):
        assert "split(" not in plan(registry.queries()[name](spark, MIDDLE))


def test_stored_vectors_are_scored_in_their_rows(spark, monkeypatch):
    docs = texts_of(spark, 300).select("id", sparse.encoded_text(F.col("text")).alias("e")).select("id", "e.sparse")
    docs = docs.unionByName(spark.createDataFrame([("no vector", None)], docs.schema)).cache()
    asked = spark.createDataFrame([(1, "word1 word7 everywhere"), (2, "word59"), (3, "unheard"), (4, ""), (5, "word3 word3 word4")], "qid long, text string")
    terms = sparse.postings(asked, "qid")
    monkeypatch.setattr(keyword, "CELLS", 40)
    for rows in (docs, docs.unionByName(docs.limit(30))):  # rows of one id add up
        want = hits(sparse.keyword_search(sparse.stored_postings(rows), terms, "qid", "id", 30))
        for options in ({}, {"block": 2}, {"most": 2}):
            assert hits(keyword.stored_search(rows, terms, k=30, **options)) == want
    assert "Generate explode" not in plan(keyword.stored_search(docs, terms))
    docs.unpersist()


def test_hybrid_search_of_a_store_shuffles_no_entry(spark):
    found = plan(registry.queries()["stored_hybrid_topk"](spark, MIDDLE))
    assert found.count("MapInArrow") >= 2 and "Generate explode" not in found
