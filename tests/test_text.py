from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.config import CHUNK_NAMESPACE, DEFAULT
from ravelin.functions.text import chunk_id, term_index, title_of, tokens, trimmed
from ravelin.functions.vectors import cosine
from ravelin.operators import chunking, dense, fusion, sparse
from tests.splitter import split_text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_tokens_and_numbers(spark):
    words = ["windowfold", "keeps", "late", "events", "sorted"]
    long = ["x" * 12, "y" * 13, "z" * 40, "a", "0", "zz99zz99zz99"]
    assert one(spark, "windowFold keeps the late events sorted", tokens) == words

    def number(term):
        h = 5381
        for c in term:
            h = (h * 33 + ord(c)) & 0xFFFFFFFF
        return abs(h - 2**32 if h >= 2**31 else h) % 500_000

    assert {t: one(spark, t, term_index) for t in words + long} == {t: number(t) for t in words + long}
    assert one(spark, "`code` kept ```x\ny``` a étion 漢字", tokens) == ["kept", "tion"]
    assert one(spark, None, tokens) == []


def test_chunk_ids(spark):
    got = spark.range(1).select(chunk_id(F.lit("a"), F.lit("b")).alias("i")).first()["i"]
    assert got == "8b54c2f7-f1e9-5e2a-9b40-c473854fa930"
    for content in ("é", "", "x" * 5000):
        got = spark.range(1).select(chunk_id(F.lit("s"), F.lit(content)).alias("i")).first()["i"]
        assert got == str(uuid.uuid5(uuid.UUID(CHUNK_NAMESPACE), f"s::{content}"))


def test_titles_and_trimming(spark):
    df = spark.createDataFrame([("a/b.md", "x\n# T \ny"), ("a/b.md", "none"), ("c.txt", "#\n\nFoo")], "s string, c string")
    assert [r[0] for r in df.select(title_of(F.col("c"), F.col("s"))).collect()] == ["T ", "b", "Foo"]
    assert one(spark, "\t  x ﻿\n", trimmed) == "x"


def test_term_shares_add_up(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None)], "id int, text string")
    rows = sparse.terms(docs, "id").collect()
    assert sum(r["tf"] for r in rows) == pytest.approx(1.0)
    encoded = {r["id"]: r["sparse"] for r in sparse.encoded(docs, "id").collect()}
    assert len(encoded[1]["indices"]) == 2 and encoded[2]["indices"] == [] and encoded[3]["values"] == []


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, None, pytest.approx(1.0)]


@pytest.mark.parametrize("block", [10_000, 3])
def test_vector_search_by_blocks(spark, block):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8))
    v[7] = 0
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, embedding array<double>")
    asked = vectors.filter("id < 10").withColumnRenamed("id", "qid")
    got = {(r["qid"], r["rk"]): r["id"] for r in dense.vector_search(vectors, asked, 5, block=block).collect()}
    u = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) == 0, 1, np.linalg.norm(v, axis=1, keepdims=True))
    for q in range(10):
        s = np.round(u @ u[q], 9)
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [got[q, k + 1] for k in range(5)] == want


def test_fusion_order(spark):
    dense_hits = spark.createDataFrame([(1, 20, 2), (1, 21, 5), (1, 22, 1)], "qid long, doc_id long, rk int")
    sparse_hits = spark.createDataFrame([(1, 20, 4), (1, 21, 1)], "qid long, doc_id long, rk int")
    rows = {r["doc_id"]: r["rrf"] for r in fusion.fused(dense_hits, sparse_hits).collect()}
    assert rows == {20: round(1 / 62 + 1 / 64, 9), 21: round(1 / 65 + 1 / 61, 9), 22: round(1 / 61, 9)}
    best = fusion.best_fused(fusion.fused(dense_hits, sparse_hits)).orderBy("rk").collect()
    assert [r["doc_id"] for r in best] == [21, 20, 22]
    assert fusion.scoring_at_least(fusion.best_fused(fusion.fused(dense_hits, sparse_hits)), 0.02).count() == 2


def sectioned(spark, text):
    df = spark.createDataFrame([("s", "T", text)], "source string, title string, content string")
    return [(r["heading_path"], r["content"]) for r in chunking.sections(df).orderBy("section_ord").collect()]


def test_headings(spark):
    text = "intro\n# A\nx\n### C\ny\n## B\nz\n# D\n\n##x\n#### deep\n```\n# in code\n```\n#  \nlast"
    assert sectioned(spark, text) == [
        ("T", "intro"),
        ("A", "x"),
        ("A > C", "y"),
        ("A > B", "z"),
        ("D", "##x\n#### deep\n```"),
        ("in code", "```"),
        ("T", "last"),
    ]
    assert sectioned(spark, "# only\n## headings") == [] and sectioned(spark, "") == [] and sectioned(spark, None) == []
    assert sectioned(spark, "#\n# \nbody") == [("T", "#\n# \nbody")]


def test_splitting_bounds_and_coverage():
    rng = np.random.default_rng(1)
    for _ in range(30):
        words = ["w" * int(n) for n in rng.integers(1, 40, 600)]
        marks = rng.choice([" ", ". ", "\n", "\n\n"], 600)
        text = "".join(w + m for w, m in zip(words, marks, strict=True))
        pieces = split_text(text, 1500, 150, DEFAULT.separators)
        assert all(0 < len(p) <= 1500 for p in pieces)
        at = 0
        for p in pieces:
            found = text.find(p, max(0, at - 151))
            assert 0 <= found and not text[at:found].strip()
            at = max(at, found + len(p))
        assert not text[at:].strip()
    assert [len(p) for p in split_text("x" * 3100, 1500, 150, DEFAULT.separators)] == [1500, 1500, 100]


def test_chunks_are_led_by_their_path(spark):
    df = spark.createDataFrame([("s", "T", "# A\nshort\n# B\n" + "long words " * 300)], "source string, title string, content string")
    rows = chunking.chunks(chunking.sections(df)).orderBy("section_ord", "chunk_index").collect()
    assert rows[0]["content"] == "A\n\nshort" and all(r["content"].startswith("B\n\n") for r in rows[1:])
    assert [r["chunk_index"] for r in rows] == [0, *range(len(rows) - 1)]
