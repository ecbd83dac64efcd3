"""Repeated byte strings against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from ravelin.llm import suffix_dedup as sd

DOCS = "doc_id long, text string, key string, spans string"


def expected(docs, length):
    first, out = {}, {}
    for doc_id, text in sorted(docs):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            if first.setdefault(data[p : p + length], (doc_id, p)) != (doc_id, p):
                gone[p : p + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone]) if data else b""
        out[doc_id] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    common = [text(rng.randint(60, 260), "abcdefgh é") for _ in range(6)]
    docs = []
    for k in range(70):
        parts = [text(rng.randint(0, 150), "abcdefgh ") if rng.random() < 0.6 else rng.choice(common) for _ in range(rng.randint(0, 7))]
        docs.append((k * 3, "".join(parts)))
    docs += [(500, "ab" * 300), (501, "a" * 450), (502, "xab" + "ab" * 90), (503, docs[5][1]), (504, docs[5][1]), (505, None), (506, ""), (507, "é" * 120)]
    return docs


@pytest.mark.parametrize(("seed", "hot", "block", "length"), [(1, 200_000, 100_000, 100), (2, 1, 100_000, 100), (3, 4, 50, 100), (4, 10, 200, 64)])
def test_against_brute_force(spark, seed, hot, block, length):
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(5)
    rows = sd.repeated_spans(df, length, hot, block).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows}
    assert got == expected(docs, length)


def test_sample_is_the_same_wherever_a_string_stands():
    rng = np.random.default_rng(1)
    string = rng.integers(97, 101, 100).astype(np.uint8)
    for _ in range(50):
        a, b = (rng.integers(97, 101, rng.integers(0, 300)).astype(np.uint8) for _ in range(2))
        here = sd.sample(np.concatenate((a, string, b)))[0] - len(a)
        alone = sd.sample(string)[0]
        assert set(alone) <= set(here)


def test_long_text_is_one_text(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    whole = sd.sample(data)
    monkeypatch.setattr(sd, "_SEGMENT", 1 << 10)
    parts = sd.sample(data)
    assert set(whole[0]) == set(parts[0])
    for place, _, first, last in (whole, parts):
        strings = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
        assert sorted(strings) == list(range(5000 - 99)) and (first <= place).all() and (place <= last + 68).all()


def test_repeated_and_missing_ids(spark):
    long = "the same words again and again, but never the same line twice over; " * 3
    rows = [(1, long), (1, long), (1, "short"), (None, long), (2, long + "tail"), (2, "x" + long)]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in sd.repeated_spans(spark.createDataFrame([(*r, "", "") for r in rows], DOCS)).collect()]
    assert len(got) == 6 and (1, 5, 0) in got
    assert [g for g in got if g[0] is None] == [(None, len(long), len(long) - 68)] or [g for g in got if g[0] is None][0][2] < len(long)
    assert all(n == gone for d, n, gone in got if d == 1 and n > 5)
    assert sd.repeated_spans(spark.createDataFrame([], DOCS)).count() == 0
