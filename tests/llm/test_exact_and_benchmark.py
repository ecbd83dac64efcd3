"""Exact dedup and benchmark decontamination."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm import decontaminate as dc
from ravelin.llm import exact_dedup as ed
from tests.compare import check

DOCS = "doc_id long, text string, n_words string, kept string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40).map(lambda k: k * 0x0123456789ABCDEF & (2**64 - 1)), max_size=60), min_size=1, max_size=4))
def test_filters_merge_without_loss(parts):
    filters = [ed.CountingQuotientFilter.of(np.array(p, np.uint64), 6) for p in parts]
    merged = ed.CountingQuotientFilter.merged([ed.CountingQuotientFilter.from_bytes(f.to_bytes()) for f in filters])
    want = Counter(x for p in parts for x in p)
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist(), strict=True)) == want
    assert merged.fingerprints().tolist() == sorted(want)


def test_exact_dedup_sql(spark):
    check(spark, ed.op3_exact_dedup, ed.SQL)


def test_exact_dedup_odd_rows(spark):
    rows = [(1, "a"), (5, "a"), (3, "a "), (None, "a"), (7, None), (8, ""), (9, "long" * 50_000), (2, "long" * 50_000), (4, "r"), (4, "r")]
    got = ed.exact_duplicates(spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS)).collect()
    kept = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got}
    assert kept == {
        (1, 5, 3, False), (5, 5, 3, True), (None, 5, 3, False), (3, 3, 1, True), (7, 8, 2, False), (8, 8, 2, True),
        (9, 9, 2, True), (2, 9, 2, False), (4, 4, 2, True),
    }
    assert len(got) == len(rows)
    assert ed.exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def brute(words, items, window=10):
    hit, which = set(), set()
    for name, item in items:
        size = window if len(item) >= window else len(item)
        for j in range(len(item) - size + 1) if item else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == item[j : j + size]:
                    hit.update(range(i, i + size))
                    which.add(name)
    return hit, which


def test_automaton_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        vocabulary = [b"a", b"b", b"c", b"d"][: rng.randint(1, 4)]
        items = [(str(k), [rng.choice(vocabulary) for _ in range(rng.randint(0, 14))]) for k in range(rng.randint(0, 6))]
        window = rng.choice([2, 3, 5, 10])
        automaton = dc.SuffixAutomaton(items, window)
        for _ in range(5):
            words = [rng.choice([*vocabulary, b"z"] if rng.random() < 0.3 else vocabulary) for _ in range(rng.randint(0, 60))]
            spans, found = automaton.match(words)
            hit, which = brute(words, items, window)
            assert {i for s, e in spans for i in range(s, e)} == hit
            assert {items[k][0] for k in found} == which


def test_decontamination_sql(spark):
    check(spark, dc.op4_decontamination, dc.SQL)


def test_parts_and_odd_rows(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 12, 40])))) for k in range(25)] + [(None, "Null Id Item"), (98, None), (99, " .,- ")]
    texts = [" ".join(rng.choice(words) for _ in range(40)) + " | " + (items[k % 25][1]).upper() for k in range(40)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(100, None), (101, ""), (102, "... !"), (103, "null; id: item"), (0, texts[0])]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(*x, "a", "b") for x in docs], DOCS)
    rows = lambda **k: sorted((r["doc_id"], r["n_words"], tuple(map(tuple, r["spans"])), tuple(r["item_ids"])) for r in dc.contamination(d, b, **k).collect())
    one = rows()
    assert one == rows(max_words=60)
    parsed = [(str(i) if i is not None else "", dc.words_of((t or "").encode())) for i, t in items]
    for doc_id, n, spans, ids in one:
        text = dict(docs)[doc_id] or ""
        hit, which = brute(dc.words_of(text.encode()), parsed)
        assert {i for s, e in spans for i in range(s, e)} == hit and set(ids) == which and n == len(dc.words_of(text.encode()))
    assert dc.contamination(d, b.limit(0)).filter("size(spans) > 0").count() == 0
    assert dc.contamination(d.limit(0), b).count() == 0


def test_cutting(spark):
    item = " ".join(f"q{k}" for k in range(12))
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = "Nothing to see here, café."
    docs = [(1, clean), (2, f"before it. {item.upper()}! After it, " + "more " * 20), (3, item), (4, None)]
    got = {r["doc_id"]: r["text"] for r in dc.decontaminated(spark.createDataFrame([(*d, None, None) for d in docs], DOCS), b).collect()}
    assert set(got) == {1, 2, 4} and got[1] == clean and got[4] is None
    assert got[2] == "before it. After it, " + "more " * 20
