"""N-gram Jaccard join against all pairs."""

from __future__ import annotations

import random

import pytest

from ravelin.llm import jaccard
from tests.compare import check

DOCS = "doc_id long, text string, node string, comp string"


def sets_of(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(docs):
    sets = {d: sets_of(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed, n=160):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = [word() for _ in range(30)]
    docs = []
    for k in range(n):
        kind = rng.random()
        if kind < 0.55 and docs:
            words = rng.choice(docs).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                if rng.random() < 0.5:
                    words[rng.randrange(len(words))] = word()
                else:
                    cut = rng.randrange(len(words))
                    words = words[:cut] + words[cut + rng.randint(1, 8) :] or ["x"]
            docs.append(" ".join(words))
        else:
            own = [word() for _ in range(rng.choice([1, 3, 5, 8, 40, 90]))]
            docs.append(" ".join(own + passage if kind > 0.8 else own))
    return list(enumerate(docs, 1000))


@pytest.mark.parametrize(("seed", "salt_rows", "pairs_a_row"), [(1, 20_000, 4), (2, 3, 4), (3, 3, 0)])
def test_against_all_pairs(spark, monkeypatch, seed, salt_rows, pairs_a_row):
    monkeypatch.setattr(jaccard, "PAIRS_A_ROW", pairs_a_row)
    docs = corpus(seed)
    docs += [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a\tB"), (6, "Éa b"), (7, "éa b")]
    df = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, salt_rows=salt_rows).collect()}
    assert got == expected(docs)


def test_odd_tables(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    text = "one two three four five six"
    rows = [(1, text), (1, text), (None, text), (2, text), (3, "other words than these are here")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame([(*r, "", "") for r in rows], DOCS)).collect())
    assert got == [(0, 2, None), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 3)]


def test_sql(spark):
    check(spark, jaccard.op1_jaccard_join, jaccard.SQL)
