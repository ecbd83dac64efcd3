"""Language identification and language-model scoring."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.llm import langid
from ravelin.llm import suffix_tree_lm as lm
from tests.compare import SMALL

DOCS = "doc_id long, text string, lang string, score string, lang_pred string"


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    out = Counter()
    for w in words:
        out.update(w)
        padded = f" {w} "
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def unpacked(code):
    parts = [code >> 42 & 0x1FFFFF, code >> 21 & 0x1FFFFF, code & 0x1FFFFF]
    return "".join(map(chr, parts[next(i for i, p in enumerate(parts) if p) :]))


@pytest.mark.parametrize("text", ["Hello, wörld!", "a", "a1b", "  x  ", "ÄÖ ü-漢字 𝒳y", "", "123 ..."])
def test_grams(text):
    keys, counts = langid.counted(text)
    assert {unpacked(int(k)): int(c) for k, c in zip(keys, counts, strict=True)} == plain_grams(text)


def test_distance_by_hand():
    p = langid.Profiles([("xx", ord("a"), 0), ("xx", ord("b"), 1), ("yy", ord("b"), 0), ("yy", ord("a"), 1)], 2)
    assert p.predict("aab")[0] == "xx" and p.predict("bba")[0] == "yy" and p.predict("12")[0] == "und"


def test_pieces_of_a_long_text(monkeypatch):
    text = "some words in a row " * 30
    whole = langid.counted(text)
    monkeypatch.setattr(langid, "PIECE", 100)
    assert dict(zip(*langid.counted(text), strict=True)) == dict(zip(*whole, strict=True))


def test_any_cut_of_a_text_gives_the_same_counts():
    text = "Straße, naïve ΑΣ'Α 12 words--and ÄÖ\n\nx İstanbul e\u0301te " * 3
    whole = dict(zip(*langid.counted(text), strict=True))
    for piece in range(1, len(text) + 2):
        assert dict(zip(*langid.counted(text, piece), strict=True)) == whole


def plain_profiles(docs, size):
    by = {}
    for d in docs:
        if d["text"] is not None and d["lang"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 4 != 2:
            by.setdefault(d["lang"], Counter()).update(plain_grams(d["text"]))
    order = lambda c: sorted(c, key=lambda g: (-c[g], sum(ord(x) << 21 * k for k, x in enumerate(reversed(g)))))[:size]
    return order, {lang: {g: k for k, g in enumerate(order(c))} for lang, c in by.items()}


def test_predictions_are_those_of_the_definition(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    order, profiles = plain_profiles(docs, langid.PROFILE)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.op8_language_id(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        mine = order(plain_grams(d["text"] or ""))
        off = {lang: sum(abs(p[g] - k) if g in p else langid.PROFILE for k, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(off), key=off.__getitem__) if mine else "und"
        want = round(1 - off[best] / (langid.PROFILE * len(mine)), 9) if mine else 0.0
        assert got[d["doc_id"]] == (best, pytest.approx(want))


def test_language_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.op8_language_id(spark, "/root/testdata/sf0.01")
    rows = found.join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").filter("held_out").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in rows)
    assert right >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    train = [(k, t, lang, None, "zz") for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 8)]
    odd = [(100, None, "en", None, None), (101, "", None, None, None), (102, "123 !", "de", None, None), (None, "the dog", None, None, None), (103, "the dog " * 100_000, None, None, None)]
    df = spark.createDataFrame(train + odd, DOCS)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(df, langid.profiles_of(df)).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[None][0] == got[103][0] == "en"
    empty = spark.createDataFrame([], DOCS)
    assert langid.identify(empty, langid.profiles_of(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(df, langid.profiles_of(empty)).collect()} == {"und"}


def words(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def test_base_scores_and_held_out_gain(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    out = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d in docs if not out(d["doc_id"]) for w in words(d["text"]))
    n, v = sum(c.values()), len(c)
    rows = {r["doc_id"]: r for r in lm.op2_lm_scoring(spark, SMALL).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        r, t = rows[d["doc_id"]], words(d["text"])
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, out(d["doc_id"]))
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_distributions_sum_to_one(spark):
    rng = np.random.default_rng(3)
    texts, state = [], 0
    for _ in range(200):
        t = []
        for _ in range(40):
            state = (state * 3 + int(rng.integers(0, 2))) % 11
            t.append(f"s{state}")
        texts.append(" ".join(t))
    tree, _ = lm.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    v = len(tree.words.hashes)
    assert len(tree.one.contexts) and tree.v == v
    missing = 1 / (tree.n + tree.v + 1)
    symbols = np.arange(v)
    assert (10**tree.root).sum() == pytest.approx(1 - missing)
    for c in tree.one.contexts:
        p = 10 ** tree.shorter(np.full(v, c), symbols)
        assert p.sum() == pytest.approx(1, abs=2e-3)
    for c in tree.two.contexts:
        suffix = tree.shorter(np.full(v, c & lm._MASK), symbols)
        assert (10 ** lm._scored(tree.two, np.full(v, c), symbols, suffix)).sum() == pytest.approx(1, abs=2e-3)


def test_scoring_odd_rows(spark):
    rows = [(1, "a b a b a b"), (2, None), (3, ""), (None, "A\tB"), (4, "a b " * 50_000), (1, "a b a b a b")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    tree, counts = lm.learn(df)
    got = lm.score_texts(df, tree, counts).collect()
    assert len(got) == len(rows) and {r["n_tokens"] for r in got} == {7, 1, 3, 100_001}
    assert "lang_pred" in got[0].asDict()
    empty = df.limit(0)
    tree, counts = lm.learn(empty)
    rest = lm.score_texts(df, tree, counts).collect()
    assert len(rest) == len(rows) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == 0 for r in rest)
    assert lm.score_texts(empty, tree, counts).count() == 0


def plain_tree(texts, depth):
    """log10 P(symbol | context) of the suffix tree, straight from its definition."""
    n = [Counter() for _ in range(depth + 1)]
    for t in map(words, texts):
        for d in range(depth + 1):
            n[d].update(tuple(t[i - d : i + 1]) for i in range(d, len(t)))
    total, v = sum(n[0].values()), len(n[0])
    kept = {}

    def lp(gram):
        if len(gram) == 1:
            return math.log10((n[0][gram] + 1) / (total + v + 1))
        below = lp(gram[1:])
        if gram[:-1] not in kept:
            return below
        weight, own = kept[gram[:-1]]
        return own.get(gram, below + weight)

    for d in range(1, depth + 1):
        by = {}
        for g, c in n[d].items():
            if c >= lm.MIN_COUNT:
                by.setdefault(g[:-1], []).append((g, c))
        level = {}
        for ctx, grams in by.items():
            m = n[d - 1][ctx]
            weight = max(1 - sum(c - lm.DISCOUNT for _, c in grams) / m, 1e-9)
            p = {g: (c - lm.DISCOUNT) / m + weight * 10 ** lp(g[1:]) for g, c in grams}
            gain = sum(c * (math.log(p[g]) - lp(g[1:]) * math.log(10)) for g, c in grams) + (m - sum(c for _, c in grams)) * math.log(weight)
            if gain > 0.5 * math.log(m) * len(grams):
                level[ctx] = math.log10(weight), {g: math.log10(x) for g, x in p.items()}
        kept |= level
    return kept, lambda t: sum(lp(tuple(t[max(0, i - depth) : i + 1])) for i in range(len(t)))


@pytest.mark.parametrize(("often", "cache"), [(None, None), (12, None), (12, 20), (None, 0)])
def test_scores_are_those_of_the_definition(spark, monkeypatch, often, cache):
    monkeypatch.setattr(lm, "BATCH_BYTES", 2_000)
    if cache is not None:  # what tasks do not have at hand they ask for
        monkeypatch.setattr(lm, "CACHE", cache)
    if often:  # contexts seen so often are spread over ranges
        monkeypatch.setattr(lm, "hot_count", lambda _: often)
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(150):
        t = [f"w{int(x)}" for x in rng.integers(0, 6, 3)]
        for _ in range(int(rng.integers(0, 60))):
            t.append(t[-3] if rng.random() < 0.8 else f"w{int(rng.integers(0, 40))}")
        texts.append(" ".join(t))
    rows = [(k, t) for k, t in enumerate([*texts, "unseen words w1 w2", "", None])]
    kept, score = plain_tree(texts, lm.DEPTH)
    assert {len(c) for c in kept} == {1, 2, 3}
    tree, counts = lm.learn(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    rows.append((len(rows), " \t\x0b\n"))
    found = lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), tree, counts).collect()
    assert {r["doc_id"]: r["score"] for r in found} == {k: pytest.approx(score(words(t))) for k, t in rows}
    c = Counter(w for t in texts for w in words(t))
    for r in found:
        t = words(rows[r["doc_id"]][1])
        assert (r["n_tokens"], r["n_known"]) == (len(t), sum(c[w] > 0 for w in t))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (tree.n + tree.v + 1)) for w in t))


def test_contexts_stay_learned_in_a_larger_corpus(spark):
    rare = "quite seldom heard"
    texts = [(rare,)] * 5 + [("filler " * 1_000_000,)] * 14
    tree, counts = lm.learn(spark.createDataFrame(texts, "text string").repartition(8))
    row = lm.score_texts(spark.createDataFrame([(1, rare)], "doc_id long, text string"), tree, counts).first()
    assert row["score"] > row["base_score"] + 10


def test_parts_are_added_up_without_a_second_copy_of_all():
    import tracemalloc

    import numpy as np

    from ravelin.llm import suffix_tree_lm as lm

    rng = np.random.default_rng(5)
    make = lambda n: tuple(rng.integers(0, n, n).astype(k) for k in (np.uint64, np.int64, np.uint64, np.uint64))
    parts = [make(200_000) for _ in range(4)]
    parts = [(p[0], p[1], p[0] * np.uint64(3), p[0] * np.uint64(5)) for p in parts]
    want = lm._add(*map(np.concatenate, zip(*parts, strict=True)))
    held = [tuple(x.copy() for x in p) for p in parts]
    tracemalloc.start()
    found = lm._add_held(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held == [] and all((a == b).all() for a, b in zip(found, want, strict=True))
    assert peak < 4.5 * 800_000 * 8  # all columns again, with their order and sums, are six and more
    assert [len(x) for x in lm._add_held([tuple(x[:0] for x in parts[0])])] == [0, 0, 0, 0]
