"""Alignment of two tokenizers against the plain definition."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ravelin.llm import token_align as ta
from tests.compare import SMALL

ODD = [
    None, "", " ", "a", "  two  spaces ", "tab\tand\nline\r\n", "<|endoftext|> <s> </s> <unk>", "▁ is not a space", "naïve café 日本語 текст", "🙂🙂 ok",
    "a" * 5000, "don't I'll we've", "x1 2y 33", "\x00\x01", "é", " 　", "1234567890" * 50, " lead",
]


def plain(texts, ids_of=None):
    """Per text (n_a, n_b, groups), by walking both sides' ends."""
    a, b = ta.sides(ta.A_FILE, ta.B_FILE)
    out = []
    for text in texts:
        groups = []
        if text:
            x = a.model.encode(" " + text, add_special_tokens=False).ids
            y = b.model.encode(text)
            whole = (" " + text).encode()
            if b"".join(a.bytes[i] for i in x) == whole == b"".join(b.bytes[i] for i in y):
                ends = []
                for ids, side in ((x, a), (y, b)):
                    at, mine = 0, []
                    for i in ids:
                        at += len(side.bytes[i])
                        mine.append(at)
                    ends.append(mine)
                last = 0
                for e in sorted(set(ends[0]) & set(ends[1])):
                    groups.append(tuple([i for i, z in zip(ids, mine, strict=True) if last < z <= e] for ids, mine in ((x, ends[0]), (y, ends[1]))))
                    last = e
        out.append(groups)
    return out


def brute(texts):
    all_groups = plain(texts)
    counts: Counter = Counter()
    for groups in all_groups:
        counts.update({(i, j) for x, y in groups for i in x for j in y})
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    rows = []
    for groups in all_groups:
        links = Counter((i, j) for x, y in groups for i in x for j in y)
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        rows.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(counts[p] * n for p, n in links.items()),
            hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return rows


@pytest.mark.parametrize("size, most", [(1 << 16, 1_000_000), (7, 50), (40, 0)])
def test_odd_texts_against_brute_force(spark, size, most, monkeypatch):
    rng = random.Random(size)
    words = ["windowfold", "Straße", "日本", "the", "I'm", "x_y", "3.14", "🙂", "naïve", "..."]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)] + ["the same text"] * 3
    docs = spark.createDataFrame([(k if k != 5 else None, t, "n", 1) for k, t in enumerate(texts)], "doc_id long, text string, row string, n_a int").repartition(3)
    got = ta.link_counts(docs, size=size, most=most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {5 if r[0] is None else r[0]: tuple(r)[1:] for r in got.collect()} == dict(enumerate(brute(texts)))


def test_a_whole_small_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {d["doc_id"]: r for d, r in zip(docs, brute([d["text"] for d in docs]), strict=True)}
    assert {r[0]: tuple(r)[1:] for r in ta.op12_token_alignment(spark, SMALL).collect()} == want


def test_long_groups_count_by_distinct_ids(monkeypatch):
    rng = np.random.default_rng(3)
    a_bytes, b_bytes = [b"xx"] * 5 + [b"x"] * 3, [b"xx"] * 4 + [b"x"] * 3
    a = [np.array([5, *rng.integers(0, 5, 200), 6], np.int32), np.array([0, 1], np.int32), np.zeros(0, np.int32)]
    b = [np.array([*rng.integers(0, 4, 201)], np.int32), np.array([2, 4, 5], np.int32), np.zeros(0, np.int32)]
    batch = ta.Aligned(a, b, a_bytes, b_bytes)
    assert batch.n_groups == 3 and batch.size[0].tolist() == [202, 1, 1] and batch.size[1].tolist() == [201, 1, 2]
    found = [x.tolist() for x in batch.linked(10)]
    monkeypatch.setattr(ta, "LISTED", 1 << 40)
    assert found == [x.tolist() for x in batch.linked(10)] and sum(found[2]) == 202 * 201 + 1 + 2
    spans = []
    for side, ids in ((a_bytes, a), (b_bytes, b)):
        at, mine = 0, []
        for i in np.concatenate(ids):
            mine.append((at, at + len(side[i])))
            at += len(side[i])
        spans.append(mine)
    want = [[i, j] for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
    assert batch.overlaps().tolist() == want


def test_alignments(spark):
    texts = ["naïve café 日本語 windowfold", None, "the cat", "▁"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    a, b = ta.sides(ta.A_FILE, ta.B_FILE)
    for r, groups in zip(sorted(ta.alignments(docs).collect()), plain(texts), strict=True):
        got = [([i for i, g in zip(r["a_ids"], r["a_groups"], strict=True) if g == k], [i for i, g in zip(r["b_ids"], r["b_groups"], strict=True) if g == k]) for k in range(len(groups))]
        assert got == groups and all(r["a_groups"][o["a"]] == r["b_groups"][o["b"]] for o in r["overlaps"])
        assert {o["a"] for o in r["overlaps"]} == set(range(len(r["a_ids"]))) and (bool(r["a_ids"]) == bool(groups))
    assert ta.link_counts(docs.limit(0)).count() == 0


def test_pieces_are_encoded_alike():
    rng = random.Random(8)
    a, b = ta.sides(ta.A_FILE, ta.B_FILE)
    words = ["word", "Zürich", "x1", "日本", "don't", "--", "\n", "  ", "42", "é"]
    for _ in range(50):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "", ". "]) for _ in range(80))
        assert "".join(ta.pieces_of(text, 5)) == text
        for one, many in zip(ta.encoded([text], a, b), ta.encoded([text], a, b, 5), strict=True):
            assert one[0].tolist() == many[0].tolist() and len(one[0])
    assert "".join(chr(c) for c in sorted(map(ord, ta.byte_of_character()))[:3]) == '!"#' and len(ta.byte_of_character()) == 256


def test_ranks_give_the_files_own_encoding():
    """Of odd characters, white space, contractions and long words, and of the tables' texts."""
    import pyarrow.parquet as pq

    a, _ = ta.sides(ta.A_FILE, ta.B_FILE)
    assert a.quick is not None
    rng = random.Random(5)
    some = "".join(chr(rng.randrange(1, 0xD800)) for _ in range(6000)) + "".join(chr(rng.randrange(0xE000, 0x11000)) for _ in range(2000))
    texts = [t for t in ODD if t] + [some, *("".join(rng.choices("ab '\n\t\x0b\x1c\x85\xa0\u3000.\u2028sé1日😀'tre", k=60)) for _ in range(400))]
    texts += [t for t in pq.read_table(f"{SMALL}/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    assert a.encode(texts, [True] * len(texts)) == [a.model.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_frequent_pairs(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1, 1, 1, 2, 3, 4, 9])], "pair long, n long")
    assert [ta.frequent_from(counts, m) for m in (0, 1, 2, 3, 4, 6, 7)] == [16, 8, 4, 4, 2, 2, 1]
