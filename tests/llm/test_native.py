"""Sharding and mixing."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ravelin.llm import mixing, sharding
from ravelin.llm.common import id_text
from tests.compare import check

DOCS = "doc_id long, text string, source string, slot string, size string"


def test_shares_and_moves():
    before = sharding.lookup_table(sharding.shard_names(10), 1009)
    shares = Counter(before)
    assert max(shares.values()) - min(shares.values()) <= 1
    after = sharding.lookup_table(sharding.shard_names(9), 1009)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 9)
    assert moved < 0.25 * 1009
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 1009)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def test_sharding_odd_rows(spark):
    rows = [(1, "x", "s", "mine", None), (1, "y", None, None, None), (None, None, None, "q", "r")]
    got = sharding.assign_shards(spark.createDataFrame(rows, DOCS), id_text("doc_id"), sharding.shard_names(4), 101)
    assert got.columns == ["doc_id", "text", "source", "size", "slot", "shard"]
    found = got.collect()
    assert len(found) == 3 and len({r["shard"] for r in found if r["doc_id"] == 1}) == 1
    assert sharding.assign_shards(spark.createDataFrame([], DOCS), id_text("doc_id"), ["a", "b"], 101).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan


def test_sharding_sql(spark):
    check(spark, sharding.op5_sharding, sharding.SQL)


def test_mixing_sql(spark):
    check(spark, mixing.op9_mixing, mixing.SQL)


def filled(sizes: dict, weights=(5, 2, 1), share=1.5, epochs=2) -> dict:
    """Targets by repeated resharing of what is above a cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    pool, target, open_ = share * sum(sizes.values()), {}, set(names)
    while True:
        rest = pool - sum(target.values())
        trial = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if trial[s] > epochs * sizes[s]]
        if not over:
            return target | trial
        for s in over:
            target[s] = epochs * sizes[s]
            open_.discard(s)


def test_mixing_meets_targets(spark):
    rows = [(k, "w " * (k % 50 + 1), f"s{min(k % 9, 5)}", "a", "b") for k in range(2000)]
    rows += [(5000, None, "s1", None, None), (5001, "", "s0", None, None), (5002, "lone", None, None, None), (None, "no id", None, None, None)]
    rows += [(6000, "twice over", "s2", None, None)] * 2
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"slot", "size", "copies", "taken"}
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert r["size"] == len((r["text"] or "").split()) and r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    want = filled(sizes)
    for s in sizes:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - targets[s]) <= 25
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(7)).collect()))
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    silent = mixing.mix(df.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0]
    assert silent == 0
