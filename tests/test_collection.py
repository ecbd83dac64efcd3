from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from ravelin.operators import collection, ingest


@pytest.fixture
def name(spark):
    name = f"c_{uuid.uuid4().hex}"
    collection.create(spark, name, 3, parts=8, buckets=4)
    yield name
    collection.drop(spark, name)


def chunks(spark, n, vector=(1.0, 2.0, 3.0)):
    files = spark.createDataFrame([(f"{k}.md", f"# T{k}\ntext {k}") for k in range(n)], "source string, content string")
    return ingest.stored(ingest.chunked(files), lambda _: F.array(*[F.lit(x) for x in vector]).cast("array<float>"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_creation_is_idempotent_and_keeps_its_vectors(spark, name):
    collection.create(spark, name, 3)
    assert collection.properties(spark, name)["vector.distance"] == "cosine" and collection.exists(spark, name)
    with pytest.raises(ValueError, match="3 numbers"):
        collection.create(spark, name, 4)
    with pytest.raises(ValueError, match="cosine"):
        collection.create(spark, name, 3, "taxicab")
    with pytest.raises(Exception, match="have 3 numbers"):
        collection.add(spark, name, chunks(spark, 2, (1.0,)))


def test_a_source_opens_few_files_and_a_delete_writes_few(spark, name, tmp_path):
    collection.add(spark, name, chunks(spark, 200))
    every = spark.table(name)
    assert every.count() == 200 and len(every.inputFiles()) == 8 * 4
    one = collection.of_source(spark, name, "7.md")
    assert [r["content"] for r in one.collect()] == ["T7\n\ntext 7"]
    shown = plan(one)
    assert "InMemoryFileIndex(1 paths)" in shown and "PartitionFilters: [isnotnull(part" in shown and "EqualTo(source,7.md)" in shown
    files = lambda: {f for f in spark.table(name).inputFiles()}
    before = files()
    collection.delete_sources(spark, name, spark.createDataFrame([("7.md",), ("none.md",)], "source string").limit(1), str(tmp_path / "a"))
    after = files()
    assert spark.table(name).count() == 199 and len({f.rsplit("/", 2)[1] for f in before ^ after}) == 1
    collection.delete_sources(spark, name, spark.table(name).select("source"), str(tmp_path / "b"))
    assert spark.table(name).count() == 0


def test_two_collections_join_without_an_exchange(spark, name):
    other = f"{name}_b"
    collection.create(spark, other, 3, parts=8, buckets=4)
    try:
        for x in (name, other):
            collection.add(spark, x, chunks(spark, 40))
        joined = spark.table(name).hint("merge").join(spark.table(other), "source").select("source")
        assert joined.count() == 40 and "Exchange" not in plan(joined).replace("BroadcastExchange", "")
    finally:
        collection.drop(spark, other)
