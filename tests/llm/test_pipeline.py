"""The pipeline's stages, each on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from ravelin.llm import decontaminate, langid
from tests.compare import SMALL
from tests.llm.test_jaccard import expected

NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]

    kept = stages["language_id"](spark, docs, SMALL)
    assert kept.columns == NAMES
    lost = docs.join(kept, "doc_id", "left_anti").collect()
    assert all(not any(c.isalpha() for c in r["text"] or "") for r in lost)

    unique = stages["near_duplicates"](spark, kept, SMALL).cache()
    groups = expected([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({root for _, root in groups.values()})

    clean = stages["decontamination"](spark, unique, SMALL).cache()
    assert clean.columns == NAMES
    found = decontaminate.contamination(clean.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    hits = {r["doc_id"]: r["text"] for r in found.filter("size(spans) > 0").collect()}
    before = {r["doc_id"]: r["text"] for r in unique.collect()}
    assert not hits
    marked = decontaminate.contamination(unique.select("doc_id", "text"), spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    dirty = {r["doc_id"] for r in marked.filter("size(spans) > 0").collect()}
    assert dirty and all(r["text"] == before[r["doc_id"]] for r in clean.collect() if r["doc_id"] not in dirty)

    mixed = stages["mixing"](spark, clean, SMALL)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == NAMES and set(copies.values()) <= {1, 2}

    placed = stages["sharding"](spark, mixed, SMALL)
    assert placed.count() == sum(copies.values()) and set(NAMES) < set(placed.columns)


def test_run_and_odd_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, SMALL).filter("shard IS NULL").count() == 0
    rows = [(None, "some words without an id", None, None, None), (1, None, None, "s", 0), (2, "123", "en", "s", 3), (3, "plain words of a text", "en", "s", 21), (3, "plain words of a text", "en", "s", 21)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, part in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, str(folder)).collect()
        assert len({(r["doc_id"], r["shard"]) for r in got}) <= 2 and bool(got) == bool(part)
        assert langid.UNKNOWN not in {r["lang"] for r in got}


def test_texts_in_no_learned_language_go(spark):
    learned = spark.read.parquet(f"{SMALL}/documents.parquet")
    junk = {9001: "xq zzk wvx qqj kzx vvw xqz jjq", 9002: "Το κείμενο αυτό είναι στα ελληνικά", 9003: "这 是 中文 文本", 9004: "?!", 9005: None}
    more = spark.createDataFrame([(k, t, None, "s", 1) for k, t in junk.items()], learned.schema)
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, learned.unionByName(more), SMALL).collect()}
    assert not set(junk) & set(kept) and set(kept.values()) <= {r["lang"] for r in learned.collect()}
    clean = {r["doc_id"] for r in learned.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert set(kept) == clean
