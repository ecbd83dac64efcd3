from __future__ import annotations

import pytest

from ravelin.plans import oracles, registry
from tests.compare import SMALL, check

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_its_sql(spark, name):
    check(spark, registry.queries()[name], oracles.SQL[name])


def test_sub_split_covers_every_document(spark):
    made = registry.queries()["sub_split"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(trim(text)) > 0").count()
    assert made.select("source").distinct().count() == docs


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "hybrid_topk" in entry.queries()


def test_chunks_of_all_sections_against_brute_force(spark):
    from collections import Counter

    from ravelin.config import DEFAULT
    from tests.splitter import split_text

    q = registry.queries()
    want = []
    for r in q["sections"](spark, MIDDLE).collect():
        text, size = r["content"], DEFAULT.max_chunk
        parts = [text] if len(text) <= size else split_text(text, size, DEFAULT.overlap, DEFAULT.separators)
        want += [(r["source"], r["heading_path"], r["section_ord"], k, f"{r['heading_path']}\n\n{x}") for k, x in enumerate(parts)]
    assert any(w[3] > 0 for w in want)
    assert sorted(map(tuple, q["all_section_chunks"](spark, MIDDLE).collect())) == sorted(want)
    assert q["all_chunk_count"](spark, MIDDLE).first()["chunks"] == len(want)
    batches = {(s, k // 10): min(10, n - k) for s, n in Counter(w[0] for w in want).items() for k in range(0, n, 10)}
    assert {(r["source"], r["batch_no"]): r["n"] for r in q["all_embed_batches"](spark, MIDDLE).collect()} == batches


def test_metrics_count_chunks_of_changed_files(spark):
    q = registry.queries()
    changed = {r["source"] for r in q["diff_todo"](spark, SMALL).collect()}
    made = [r["source"] for r in q["sub_split"](spark, SMALL).collect()]
    row, old = (q[name](spark, SMALL).first().asDict() for name in ("changed_chunk_metrics", "ingest_metrics"))
    assert row["chunks"] == sum(source in changed for source in made) and row["processed"] == len(changed)
    assert {k: v for k, v in row.items() if k != "chunks"} == {k: v for k, v in old.items() if k != "chunks"}
