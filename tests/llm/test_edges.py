"""Every operator's query, and the pipeline, on odd tables: nulls in any column, empty and very long texts, ties,
repeated texts, columns with clashing names, and tables without rows."""

from __future__ import annotations

import pytest

import corpus_pipeline
from ravelin.llm import queries
from tests.compare import rows_of, rows_of_sql

QUERIES, SQL = queries.queries(), queries.oracle_sql()
EXTRA = (
    "size, target, taken, score, rank, weight, row, buckets, counts, component_id, n_shingles, kept, keep_id, group_size, spans, n_words, item_ids, copies, "
    "lang_pred, held_out, shard, key, pairs, times, digest, host, path, rule, verdict, listed, payload_digest, refers_to, n_removed, label, id, hash, __row"
).split(", ")
LONG = " ".join(f"word{k % 977} part{k % 31}" for k in range(15_000))
TEXTS = [
    None, "", " \t\n", "one", "?! ...", "same text of seven words in all", "same text of seven words in all", "Same TEXT of seven words in all", LONG, LONG + " end",
    "x" * 50_000, "Ünïcode 日本語 текст 🙂 naïve café", " odd\u0085space\xa0here", "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3,
    "it holds ten words of the item that is below here now and more",
]
ITEMS = [None, "", "ten words of the item that is below here now", "...", "zz yy"]
PAGES = [
    (None, None), ("", ""), ("no scheme", "<p>x"), ("http://a.org/1", "<article><h1>T</h1><p>" + LONG + "</p></article>"), ("http://A.org/1", "<article><h1>T</h1><p>" + LONG + "</p></article>"),
    ("https://free-bets.net/es/#x", "plain & <b>bold</b> &amp; text"), ("http://b.example.org/en/17?q", None), ("://", "<div" * 50),
]


def given(spark, folder, n):
    """The tables with ``n`` times their rows, 0 or 1, in a folder."""
    extra = ", ".join(f"`{c}` string" for c in EXTRA)
    more = [None if k % 2 else "1" for k in range(len(EXTRA))]
    docs = [(k, t, [None, "en", "de"][k % 3], [None, "s1", "s2"][k % 3], None if k % 2 else len(t or ""), *more) for k, t in enumerate(TEXTS)] * n
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    items = [(k, t, *more) for k, t in enumerate(ITEMS)] * n
    spark.createDataFrame(items, f"item_id long, text string, {extra}").write.parquet(f"{folder}/benchmark.parquet")
    pages = [(k, u, h, *more) for k, (u, h) in enumerate(PAGES)] * n
    spark.createDataFrame(pages, f"page_id long, url string, html string, {extra}").coalesce(2).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return given(spark, tmp_path_factory.mktemp("odd"), 1)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return given(spark, tmp_path_factory.mktemp("empty"), 0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    found = QUERIES[name](spark, odd)
    if name in SQL and name != "op5_sharding":  # its SQL does not say which table's column it means where names clash
        names, want = rows_of_sql(SQL[name], odd)
        assert sorted(found.columns) == names and rows_of(found) == want
    else:
        key = found.columns[0]
        ids = [r[key] for r in found.collect()]
        assert sorted(ids) == list(range(len(PAGES) if key == "page_id" else len(TEXTS)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_rows(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_pipeline(spark, odd, empty):
    columns = spark.read.parquet(f"{odd}/documents.parquet").columns
    kept = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, odd)
        assert kept.columns == columns, name
        assert {tuple(r) for r in kept.select("size", "target", "taken").distinct().collect()} == {("1", None, "1")}, name
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, odd).select("doc_id").collect()} <= set(range(len(TEXTS)))
    assert corpus_pipeline.run(spark, empty).count() == 0
