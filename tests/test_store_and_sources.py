from __future__ import annotations

import io
import tarfile
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from ravelin import schemas
from ravelin.config import NOT_FOUND
from ravelin.operators import ingest, prompt, store
from ravelin.operators.jsonstore import JsonStore
from ravelin.operators.store import SnapshotStore
from ravelin.sources import chat, files, providers
from ravelin.streaming.append import append_new_files


def write(root, tree):
    for name, text in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")


def stores(spark, root):
    return SnapshotStore(spark, str(root / "chunks"), schemas.STORED_CHUNK, "metadata.source", 16), SnapshotStore(spark, str(root / "state"), schemas.FILE_STATE)


def contents(s):
    return sorted((r["id"], r["content"]) for r in s.read().select("id", "content").collect())


def test_incremental_ingest(spark, tmp_path):
    docs = tmp_path / "docs"
    write(docs, {"a.md": "# A\none", "sub/b b.mdx": "two", "c.txt": "three", "d.py": "no", "e.MD": "no"})
    chunks, state = stores(spark, tmp_path)
    assert chunks.healthy() and chunks.count() == 0
    embed = providers.embedding_column(providers.HashingEmbedder(8))
    read = lambda: files.document_files(spark, str(docs))
    assert sorted(r["source"] for r in read().collect()) == ["a.md", "c.txt", "sub/b b.mdx"]
    first = ingest.ingest(read(), chunks, state, embed=embed)
    assert first == {"processed": 3, "skipped": 0, "deleted": 0, "chunks": 3}
    before = contents(chunks)
    assert ingest.ingest(read(), chunks, state, embed=embed) == {"processed": 0, "skipped": 3, "deleted": 0, "chunks": 3}
    assert contents(chunks) == before
    write(docs, {"a.md": "# A\nchanged\n# B\nmore"})
    (docs / "c.txt").unlink()
    assert ingest.ingest(read(), chunks, state, embed=embed) == {"processed": 1, "skipped": 1, "deleted": 1, "chunks": 3}
    assert sorted(c for _, c in contents(chunks)) == ["A\n\nchanged", "B\n\nmore", "b b\n\ntwo"]
    assert ingest.ingest(read(), chunks, state, full=True, embed=embed)["chunks"] == 3
    row = chunks.read().first()
    assert len(row["embedding"]) == 8 and row["metadata"]["chunk_index"] == 0
    chunks.clear()
    assert chunks.count() == 0


def test_a_crash_or_a_broken_state_loses_nothing(spark, tmp_path, monkeypatch):
    listing = lambda *rows: spark.createDataFrame(rows, "source string, content string")
    chunks, state = stores(spark, tmp_path)
    ingest.ingest(listing(("a.md", "one"), ("b.md", "two")), chunks, state)
    before, version = contents(chunks), chunks.version
    ingest.ingest(listing(("a.md", "one"), ("b.md", "two")), chunks, state)
    assert chunks.version == version  # nothing changed, nothing is written
    for broken in (chunks, state):
        with monkeypatch.context() as m:
            m.setattr(broken, "commit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
            with pytest.raises(OSError):
                ingest.ingest(listing(("a.md", "other"), ("b.md", "two")), chunks, state)
        assert broken is state or contents(chunks) == before
    assert ingest.ingest(listing(("a.md", "other"), ("b.md", "two")), chunks, state)["processed"] == 1
    assert [c for _, c in contents(chunks)] != [c for _, c in before] and chunks.count() == 2
    for file in (tmp_path / "state").glob("v-*/*/*.parquet"):
        file.write_bytes(b"no table")
    assert not state.healthy() and state.read_or_empty().count() == 0
    assert ingest.ingest(listing(("a.md", "other"), ("b.md", "two")), chunks, state) == {"processed": 2, "skipped": 0, "deleted": 0, "chunks": 2}


def test_of_two_writers_one_gets_an_error(spark, tmp_path):
    """Two stores over one folder commit what they staged from the same state, at once."""
    rows = lambda k: spark.createDataFrame([(f"{k}.md", str(k))], schemas.FILE_STATE)
    for turn in range(3):
        both = [SnapshotStore(spark, str(tmp_path / "s"), schemas.FILE_STATE) for _ in range(2)]
        staged = [(s, s.stage(rows(10 * turn + k)), s.head()) for k, s in enumerate(both)]
        gate = threading.Barrier(2)

        def commit(x, gate=gate):
            gate.wait()
            try:
                x[0].commit(x[1], x[2])
            except FileExistsError:
                return False
            return True

        with ThreadPoolExecutor(2) as pool:
            done = list(pool.map(commit, staged))
        assert sorted(done) == [False, True]
        assert [r["source"] for r in both[0].read().collect()] == [f"{10 * turn + done.index(True)}.md"]
        assert both[1].version == turn and not list((tmp_path / "s").glob("aside-*"))


def test_changes_write_their_buckets_only(spark, tmp_path):
    listing = lambda **new: spark.createDataFrame([(f"{k}.md", new.get(f"f{k}", "text " * 50 + str(k))) for k in range(300)], "source string, content string")
    chunks, state = stores(spark, tmp_path)
    ingest.ingest(listing(), chunks, state)
    before = chunks.head()
    assert sorted(before.versions) == list(range(16)) and sum(before.rows.values()) == 300 == chunks.count()
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / "chunks" / v).rglob("*.parquet"))
    full = size(before.versions[0])
    assert ingest.ingest(listing(f7="# New\nother"), chunks, state) == {"processed": 1, "skipped": 299, "deleted": 0, "chunks": 300}
    after = chunks.head()
    new = [b for b in after.versions if after.versions[b] != before.versions[b]]
    assert new == chunks.buckets_of(spark.createDataFrame([("7.md",)], "source string")) and after.number == before.number + 1
    assert size(after.versions[new[0]]) < 0.2 * full and chunks.read().count() == 300
    assert [r["content"] for r in chunks.of_sources(["7.md"]).collect()] == ["New\n\nother"]
    read = {f.split("bucket=")[1].split("/")[0] for f in chunks.read(new).inputFiles()}
    assert read == {str(new[0])}
    plan = chunks.of_sources(["7.md"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(metadata.source" in plan or "PushedFilters: [IsNotNull(metadata.source)" in plan or "EqualTo(metadata.source" in plan
    chunks.replace_sources(spark.createDataFrame([("7.md",), ("8.md",)], "source string"), chunks.read().limit(0))
    assert chunks.count() == 298 == chunks.read().count() and chunks.of_sources(["7.md", "8.md"]).count() == 0
    assert {p.name for p in (tmp_path / "chunks").glob("current-*")} == {f"current-{n:012d}" for n in (1, 2)}


def test_json_store_merges_and_broken_lines(spark, tmp_path):
    s = JsonStore(spark, str(tmp_path / "x"), "id string, v string", "id")
    rows = lambda *x: spark.createDataFrame([(i, v, n) for n, (i, v) in enumerate(x)], "id string, v string, position long")
    s.upsert(rows(("b", "1"), ("a", "2"), ("b", "3")))
    s.upsert(rows(("c", "4"), ("a", "5"), ("d", None), ("c", "6")))
    got = [(r["id"], r["v"]) for r in s.positioned().orderBy("position").collect()]
    assert got == [("b", "3"), ("a", "5"), ("c", "6"), ("d", None)] and s.read().columns == ["id", "v"]
    file = next((tmp_path / "x").glob("v-*/*/*.json"))
    file.write_text(file.read_text() + "{broken\n")
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    assert not s.healthy() and s.read_or_empty().count() == 0
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        s.read().collect()


@pytest.mark.parametrize("kind", ["snapshot", "json"])
def test_what_every_store_does(spark, tmp_path, kind):
    """The contract of ``store.ChunkStore``."""
    s = SnapshotStore(spark, str(tmp_path / "x"), schemas.STORED_CHUNK, "metadata.source", 4) if kind == "snapshot" else JsonStore(spark, str(tmp_path / "x"), schemas.STORED_CHUNK)
    assert s.healthy() and s.count() == 0 and s.read().count() == 0
    made = lambda rows: ingest.stored(ingest.chunked(spark.createDataFrame(rows, "source string, content string")))
    s.write(made([("a.md", "one"), ("b.md", "two")]))
    assert s.count() == 2 and s.healthy() and s.read().schema == spark.createDataFrame([], schemas.STORED_CHUNK).schema
    s.replace_sources(spark.createDataFrame([("b.md",), ("c.md",)], "source string"), made([("b.md", "new"), ("c.md", "three")]))
    assert sorted(r["content"] for r in s.read().collect()) == ["a\n\none", "b\n\nnew", "c\n\nthree"]
    s.replace_sources(spark.createDataFrame([("a.md",)], "source string"), made([]))
    assert s.count() == 2
    s.clear()
    assert s.count() == 0 and s.healthy()


def test_vector_search_and_its_own_query(spark):
    from ravelin.operators.dense import vector_search

    rows = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(30)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(5, [1.0, 5.0])], "qid long, embedding array<double>")
    assert [r["id"] for r in vector_search(rows, asked, k=1, skip_self=False).collect()] == [5]
    assert 5 not in {r["id"] for r in vector_search(rows, asked, k=3).collect()}
    same = rows.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.0)))
    assert sorted(r["id"] for r in vector_search(same, asked, k=4, skip_self=False).collect()) == [0, 1, 2, 3]  # ties: smaller ids


def test_keyed_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, store.upsert(old, new).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    said = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "id int, n int, v string")
    assert sorted(r["v"] for r in store.last_wins(said, "id", ["n"]).collect()) == ["y", "z"]


def test_archives(spark, tmp_path):
    path = tmp_path / "docs.tar.gz"
    with tarfile.open(path, "w:gz") as tar:
        for name, text in {"repo-main/docs/a.md": "A", "repo-main/src/b.md": "B", "repo-main/docs/sub/c.txt": "é", "repo-main/docs/d.bin": "D"}.items():
            data = text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rows = files.archived_files(spark, str(path), "repo-main/docs/").collect()
    assert sorted(map(tuple, rows)) == [("docs/a.md", "A"), ("docs/sub/c.txt", "é")]
    assert files.count_files(spark, str(tmp_path)) == 1


def test_stream_appends_new_files_only(spark, tmp_path):
    docs = tmp_path / "docs"
    write(docs, {"a.md": "one"})
    chunks, _ = stores(spark, tmp_path)
    run = lambda: append_new_files(spark, str(docs), chunks, str(tmp_path / "seen"))
    run()
    write(docs, {"b.md": "two"})
    run()
    run()
    assert sorted(c for _, c in contents(chunks)) == ["a\n\none", "b\n\ntwo"]


def test_providers():
    assert providers.make(providers.EMBEDDERS, "hashing").embed("a b") == providers.HashingEmbedder().embed("a b")
    with pytest.raises(ValueError, match="hashing"):
        providers.make(providers.EMBEDDERS, "nope")
    calls, waits = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("no")
        return "yes"

    assert providers.with_retry(fails, sleep=waits.append) == "yes" and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        providers.with_retry(lambda: (_ for _ in ()).throw(OSError("no")), sleep=waits.append)


def test_chat(spark):
    hits = spark.createDataFrame(
        [(2, "T2", "s2", 0.02, "second"), (1, "T1", "s1", 0.03, "Spark sorts. More")], "rk int, title string, source string, score double, content string"
    )
    history = [{"role": "user", "content": str(k)} for k in range(8)]
    messages, sources = chat.prepared("why?", history, hits)
    assert [m["content"] for m in messages[1:-1]] == ["2", "3", "4", "5", "6", "7"] and len(sources) == 2
    model = providers.ExtractiveModel()
    assert chat.answer("why?", [], hits, model)[0] == "Spark sorts"
    frames = list(chat.answer_events("why?", [], hits, model))
    assert frames[0].startswith('data: {"type": "sources"') and frames[-1] == "data: [DONE]\n\n"
    assert chat.answer("why?", [], hits.limit(0), model) == (NOT_FOUND, [])
    with pytest.raises(ValueError):
        next(chat.answer_events("  ", [], hits, model))


def test_requests(spark):
    bodies = [(1, '{"question":"q","history":[{"role":"user","content":"h"}]}'), (2, '{"question":" "}'), (3, '{"question":"r"}'), (4, "broken")]
    rows = prompt.valid_questions(spark.createDataFrame(bodies, "qid int, body string")).orderBy("qid").collect()
    assert [(r["qid"], r["question"], len(r["history"])) for r in rows] == [(1, "q", 1), (3, "r", 0)]


@pytest.mark.parametrize("n", [0, 3, 8])
def test_last_messages(spark, n):
    history = [("user", str(k)) for k in range(n)]
    df = spark.createDataFrame([(history,)], "h array<struct<role: string, content: string>>")
    got = df.select(prompt.last_messages(F.col("h")).alias("m")).first()["m"]
    assert [m["content"] for m in got] == [str(k) for k in range(n)][-6:]


def test_an_ingest_without_bm25_counts_no_terms(spark, monkeypatch):
    from ravelin.operators import bm25
    from ravelin.plans import registry

    def refuse(*_):
        raise AssertionError("terms are counted for nobody")

    monkeypatch.setattr(bm25.TermSums, "count", refuse)
    assert registry.queries()["ingested"](spark, "/root/testdata/sf0.001").filter("stale = 0").count() == 200
    with pytest.raises(AssertionError):
        registry.queries()["bm25_topk"](spark, "/root/testdata/sf0.001")


def test_small_buckets_make_small_files(spark, tmp_path):
    from ravelin.operators.store import SnapshotStore

    rows = SnapshotStore(spark, str(tmp_path / "s"), "source string, n long", "source", 8)
    rows.write(spark.range(200).select(F.concat(F.lit("f"), "id").alias("source"), F.col("id").alias("n")))
    files = [p for p in (tmp_path / "s").rglob("*.parquet")]
    assert len(files) == 8 and sum(p.stat().st_size for p in files) < 1_000_000  # a filter of a megabyte each before
    assert [r["n"] for r in rows.of_sources(["f7"]).collect()] == [7]
