from __future__ import annotations

import json

import pytest

from ravelin import cli, schemas
from ravelin.operators.store import SnapshotStore


def test_ingest_from_a_command_line(spark, tmp_path, capsys):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# A\none two")
    (docs / "b.txt").write_text("three")
    run = lambda *more: cli.main([str(docs), str(tmp_path / "s"), *more], {"RAVELIN_BUCKETS": "3 buckets", "RAVELIN_VECTOR_SIZE": "x"})
    assert run("--embedder", "hashing") == {"processed": 2, "skipped": 0, "deleted": 0, "chunks": 2}
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["processed"] == 2
    assert run()["skipped"] == 2 and run("--full")["processed"] == 2
    store = SnapshotStore(spark, str(tmp_path / "s/chunks"), schemas.STORED_CHUNK, "metadata.source", 3)
    assert store.count() == 2 and set(store.head().versions) <= {0, 1, 2}
    with pytest.raises(SystemExit):
        cli.main(["--nope"])


@pytest.mark.parametrize("text, number", [("12", 12), (" 7px", 7), ("-3", -3), ("", 5), (None, 5), ("x1", 5)])
def test_whole_numbers(text, number):
    assert cli.whole_number(text, 5) == number
