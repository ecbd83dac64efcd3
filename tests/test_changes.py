"""The stream of changes against the batch diff of the same listings."""

from __future__ import annotations

import random

import pytest

from ravelin.operators import ingest
from ravelin.streaming import changes


def listings(n, seed):
    rng = random.Random(seed)
    now, out = {}, []
    for _ in range(n):
        now = {s: (h if rng.random() < 0.8 else f"h{rng.randint(0, 5)}") for s, h in now.items() if rng.random() < 0.85}
        now |= {f"f{rng.randint(0, 30)}.md": f"h{rng.randint(0, 5)}" for _ in range(6)}
        out.append(dict(now))
    return [*out, {}]


@pytest.mark.parametrize("at_once", [True, False])
def test_stream_equals_the_diff_and_a_restart_repeats_nothing(spark, tmp_path, at_once):
    root, out, seen = (str(tmp_path / n) for n in ("listings", "out", "checkpoint"))
    frame = lambda x: spark.createDataFrame(sorted(x.items()), "source string, hash string")
    given = listings(3, 5)
    for k, x in enumerate(given):
        changes.publish(frame(x), root, k + 1)
        if not at_once:
            changes.append_changes(spark, root, out, seen)
    for _ in range(2):  # the second time there is nothing new
        changes.append_changes(spark, root, out, seen)
    with pytest.raises(FileExistsError):
        changes.publish(frame({}), root, 1)
    want = []
    for k, (was, now) in enumerate(zip([{}, *given], given, strict=False)):
        diff = ingest.changes(frame(now), frame(was)).filter("state <> 'same'").collect()
        want += [(r["source"], k + 1, r["state"], now.get(r["source"])) for r in diff]
    got = [tuple(r) for r in spark.read.schema(changes.CHANGE).parquet(out).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and {"new", "changed", "gone"} == {w[2] for w in want}
