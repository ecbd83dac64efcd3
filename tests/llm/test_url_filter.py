"""URL filters: parts of URLs, rules, the sorted array of digests."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from ravelin.llm import url_filter as uf
from tests.compare import check

WORDS = ["a", "bb", "c-c", "example", "org", "com", "net", "es", "1", "é"]


def urls_of(n: int, seed: int) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [None, "", "no scheme", "://", "http://", "http://ORG", "HTTP://Example.ORG/es/x?q=://b#c", "https://x.example.org/en/17", "a://b://c/d", "http://com?/fr/", "http://com#x", "http://com/fr/"]
    for _ in range(n):
        host = ".".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4)))
        path = "".join("/" + rng.choice(WORDS) for _ in range(rng.randint(0, 4))) + rng.choice(["", "/", "?x=/y", "#z"])
        out.append(f"http://{host.upper() if rng.random() < 0.2 else host}{path}")
    return out


def plain(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def blocked(host: str, path: str, entries: set[str]) -> bool:
    for e in entries:
        domain, _, start = e.partition("/")
        if not start and (host == domain or host.endswith("." + domain)) and host:
            return True
        if start and host == domain and (path == "/" + start or path.startswith("/" + start.rstrip("/") + "/") and (not start.endswith("/") or path.startswith("/" + start))):
            return True
    return False


def want(url, entries):
    host, path = plain(url)
    fits = [(len(d + p), len(d), d + p, v) for v, d, p in uf.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    rule = max(fits)[2:] if fits else (None, None)
    return host, path, rule[0], rule[1] or ("block" if blocked(host, path, entries) else "allow")


@pytest.mark.parametrize("slice_rows, most", [(1_000_000, 64), (3, 64), (3, 2)])
def test_all_urls_against_brute_force(spark, slice_rows, most):
    urls = urls_of(300, 3)
    rng = random.Random(9)
    entries = {"bb/", "net/", "a.net/", "c-c.com/", "é/", "example.net/a", "bb.com/a/bb", "org.com/es/", "", *(f"{rng.choice(WORDS)}.{rng.choice(WORDS)}/{rng.choice(WORDS)}" for _ in range(20))}
    rows = spark.createDataFrame([(k, u, "x", k) for k, u in enumerate(urls)], "page_id long, url string, host string, `odd name` long")
    array = uf.build(spark.createDataFrame([(e,) for e in [*entries, None, "bb/"]], "entry string"), slice_rows)
    assert (len(array.files) > 2) == (slice_rows == 3)
    got = uf.judged(rows, array, uf.RULES, most)
    assert got.columns == ["page_id", "url", "odd name", *uf.ADDED]
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()}
    assert found == {k: want(u, entries - {""}) for k, u in enumerate(urls)}
    assert {"allow", "block"} == {f[3] for f in found.values() if f[2] is None}


def test_nothing_listed_nothing_asked_and_copies(spark):
    rows = spark.createDataFrame([(1, "http://a/b"), (1, "http://a/b"), (2, None)], "page_id long, url string")
    none = uf.build(spark.createDataFrame([], "entry string"))
    assert none.files == () and [r["verdict"] for r in uf.judged(rows, none, uf.RULES).collect()] == ["allow"] * 3
    one = uf.build(spark.createDataFrame([("a/",)], "entry string"))
    assert sorted(r["verdict"] for r in uf.judged(rows, one, uf.RULES).collect()) == ["allow", "block", "block"]
    assert uf.judged(rows.limit(0), one, uf.RULES).count() == 0
    long = spark.createDataFrame([(1, "http://" + "a." * 2000 + "b" + "/x" * 5000)], "page_id long, url string")
    assert uf.judged(long, one, uf.RULES).first()["verdict"] == "allow"


def test_equal_digests_are_told_apart_by_strings(tmp_path):
    keys, entries = [3, 7, 7, 7, 9], ["a/", "b/", "c/", "dd/", "e/"]
    batch = pa.RecordBatch.from_pydict({"digest": keys, "entry": entries})
    data = b"".join(b.column(0)[0].as_py() for b in uf._pack(iter([batch])))
    (tmp_path / "part-0").write_bytes(data + b"\0")
    finder = uf.Finder(uf.DigestArray((3,), (f"file://{tmp_path}/part-0",)))
    asked = [b"a/", b"b/", b"dd/", b"x/", b"e/", b"q/", b"z/"]
    assert finder.listed(np.array([3, 7, 7, 7, 9, 1, 99]), asked).tolist() == [True, True, True, False, True, False, False]
    (tmp_path / "part-1").write_bytes(b"".join(b.column(0)[0].as_py() for b in uf._pack(iter([pa.RecordBatch.from_pydict({"digest": [9, 9], "entry": ["f/", "g/"]})]))))
    two = uf.Finder(uf.DigestArray((3, 9), (f"file://{tmp_path}/part-0", f"file://{tmp_path}/part-1")), 1)
    assert two.listed(np.array([9, 9, 7]), [b"e/", b"g/", b"c/"]).tolist() == [True, True, True]


def test_digests_are_sparks(spark):
    from pyspark.sql import functions as F

    texts = ["", "a/", "é.example/", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "e string").select("e", F.xxhash64("e").alias("h")).collect()
    assert all(np.uint64(uf.digest_of(r["e"].encode())).view(np.int64) == r["h"] for r in rows)


def test_url_filters_sql(spark):
    check(spark, uf.op13_url_filters, uf.SQL)
