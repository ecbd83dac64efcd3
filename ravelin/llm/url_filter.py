"""URL filters: rules by host and path first, then a sorted array of digests of listed entries.

A list of hosts and pages to block becomes slices of a sorted array: 64-bit xxHash keys in
ascending order, the places of their strings, and the strings themselves, one file a slice in
the shared folder.  Spark sorts the entries by digest into ranges, and each range is written
by its text sink, so that a lost executor's slice is written again whole.  A task maps the slices
into memory (``numpy.memmap``), finds all candidates of a batch of URLs by one vectorised binary
search, and compares the stored strings of those it finds: equal digests alone block nothing.

Entries are ``host/``, which stands for the host and all its subdomains, or a host and a path
(``host/a/b``), which stands for that path and, at its slashes, all below it.  The candidates of a URL are
its host and the domains above it, and its host with the path cut at each slash and whole.

A list of ``MAX_MAPPED`` slices at most is mapped as a whole by every task.  A larger one is met
by the URLs' distinct candidates sorted by digest into as many ranges as there are slices, so that a
task maps a few slices only, and what is found is joined back.

A null URL, or one without ``://``, has an empty host and path and no candidates.  Ports and user
names are parts of the host, as they stand.  Empty lists block nothing, an empty table of
URLs gives an empty one.  Repeated rows are each judged; columns named as the added
ones are replaced, all others pass through.  Very long URLs take memory in
proportion to one URL.  The shared folder must be mounted, or of a kind that Arrow opens.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import broadcast_if_small, shared_path, sliced, table, without, written

#: Entries a slice: some 100 MB of keys, places and strings.
SLICE_ROWS = 1_000_000
#: Slices that every task maps; beyond that, candidates go to the slices.
MAX_MAPPED = 64
#: Spark's seed of ``xxhash64``, so that both sides have the same digests.
SEED = 42
#: Rules (verdict, host, path) of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words of host names, between dots and hyphens, that put a host on the registered query's list.
BAD_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam")
ADDED = ("host", "path", "rule", "verdict")


# -- parts of a URL and rules, as columns --------------------------------------------


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a URL; both empty without ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null: its host is the URL's or a domain above it, and the
    URL's path starts with its path.  Of rules of one length that with the longer host."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, domain, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


# -- the sorted array ----------------------------------------------------------------


@dataclass(frozen=True)
class DigestArray:
    """The first digest and the file of each slice, in ascending order."""

    firsts: tuple[int, ...]
    files: tuple[str, ...]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of sorted (digest, entry) as the bytes of a slice: count, keys, ends of strings, strings."""
    keys, sizes, strings = [], [], []
    for batch in sliced(batches, 100_000):
        keys.append(batch.column(0).to_numpy())
        whole = pa.concat_arrays([batch.column(1).cast(pa.large_binary())])
        parts = [v.as_py() for v in whole]
        sizes.append(np.fromiter(map(len, parts), np.int64, len(parts)))
        strings += [b"".join(parts)]
    if keys:
        keys, ends = np.concatenate(keys), np.cumsum(np.concatenate(sizes))
        data = b"".join([np.int64(len(keys)).tobytes(), keys.astype("<i8").tobytes(), ends.astype("<i8").tobytes(), *strings])
        yield pa.RecordBatch.from_pydict({"data": [data]})


def build(entries: DataFrame, slice_rows: int = SLICE_ROWS) -> DigestArray:
    """Write the distinct non-empty ``entries`` (entry) as slices of a sorted array in the shared folder."""
    spark = entries.sparkSession
    found = written(entries.select("entry").filter("entry <> ''").distinct().select(F.xxhash64("entry").alias("digest"), "entry"), "url-entries")
    slices = max(1, -(-found.count() // slice_rows))
    path = shared_path(spark, "url-array")
    ordered = found.repartitionByRange(slices, "digest", "entry").sortWithinPartitions("digest", "entry")
    packed = ordered.mapInArrow(_pack, "data binary").select(F.col("data").cast("string"))
    packed.write.option("lineSep", "\0").text(path)
    heads = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", F.substring("content", 9, 8).alias("first"))
    rows = sorted((int.from_bytes(r["first"], "little", signed=True), r["path"]) for r in heads.collect())  # a row a slice
    return DigestArray(tuple(r[0] for r in rows), tuple(r[1] for r in rows))


class _Slice:
    """One slice, mapped: keys and string ends are views of the file."""

    def __init__(self, uri: str):
        at = urlsplit(uri)
        if at.scheme in ("", "file"):
            self.data = np.memmap(unquote(at.path), np.uint8, "r")
        else:
            from pyarrow import fs

            store, path = fs.FileSystem.from_uri(uri)
            with store.open_input_stream(unquote(path)) as source:
                self.data = np.frombuffer(source.read(), np.uint8)
        n = int(self.data[:8].view("<i8")[0])
        self.keys = self.data[8 : 8 + 8 * n].view("<i8")
        self.ends = self.data[8 + 8 * n : 8 + 16 * n].view("<i8")
        self.strings = 8 + 16 * n

    def entry(self, k: int) -> bytes:
        start = int(self.ends[k - 1]) if k else 0
        return self.data[self.strings + start : self.strings + int(self.ends[k])].tobytes()


class Finder:
    """Looks candidates up in an array; keeps ``most`` slices mapped."""

    def __init__(self, array: DigestArray, most: int = MAX_MAPPED):
        self.firsts, self.files, self.most = np.asarray(array.firsts, np.int64), array.files, most
        self.mapped: dict[int, _Slice] = {}

    def _slice(self, k: int) -> _Slice:
        if k not in self.mapped:
            if len(self.mapped) >= self.most:
                self.mapped.clear()
            self.mapped[k] = _Slice(self.files[k])
        return self.mapped[k]

    def listed(self, digests: np.ndarray, entries: Sequence[bytes]) -> np.ndarray:
        """Which of ``entries``, whose ``digests`` are given, are in the list.

        Equal digests may go on into the next slice, so a candidate is looked for in all slices from the
        last one that starts below its digest to the last that starts at it.
        """
        found = np.zeros(len(digests), bool)
        if not len(self.files) or not len(digests):
            return found
        low = np.maximum(np.searchsorted(self.firsts, digests, "left") - 1, 0)
        high = np.searchsorted(self.firsts, digests, "right") - 1
        for k in np.unique(np.concatenate([low, high[high >= 0]])):
            part = self._slice(int(k))
            asked = np.nonzero((low <= k) & (k <= np.maximum(high, low)))[0]
            lo = np.searchsorted(part.keys, digests[asked], "left")
            hi = np.searchsorted(part.keys, digests[asked], "right")
            for j in np.nonzero(hi > lo)[0]:
                entry = entries[asked[j]]
                found[asked[j]] |= any(part.entry(x) == entry for x in range(lo[j], hi[j]))
        return found


def digest_of(entry: bytes) -> int:
    return xxhash.xxh64_intdigest(entry, SEED)


def candidates(host: bytes, path: bytes) -> list[bytes]:
    """The entries that would block a URL: its domains, and its path at each slash and whole."""
    if not host:
        return []
    found, at = [host + b"/"], host.find(b".")
    while at >= 0:
        found.append(host[at + 1 :] + b"/")
        at = host.find(b".", at + 1)
    at = path.find(b"/", 1)
    while at >= 0:
        found.append(host + path[:at])
        found.append(host + path[: at + 1])
        at = path.find(b"/", at + 1)
    if len(path) > 1:
        found.append(host + path)
    return list(dict.fromkeys(found))


def _candidates_of(batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes]]:
    """The row of each candidate, and the candidates, of a batch (host, path, ...)."""
    rows: list[int] = []
    found: list[bytes] = []
    for k, (host, path) in enumerate(zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in range(2)), strict=True)):
        mine = candidates(host, path)
        rows += [k] * len(mine)
        found += mine
    return np.asarray(rows, np.int64), found


def _digests(entries: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(digest_of, entries), np.uint64).view(np.int64)


def listed(urls: DataFrame, array: DigestArray, most: int = MAX_MAPPED) -> DataFrame:
    """``urls`` (host, path and more columns) with a boolean column ``listed``."""
    if len(array.files) <= most:

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(array, most)
            for batch in sliced(batches):
                rows, found = _candidates_of(batch)
                hit = np.zeros(batch.num_rows, bool)
                hit[rows[finder.listed(_digests(found), found)]] = True
                yield pa.RecordBatch.from_arrays([pa.array(hit), *batch.columns], ["listed", *batch.schema.names])

        ordered = urls.select("host", "path", *[c for c in urls.columns if c not in ("host", "path")])
        return ordered.mapInArrow(probe, T.StructType([T.StructField("listed", T.BooleanType()), *ordered.schema]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows, found = _candidates_of(batch)
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(rows)), pa.array(found, pa.binary())], ["row", "entry"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(array, 2)
        for batch in sliced(batches, 100_000):
            entries = batch.column(1).to_pylist()
            yield batch.select(["entry"]).filter(pa.array(finder.listed(batch.column(0).to_numpy(), entries)))

    numbered = written(urls.withColumn("__row", F.monotonically_increasing_id()), "url-rows")
    asked = written(numbered.select("host", "path", "__row").mapInArrow(spread, "row long, entry binary"), "url-candidates")
    keys = asked.select("entry").distinct().select(F.xxhash64("entry").alias("digest"), "entry")
    ranges = keys.repartitionByRange(len(array.files), "digest").sortWithinPartitions("digest")
    hits = written(ranges.mapInArrow(keep, "entry binary"), "url-hits")
    blocked = asked.join(broadcast_if_small(hits), "entry", "left_semi").select(F.col("row").alias("__row")).distinct()
    return numbered.join(blocked.withColumn("listed", F.lit(True)), "__row", "left").withColumn("listed", F.coalesce("listed", F.lit(False))).drop("__row")


def judged(urls: DataFrame, blocked: DigestArray, rules: Sequence[tuple[str, str, str]], most: int = MAX_MAPPED) -> DataFrame:
    """``urls`` (url and more columns) with host, path, rule and verdict: the rule's, else block if listed, else allow."""
    rest = without(urls, ADDED)
    inside = F.struct(*rest.columns).alias("__row_of")
    host, path = host_and_path(F.col("url"))
    found = listed(rest.select(host.alias("host"), path.alias("path"), inside), blocked, most)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    columns = [F.col("__row_of").getField(c).alias(c) for c in rest.columns]
    verdict = F.coalesce(rule["verdict"], F.when(F.col("listed"), "block").otherwise("allow"))
    return found.select(*columns, "host", "path", rule["rule"].alias("rule"), verdict.alias("verdict"))


def named_hosts(urls: DataFrame, words: Sequence[str] = BAD_WORDS) -> DataFrame:
    """(entry) of the hosts of ``urls`` that have one of ``words`` between dots and hyphens of their names."""
    host = host_and_path(F.col("url"))[0]
    return urls.select(host.alias("host")).distinct().filter(F.regexp_like("host", F.lit(rf"(^|[.-])({'|'.join(words)})([.-]|$)"))).select(
        F.concat("host", F.lit("/")).alias("entry")
    )


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the rules and a list of hosts that the pages themselves give."""
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    found = judged(urls, build(named_hosts(urls)), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH parts AS (
  SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM (
    SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), rules(verdict, domain, start) AS (
  VALUES {", ".join(str(r) for r in RULES)}
), fits AS (
  SELECT host, path, domain || start AS rule, verdict,
    row_number() OVER (PARTITION BY host, path ORDER BY length(domain || start) DESC, length(domain) DESC) AS n
  FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
    ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
), bad AS (
  SELECT DISTINCT host AS listed FROM parts WHERE regexp_matches(host, '(^|[.-])({"|".join(BAD_WORDS)})([.-]|$)')
), judged AS (
  SELECT DISTINCT host FROM (SELECT DISTINCT host FROM parts) JOIN bad ON host = listed OR ends_with(host, '.' || listed)
)
SELECT page_id, host, path, rule, coalesce(f.verdict, CASE WHEN j.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) f USING (host, path) LEFT JOIN judged j USING (host)
"""
