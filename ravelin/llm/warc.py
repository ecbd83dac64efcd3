"""WARC archives with a two-level capture index.

Writing: one gzip member a record, by Spark's own text sink, so that any store Spark
writes to will do and retried tasks leave no half-written archive behind.  (The sink
ends each row by a separator; it is set to a NUL byte, and each member is handed over
without its last byte, which is NUL, the top byte of a size below 16 MB.  A larger
member gets an empty one after it, whose size is 0.)  A row of the sink is a pack of
members of about ``PACK_BYTES``, or one member that is larger, and an archive has
``FILE_PACKS`` rows, so archives are cut by bytes.  Of records with equal payloads
of ``REVISIT_BYTES`` or more, the smallest page_id is the response; others are revisits.

Index: captures sorted by reversed-host URL key, in compressed blocks of
``BLOCK_ROWS`` lines; the directory has the first key of each block.  A look-up finds the
range of the key by binary search over the ranges' first keys (a row a range
partition), then the block over the directory of that range, then the line in the
block, and reads the record by its file, offset and length alone.

Null html is the empty payload.  A null url has the empty key; a null page_id stays
null and is larger than any.  Rows that repeat are separate records with equal results.
No pages give no archives and no rows.  Archives are read in chunks where Arrow opens the
store, so neither they nor their number bound memory; else they come as whole files, which must be
below 2 GB.  Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.llm.common import broadcast_if_small, release, shared_path, sliced, table, written

REVISIT_BYTES = 100
#: Bytes of a pack of members, packs of an archive file.
PACK_BYTES, FILE_PACKS = 1 << 20, 128
#: Lines of an index block, lines of an index range.
BLOCK_ROWS, RANGE_ROWS = 256, 50_000
#: Bytes of records that a task reads back, in the mean.
READ_BYTES = 64 << 20
#: The pages have no capture time; every record bears this one.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_CHUNK = 1 << 16


def url_key(url: str | None) -> str:
    """Sort-friendly key of a URL: host labels reversed, no scheme, user, default port or fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    if host.startswith("www."):
        host = host[4:]
    where = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{where}){path.lower()}"


def header_url(url: str) -> str:
    """A URL that can stand in a header line: blanks and control characters escaped."""
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)


def capture_key(url: str | None, page_id: int | None) -> str:
    """The index's key: URL key, then the capture's number, padded so that it sorts as one."""
    return f"{url_key(url)} {'~' if page_id is None else f'{page_id + 2**63:020d}'}"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of another page if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + header_url(url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record (names in lower case) and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _packed(data: bytes) -> bytes:
    """A gzip member without the NUL byte that it ends in."""
    member = gzip.compress(data, 4, mtime=0)
    if member[-1]:
        member += gzip.compress(b"", mtime=0)
    return member[:-1]


def members(chunks: Iterator[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that has content, of an archive in chunks."""
    at, data = 0, b""
    while True:
        unzip, used, out = zlib.decompressobj(31), 0, []
        while not unzip.eof:
            data = data or next(chunks, b"")
            if not data:
                if used:
                    raise ValueError("archive ends within a record")
                return
            out.append(unzip.decompress(data))
            used += len(data)
            data = b""
        data = unzip.unused_data
        used -= len(data)
        if content := b"".join(out):
            yield at, used, content
        at += used


def _write_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of records: members with the NUL byte between them that each ends in."""
    pack: list[bytes] = []
    size = 0

    def row() -> pa.RecordBatch:
        nonlocal size
        joined = pa.array([b"\0".join(pack)], pa.binary())
        pack.clear()
        size = 0
        return pa.RecordBatch.from_arrays([joined], ["pack"])

    for batch in sliced(batches, 100):
        page_id, url, html, digest, first = (batch.column(k) for k in range(5))
        rows = zip(page_id.to_pylist(), url.to_pylist(), html.cast(pa.binary()).to_pylist(), digest.to_pylist(), first.to_pylist(), strict=True)
        for p, u, h, d, f in rows:
            member = _packed(record(p, u, h, d, None if f is None or f == p else f))
            if pack and size + len(member) >= PACK_BYTES:
                yield row()
            pack.append(member)
            size += len(member) + 1
    if pack:
        yield row()


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as archives in the folder ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = F.octet_length("html") >= REVISIT_BYTES
    equal = (
        rows.filter(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    # few payloads repeat: pages are not shuffled to meet them
    equal = broadcast_if_small(written(equal, "warc-equal"))
    joined = rows.join(equal, "digest", "left").select("page_id", "url", "html", "digest", "first")
    (
        joined.mapInArrow(_write_records, "pack binary")
        .select(F.col("pack").cast("string"))
        .write.option("lineSep", "\0")
        .option("maxRecordsPerFile", FILE_PACKS)
        .text(path)
    )


# -- index ---------------------------------------------------------------------------


_CAPTURE_ARROW = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_CAPTURE = "key string, file string, offset long, length long"


def _places(file: str, chunks: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Key and place of every record of an archive file."""
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        arrays = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CAPTURE_ARROW, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=_CAPTURE_ARROW)

    for offset, length, data in members(chunks):
        headers, _ = parse(data)
        page = headers.get("x-page-id")
        rows.append((capture_key(headers.get("warc-target-uri"), None if page is None else int(page)), file, offset, length))
        if len(rows) == 5_000:
            yield batch()
    if rows:
        yield batch()


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of archive files that Arrow opens (path)."""
    for batch in sliced(batches, 1):
        for file in batch.column(0).to_pylist():
            with _open(file, stream=True) as source:
                yield from _places(file, iter(lambda: source.read(_CHUNK), b""))


def _captures_of_contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of archive files that Spark's reader hands over whole (path, content)."""
    for batch in batches:
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = memoryview(content.as_buffer())
            yield from _places(file, (bytes(data[k : k + _CHUNK]) for k in range(0, len(data), _CHUNK)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted lines; one task holds one range of keys."""
    part = uuid.uuid4().hex
    lines: list[tuple] = []
    n = 0

    def block() -> pa.RecordBatch:
        nonlocal n
        text = "\n".join(json.dumps(x) for x in lines)
        row = {"range": part, "block": n, "first_key": lines[0][0], "last_key": lines[-1][0], "lines": zlib.compress(text.encode(), 6)}
        n += 1
        lines.clear()
        return pa.RecordBatch.from_pylist([row], _BLOCK_ARROW)

    for batch in sliced(batches):
        for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines.append(line)
            if len(lines) == BLOCK_ROWS:
                yield block()
    if lines:
        yield block()


_BLOCK_ARROW = pa.schema([("range", pa.string()), ("block", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string()), ("lines", pa.binary())])
_BLOCK = "range string, block long, first_key string, last_key string, lines binary"


def build_index(spark: SparkSession, archives: str) -> DataFrame:
    """The index of all archive files in a folder: a table of blocks, whose column
    first_key is its directory."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives)
    found = files.select("path").mapInArrow(_captures, _CAPTURE) if _opens(archives) else files.select("path", "content").mapInArrow(_captures_of_contents, _CAPTURE)
    captures = written(found, "warc-captures")
    ranges = max(1, -(-captures.count() // RANGE_ROWS))
    ordered = captures.repartitionByRange(ranges, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return written(ordered.mapInArrow(_blocks, _BLOCK), "warc-index")


def _find(key: tuple, wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Look up one range's wanted keys: the block by its first key, the line by its key."""
    blocks = blocks.sort_values("block")
    firsts, opened, out = blocks["first_key"].tolist(), {}, []
    for w in sorted(wanted["key"]):
        k = max(0, bisect.bisect_left(firsts, w) - 1)
        while k < len(firsts) and firsts[k] <= w:
            if k not in opened:
                opened.clear()  # keys come in order: one block at a time
                opened[k] = [json.loads(x) for x in zlib.decompress(blocks["lines"].iloc[k]).decode().split("\n")]
            lines = opened[k]
            i = bisect.bisect_left(lines, w, key=lambda x: x[0])
            while i < len(lines) and lines[i][0] == w:
                out.append(lines[i])
                i += 1
            k += 1
    return pd.DataFrame(out, columns=["key", "file", "offset", "length"])


def look_up(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, file, offset, length) of the captures that have the keys in ``wanted`` (key, distinct)."""
    bounds = sorted(
        (r["lo"], r["hi"], r["range"])
        for r in index.groupBy("range").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi")).collect()
    )  # a row a range partition

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def ranges_of(keys: pd.Series) -> pd.Series:
        lows = [b[0] for b in bounds]

        def found(key: str) -> list[str]:
            k, out = bisect.bisect_right(lows, key) - 1, []
            while k >= 0 and bounds[k][1] >= key:
                out.append(bounds[k][2])
                k -= 1
            return out

        return keys.map(found)

    placed = wanted.select("key", F.explode(ranges_of("key")).alias("range"))
    return (
        placed.groupBy("range")
        .cogroup(index.groupBy("range"))
        .applyInPandas(_find, "key string, file string, offset long, length long")
    )


# -- reading -------------------------------------------------------------------------

_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_READ_ARROW = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)


def _described(data: bytes) -> dict:
    """What a record says; a response's payload is measured and hashed anew."""
    headers, block = parse(gzip.decompress(data))
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda name: int(headers[name]) if name in headers else None
    stated = headers["warc-payload-digest"].removeprefix("sha256:")
    revisit = headers["warc-type"] == "revisit"
    if not revisit and hashlib.sha256(payload).hexdigest() != stated:
        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    return {
        "page_id": number("x-page-id"),
        "url": headers.get("warc-target-uri"),
        "payload_bytes": None if revisit else len(payload),
        "payload_digest": stated,
        "record_type": headers["warc-type"],
        "refers_to": number("x-refers-to-page-id"),
    }


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read each place (file, offset, length), opening a file once for places in order."""
    name, source = None, None
    for batch in sliced(batches, 100):
        rows = []
        for file, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if file != name:
                if source is not None:
                    source.close()
                name, source = file, _open(file)
            rows.append(_described(source.read_at(length, offset)))
        yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)


def _read_slices(key: tuple, places: pd.DataFrame, files: pd.DataFrame) -> pd.DataFrame:
    rows = [_described(f[o : o + n]) for f in files["content"] for o, n in zip(places["offset"], places["length"], strict=True)]
    return pd.DataFrame(rows, columns=_READ_ARROW.names).astype({k: "Int64" for k in ("page_id", "payload_bytes", "refers_to")})


def _open(file: str, stream: bool = False):
    """A file by its URI, to be read at places, or in order."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(file)
    return (store.open_input_stream if stream else store.open_input_file)(unquote(path))


def _opens(uri: str) -> bool:
    """Whether Arrow reads this kind of store; else whole files come through Spark."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def read_records(places: DataFrame, archives: str) -> DataFrame:
    """The records at ``places`` (file, offset, length)."""
    spark = places.sparkSession
    at = places.select("file", "offset", "length")
    if _opens(archives):
        size = at.agg(F.sum("length")).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))
        ordered = at.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
        return ordered.mapInArrow(_read_ranges, _READ)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archives)
    return (
        at.groupBy("file")
        .cogroup(files.select(F.col("path").alias("file"), "content").groupBy("file"))
        .applyInPandas(_read_slices, _READ)
    )


def captures(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, index them, and read every page back through the index."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    release(spark)
    index = build_index(spark, path)

    @F.pandas_udf(T.StringType())
    def keys_of(ids: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([capture_key(u and header_url(u), None if i == "" else int(i)) for i, u in zip(ids, urls, strict=True)])

    text_id = F.coalesce(F.col("page_id").cast("long").cast("string"), F.lit(""))
    wanted = pages.select(keys_of(text_id, "url").alias("key")).distinct()
    places = written(look_up(index, wanted), "warc-places")
    records = written(read_records(places, path), "warc-records")
    originals = (
        records.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("__n"))
    )
    found = records.filter("record_type = 'revisit'").join(originals, "payload_digest", "left").withColumn("payload_bytes", F.col("__n")).drop("__n")
    return records.filter("record_type = 'response'").unionByName(found)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return captures(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
