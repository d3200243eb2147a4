"""WARC archives with an index written first, and coalesced byte-range reads.

Writing: each record is a gzip member of its own, so an archive can be read from any record on. Of records with equal
payloads the one with the largest id is a response, the others are revisits that carry headers only. Every task writes
archives under new names into one folder and hands on the index of what it wrote: offset, length, url and digest
per record. The index is saved once; files that a lost task left behind are in no index and are never read.

Reading: index rows of the records wanted are dealt by archive and stretch, sorted by offset, and records that lie close
together come in one read of a bounded size.

Defined results: a null html is an empty payload; a null url is an empty one; white space and control characters of a
url stand in the record's header as percent codes, while the index has the url as it is; a null id is written as an empty one and
read back as null, and never names a response while other ids do; rows that repeat an id with an equal payload are
records each; payloads shorter than the least length are all responses; an empty table gives no archives and an empty
index; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from slipcoach.plans import shared as scratch
from pyspark.sql import functions as F


LEAST_BYTES = 0
#: Largest archive, largest read, largest gap that a read runs over.
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES = 64 << 20, 4 << 20, 64 << 10
#: Bytes of records that a task reads, about.
TASK_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, archive string, offset long, length long"


#: Names that the reader of Python tasks has for schemes of Hadoop.
SCHEMES = {"s3a": "s3", "s3n": "s3", "file": "file"}


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI and the path in it: local and mounted folders, hdfs, viewfs, s3, gs and abfs."""
    scheme, colon, rest = folder.partition(":")
    if not colon:
        return fs.FileSystem.from_uri(f"file://{folder}")
    path = rest if rest.startswith("//") else f"//{rest}"
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{path}")


def _header_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(5, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _record(kind: str, page_id: int | None, url: str, sha1: str, n: int, block: bytes, more: str = "") -> bytes:
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{url}:{kind}")
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: {_header_url(url)}\r\n"
        f"WARC-Payload-Digest: sha1:{sha1}\r\nContent-Type: application/http; msgtype=response\r\nX-Page-ID: {'' if page_id is None else page_id}\r\n"
        f"X-Payload-Length: {n}\r\n{more}Content-Length: {len(block)}\r\n\r\n"
    )
    return _member(head.encode() + block + b"\r\n\r\n")


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page as a response record, packed, with its digest."""
    for batch in batches:
        out = []
        for page_id, url, text in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            payload, url = (text or "").encode(), url or ""
            sha1 = digest(payload)
            out.append((page_id, url, sha1, len(payload), _record("response", page_id, url, sha1, len(payload), _HTTP % len(payload) + payload)))
        yield _table(out, _PACKED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [(x or "").encode() for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array([digest(x) for x in payloads], pa.string()), pa.array([len(x) for x in payloads], pa.int64())], names=["page_id", "digest", "n"])


_PACKED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("n", pa.int64()), ("member", pa.binary())])
_INDEXED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _written(folder: str, archive_bytes: int) -> Callable:
    """Writes archives and passes on their index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        name, stream, place = "", None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, sha1, n, member, first, kind in zip(*(batch.column(c) for c in ("page_id", "url", "digest", "n", "member", "first", "record_type")), strict=True):
                    page_id, url, sha1, kind = page_id.as_py(), url.as_py(), sha1.as_py(), kind.as_py()
                    refers = None
                    if kind == "revisit":
                        refers = first.as_py()
                        more = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nX-Refers-To-Page-ID: {refers}\r\n"
                        member = _record("revisit", page_id, url, sha1, n.as_py(), _HTTP % n.as_py(), more)
                    else:
                        member = member.as_buffer()
                    if stream is None or place > archive_bytes:
                        if stream is not None:
                            stream.close()
                        name, place = f"{uuid.uuid4().hex}.warc.gz", 0
                        stream = store.open_output_stream(f"{at}/{name}", compression=None)
                    stream.write(member)
                    rows.append((page_id, url, sha1, kind, refers, name, place, len(member)))
                    place += len(member)
                yield _table(rows, _INDEXED)
        finally:
            if stream is not None:
                stream.close()

    return run


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the pages' archives into a folder that all machines share (a URI); returns the saved index."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    store, at = _store(folder)
    store.create_dir(at)
    seen = rows.select("page_id", "html").mapInArrow(_digests, "page_id long, digest string, n long")
    # only payloads that occur more than once are looked up; a page packed as a response moves once, packed
    first = seen.groupBy(F.col("digest").alias("of")).agg(F.max("page_id").alias("first"), F.count("*").alias("held"), F.first("n").alias("size"))
    first = scratch.save(first.filter((F.col("held") > 1) & (F.col("size") >= least_bytes) & F.col("first").isNotNull()).select("of", "first"), "first")
    packed = rows.mapInArrow(_responses, "page_id long, url string, digest string, n long, member binary")
    kind = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), "revisit").otherwise("response")
    joined = packed.join(first, F.col("digest") == F.col("of"), "left").withColumn("record_type", kind)
    return scratch.save(joined.mapInArrow(_written(folder, archive_bytes), INDEX), "index", batch_rows=500)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a packed record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def ranges(wanted: list[tuple[str, int, int]], read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(archive, begin, end, records) of the reads for sorted (archive, offset, length)."""
    archive, begin, end, held = None, 0, 0, []
    for name, offset, length in wanted:
        if held and (name != archive or offset - end > gap_bytes or offset + length - begin > read_bytes):
            yield archive, begin, end, held
            held = []
        if not held:
            archive, begin = name, offset
        end = max(end if held else 0, offset + length)
        held.append((offset, length))
    if held:
        yield archive, begin, end, held


def _fetched(folder: str, read_bytes: int, gap_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _store(folder)
        name, source = None, None
        for batch in batches:
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))
            rows = []
            for archive, begin, end, records in ranges(wanted, read_bytes, gap_bytes):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, store.open_input_file(f"{at}/{archive}")
                data = source.read_at(end - begin, begin)
                for offset, length in records:
                    headers, block = parse(data[offset - begin : offset - begin + length])
                    page_id, refers = headers.get("X-Page-ID", ""), headers.get("X-Refers-To-Page-ID")
                    if headers["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        n, sha1 = len(payload), digest(payload)
                        if "sha1:" + sha1 != headers["WARC-Payload-Digest"]:
                            raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                    else:
                        n, sha1 = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append((int(page_id) if page_id else None, n, sha1, headers["WARC-Type"], int(refers) if refers else None))
            yield _table(rows, _READ)
        if source is not None:
            source.close()

    return run


def read(spark: SparkSession, index: DataFrame, folder: str, read_bytes: int = READ_BYTES, gap_bytes: int = GAP_BYTES) -> DataFrame:
    """The records that the index rows name: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Stretches of an archive are dealt to as many tasks as the records' summed lengths ask for.
    """
    places = index.select("archive", F.floor(F.col("offset") / read_bytes).alias("stretch"), "offset", "length")
    n = max(1, math.ceil((places.agg(F.sum("length")).first()[0] or 0) / TASK_BYTES))
    dealt = places.repartition(n, "archive", "stretch").sortWithinPartitions("archive", "offset")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return dealt.select("archive", "offset", "length").mapInArrow(_fetched(folder, read_bytes, gap_bytes), schema)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes archives of all pages into the shared folder and reads all their records back."""
    spark = pages.sparkSession
    folder = scratch.place(spark, "warc")
    index = write(pages, folder, least_bytes=least_bytes)
    return scratch.save(read(spark, index, folder), "records")
