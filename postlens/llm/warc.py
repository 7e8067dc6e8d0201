"""Seekable WARC archives of web pages.

``write`` turns every page into a WARC/1.1 record: a response with the payload, or a revisit that refers
to the response of the smallest ``page_id`` with an equal payload. Tasks append records to bundles of
bounded size. A bundle is a series of independent Zstandard frames of about ``frame_bytes`` (at least one
record each), the first one with the ``warcinfo`` record, followed by a seek table in a skippable frame
(the public seekable format: sizes of each frame, then their number and a magic number at the very end).
Concatenated, the frames are an ordinary ``.warc.zst`` file. The index maps record identifiers to bundle,
frame and the offset inside the decompressed frame, so ``fetch`` reads one frame for a record, and ``read``
deals the frames named by the seek tables to tasks.

Bundles carry the attempt that wrote them in their name, and only those of committed tasks are in the
index, so lost executors and repeated tasks leave files that nothing refers to. Payloads are told apart by
SHA-256. Payload groups are counted with partial sums; a page meets the first page of its payload
by a broadcast if these are few, else by a shuffle, from which payloads of more than ``HEAVY`` pages are
taken out (there is less than one of them for each ``HEAVY`` pages).

Defined results: null html is an empty payload, equal to an empty text; a null ``page_id`` comes after all
others; rows that repeat both id and payload are written each, all as responses if the id is the smallest;
a null url has no target; control characters, blanks and other than ASCII letters in it are percent-encoded in the record;
payloads are written whole; an empty table has no bundles; other columns take no part.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.shared import cut, lean, shared_dir, small_batches

#: Seek table: a skippable frame of this magic number, and the number its footer ends with.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Payloads of more pages are broadcast, others too while there are at most so many.
HEAVY, BROADCAST_ROWS = 100_000, 200_000
#: Compressed bytes that a reading task takes, about.
READ_BYTES = 32 << 20
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTABLE = "".join(chr(c) for c in range(33, 127))
INDEX = "record_id string, page_id long, record_type string, bundle string, frame int, offset long, length long"
RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


@dataclass(frozen=True)
class Config:
    #: Bytes of records after which a frame is closed, and compressed bytes after which a bundle is.
    frame_bytes: int = 1 << 20
    bundle_bytes: int = 256 << 20
    level: int = 3
    #: Payloads of fewer bytes are never revisits.
    least: int = 0
    #: The capture time of the records; the table has none.
    date: str = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload: bytes | str) -> str:
    """An identifier that follows from the page and its payload's SHA-256 (or the payload itself)."""
    sha = payload if isinstance(payload, str) else hashlib.sha256(payload).hexdigest()
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha}')}>"


def _record(kind: str, ident: str, date: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    named = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), *headers, ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v is not None).encode("ascii") + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: bytes, first: tuple[int | None] | None, date: str) -> tuple[str, bytes]:
    """Identifier and bytes of a page's record; ``first`` is the page that has the payload, if that is another one."""
    ident, sha = record_id(page_id, html), base32_sha1(html)
    target = None if url is None else quote(url, safe=_PRINTABLE)
    headers = [("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{sha}"), ("X-Page-ID", page_id), ("X-Payload-Length", len(html)), ("Content-Type", "application/http;msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    if first is None:
        return ident, _record("response", ident, date, headers, http + html)
    headers += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_id(first[0], html)), ("X-Refers-To-Page-ID", first[0])]
    return ident, _record("revisit", ident, date, headers, http)


def parse(frame: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record."""
    at = 0
    while at < len(frame):
        end = frame.index(b"\r\n\r\n", at) + 4
        lines = frame[at : end - 4].decode("ascii").split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}: {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        stop = end + int(headers["Content-Length"])
        if frame[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield at, headers, frame[end:stop]
        at = stop + 4


def _page(headers: dict[str, str], block: bytes) -> tuple:
    """A record as a row of ``RECORD``; the digest of a payload that is there is checked."""
    whole = headers["WARC-Type"] == "response"
    payload = block[block.index(b"\r\n\r\n") + 4 :] if whole else None
    digest, length = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
    if whole and (base32_sha1(payload), len(payload)) != (digest, length):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not have the digest it names")
    number = lambda k: int(headers[k]) if k in headers else None
    return headers["WARC-Record-ID"], number("X-Page-ID"), headers.get("WARC-Target-URI"), headers["WARC-Type"], number("X-Refers-To-Page-ID"), length, digest, payload


class Bundle:
    """One file of frames, written front to back."""

    def __init__(self, store: files.FileSystem, path: str, level: int) -> None:
        self.path, self.out, self.written = path, store.open_output_stream(path, compression=None), 0
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []

    def add(self, frame: bytes) -> int:
        """Append a frame and tell its number."""
        packed = self.press.compress(frame)
        self.out.write(packed)
        self.written += len(packed)
        self.sizes.append((len(packed), len(frame)))
        return len(self.sizes) - 1

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(store: files.FileSystem, path: str) -> list[tuple[int, int, int]]:
    """Start, compressed and decompressed size of each frame, from the end of the file."""
    with store.open_input_file(path) as f:
        f.seek(f.size() - 9)
        count, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != _SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entry = 12 if flags & 0x80 else 8  # with checksums
        f.seek(f.size() - 9 - count * entry)
        table = f.read(count * entry)
    frames, at = [], 0
    for k in range(count):
        packed, plain = struct.unpack_from("<II", table, k * entry)
        frames.append((at, packed, plain))
        at += packed
    return frames


def read_frame(store: files.FileSystem, path: str, start: int, packed: int) -> bytes:
    with store.open_input_file(path) as f:
        f.seek(start)
        return zstandard.ZstdDecompressor().decompress(f.read(packed))


def _sha256(html: Column) -> Column:
    return F.unhex(F.sha2(html, 256))


def with_first(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, html`` (null: empty) and ``first``: a struct of the page that has the same payload, null for that page itself."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = own.withColumn("_sha", _sha256(F.col("html")))
    large = keyed.where(F.octet_length("html") >= least)
    shared = large.groupBy("_sha").agg(F.min("page_id").alias("page_id"), F.count("*").alias("_pages")).where("_pages > 1")
    shared = cut(shared.select(F.col("_sha").alias("_of"), F.struct("page_id").alias("_first"), "_pages"), "warc-shared")
    light, heavy = shared.where(F.col("_pages") <= HEAVY).drop("_pages"), shared.where(F.col("_pages") > HEAVY).drop("_pages")
    if light.count() <= BROADCAST_ROWS:
        light = F.broadcast(light)
    met = keyed.join(F.broadcast(heavy.withColumnsRenamed({"_of": "_of_heavy", "_first": "_heavy"})), F.col("_sha") == F.col("_of_heavy"), "left")
    # What a heavy payload settles is left out of the shuffle's key, so that it spreads.
    key = F.when(F.col("_of_heavy").isNull(), F.col("_sha")).otherwise(F.unhex(F.concat(F.lit("ff"), F.hex(F.xxhash64("page_id", "url")))))
    met = met.join(light, key == F.col("_of"), "left").withColumn("first", F.coalesce("_heavy", "_first"))
    other = F.col("first").isNotNull() & (F.octet_length("html") >= least) & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return met.select("page_id", "url", "html", F.when(other, F.col("first")).alias("first"))


def write(pages: DataFrame, path: str, c: Config = Config()) -> DataFrame:
    """Archive ``pages(page_id, url, html)`` in bundles under ``path`` (a folder or URI that executors share) and tell the index."""
    small_batches(pages.sparkSession)

    def archive(batches):
        store, folder = files.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        bundle, held, size, placed, made = None, [], 0, [], 0

        def close_frame():
            nonlocal bundle, held, size, placed, made
            if bundle is None:
                bundle = Bundle(store, f"{folder}/{name}-{made}.warc.zst", c.level)
                made += 1
                info = f"software: postlens\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
                bundle.add(_record("warcinfo", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, bundle.path)}>", c.date, [("Content-Type", "application/warc-fields")], info))
            frame = bundle.add(b"".join(held))
            rows = [(*p[:3], bundle.path.rsplit("/", 1)[1], frame, *p[3:]) for p in placed]
            held, size, placed = [], 0, []
            if bundle.written >= c.bundle_bytes:
                bundle.close()
                bundle = None
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()])],
                ["record_id", "page_id", "record_type", "bundle", "frame", "offset", "length"],
            )

        for b in batches:
            for page_id, url, html, first in zip(*(b.column(k) for k in ("page_id", "url", "html", "first"))):
                first = first.as_py()
                ident, record = page_record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), None if first is None else (first["page_id"],), c.date)
                if held and size + len(record) > c.frame_bytes:
                    yield close_frame()
                placed.append((ident, page_id.as_py(), "response" if first is None else "revisit", size, len(record)))
                held.append(record)
                size += len(record)
        if held:
            yield close_frame()
        if bundle is not None:
            bundle.close()

    return cut(with_first(pages, c.least).mapInArrow(lean(archive), INDEX), "warc-index")


def frames(index: DataFrame, path: str) -> DataFrame:
    """``bundle, frame, start, packed, plain`` of each frame, from the seek tables of the index's bundles."""

    def run(batches):
        store, folder = files.FileSystem.from_uri(path)
        for b in batches:
            for bundle in b.column("bundle").to_pylist():
                rows = [(bundle, k, *f) for k, f in enumerate(seek_table(store, f"{folder}/{bundle}"))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()])], ["bundle", "frame", "start", "packed", "plain"])

    return index.select("bundle").distinct().mapInArrow(run, "bundle string, frame int, start long, packed long, plain long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], [c.split()[0] for c in RECORD.split(", ")])


def read(index: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """Every page record of the archives, with the columns of ``RECORD``; digests are checked. ``payloads=False`` leaves them null."""
    small_batches(index.sparkSession)
    found = cut(frames(index, path), "warc-frames")
    size = found.agg(F.sum("packed")).first()[0] or 0

    def run(batches):
        store, folder = files.FileSystem.from_uri(path)
        for b in batches:
            for bundle, start, packed in zip(*(b.column(k).to_pylist() for k in ("bundle", "start", "packed"))):
                rows = [_page(h, block) for _, h, block in parse(read_frame(store, f"{folder}/{bundle}", start, packed)) if h["WARC-Type"] != "warcinfo"]
                if rows:
                    yield _rows(rows if payloads else [(*r[:-1], None) for r in rows])

    return found.repartition(max(4, -(-size // READ_BYTES))).mapInArrow(lean(run), RECORD)


def fetch(index: DataFrame, path: str, wanted: DataFrame) -> DataFrame:
    """The records of ``wanted(record_id)``: only the frames that hold them are read, each once."""
    small_batches(index.sparkSession)
    hits = index.join(wanted.select("record_id").distinct(), "record_id")
    named = hits.groupBy("bundle", "frame").agg(F.collect_set("offset").alias("offsets")).join(frames(hits, path), ["bundle", "frame"])

    def run(batches):
        store, folder = files.FileSystem.from_uri(path)
        for b in batches:
            for bundle, start, packed, offsets in zip(*(b.column(k).to_pylist() for k in ("bundle", "start", "packed", "offsets"))):
                frame = read_frame(store, f"{folder}/{bundle}", start, packed)
                yield _rows([_page(*next(parse(frame[at:]))[1:]) for at in sorted(offsets)])

    return named.mapInArrow(lean(run), RECORD)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/postlens/warc-{uuid.uuid4().hex}"
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read(index, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH own AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
placed AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM own)
SELECT page_id, payload_bytes,
    list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(hex, 1 + 5 * (i // 4), 5))::bigint // (32 ** (3 - i % 4))::bigint) % 32, 1)), lambda a, b: a || b) AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM placed
"""
