"""WARC archives with Zstandard frames: writer and reader.

An archive starts with a skippable frame that holds its dictionary (itself compressed), then has one frame per record. Each task
writes its own archives, with a dictionary trained on their first records, to a shared folder; the table of archives names the
files of tasks that succeeded, so a lost executor leaves no half archive behind in it. The reader takes one archive per task,
streams it frame by frame, and checks every record's version line, headers, lengths and digests.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import slices, stored
from swathline.session import own_path

DICTIONARY_MAGIC = 0x184D2A5D
LEAST_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
TRAIN_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
READ_BYTES = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # records carry no capture time of their own: equal input gives equal records
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that Spark names; ``s3a`` is what the library calls ``s3``."""
    uri = re.sub(r"^s3[an]://", "s3://", uri)
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, owner: int | None) -> bytes:
    """A response with the payload, or, where another page owns it, a revisit with the HTTP headers alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if owner is not None else http + payload
    headers = [("WARC-Type", "response" if owner is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        headers.append(("Page-ID", str(page_id)))
    if owner is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(owner, digest)), ("Refers-To-Page-ID", str(owner))]
    headers += [
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The record in one frame; ValueError if anything about it is wrong."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC record: {data[:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name.lower() in headers:
            raise ValueError(f"bad header line {line!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise ValueError(f"header {name} is missing")
    length = headers["content-length"]
    if not length.isdigit() or int(length) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, its header says {length}")
    block = rest[:-4]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError("the block doesn't match its digest")
    kind = headers["warc-type"]
    out = {"record_type": kind, "url": headers.get("warc-target-uri"), "page_id": None, "refers_to": None, "payload": None, "payload_bytes": None, "payload_digest": None}
    if kind not in ("response", "revisit"):
        return out
    http, gap, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http.replace(b"\r\n", b"\n"))
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if not gap or not said or not digest:
        raise ValueError("HTTP headers, their length or the payload digest are missing")
    if kind == "response" and (len(payload) != int(said[1]) or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload doesn't match its length or digest")
    page, owner = headers.get("page-id"), headers.get("refers-to-page-id")
    if kind == "revisit" and (payload or owner is None or headers.get("warc-refers-to") != record_id(int(owner), digest)):
        raise ValueError("the revisit doesn't name its response")
    out |= {"page_id": None if page is None else int(page), "refers_to": None if owner is None else int(owner)}
    return out | {"payload": payload if kind == "response" else None, "payload_bytes": int(said[1]), "payload_digest": digest}


class ArchiveWriter:
    """Records in, archives out; a new archive starts when one is full."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self.fs, self.root = open_folder(self.folder)
        self.waiting: list[bytes] = []
        self.size = 0
        self.out = None
        self.done: list[tuple[str, int, int]] = []

    def _start(self) -> None:
        name = f"{uuid.uuid4().hex}.warc.zst"
        self.path = f"{self.folder}/{name}"
        self.out = self.fs.open_output_stream(f"{self.root}/{name}", compression=None)
        self.written = self.records = 0
        dictionary = None
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, [r[: 16 << 10] for r in self.waiting])
        except zstandard.ZstdError:  # too few records to train on
            pass
        if dictionary is not None:
            body = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
            self._put(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
        for record in self.waiting:
            self._frame(record)
        self.waiting, self.size = [], 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _frame(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.waiting.append(record)
            self.size += len(record)
            if self.size >= TRAIN_BYTES:
                self._start()
            return
        self._frame(record)
        if self.written >= ARCHIVE_BYTES:
            self._close()

    def _close(self) -> None:
        self.out.close()
        self.done.append((self.path, self.records, self.written))
        self.out = None

    def finish(self) -> list[tuple[str, int, int]]:
        if self.waiting:
            self._start()
        if self.out is not None:
            self._close()
        return self.done


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder)
        for part in slices(batches, "html"):
            columns = (part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "owner"))
            for page_id, url, html, digest, owner in zip(*columns, strict=True):
                revisit = owner if owner is not None and owner != page_id else None
                writer.add(make_record(page_id, url, html.encode(), digest, revisit))
        rows = writer.finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"]
        )

    return write


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives of all ``pages`` in ``folder`` (by default one of its own in the shared folder, which goes when the session ends): ``path, records, bytes``.

    Of pages with equal payloads of 1000 bytes or more the largest page_id owns the payload; others become revisits. Rows
    that repeat the owner's page_id are responses too. A null html is an empty payload; a null page_id or url is left out of
    the record, and a payload that only pages without an id have is stored with each.
    """
    spark = pages.sparkSession
    folder = folder or own_path(spark)
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    owners = named.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    owned = named.join(owners.where("n > 1").select("digest", "owner"), "digest", "left")
    return stored(owned.mapInArrow(_writer(folder), "path string, records long, bytes long"))


def read_frames(stream) -> Iterator[bytes]:
    """Records of an archive, one per frame; the dictionary comes from the leading skippable frame, if there is one."""
    head = stream.read(8)
    dictionary, data = None, head
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_MAGIC:
        size = struct.unpack("<II", head)[1]
        body = stream.read(size)
        if len(body) != size:
            raise ValueError("the dictionary frame is cut short")
        if body[:4] == zstandard.FRAME_HEADER:
            body = zstandard.ZstdDecompressor().decompress(body)
        dictionary, data = zstandard.ZstdCompressionDict(body), b""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                return
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            if not data:
                data = stream.read(READ_BYTES)
                if not data:
                    raise ValueError("the last frame is cut short")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _reader(with_payload: bool):
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    if with_payload:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for path, records in zip(part.column("path").to_pylist(), part.column("records").to_pylist(), strict=True):
                fs, place = open_folder(path)
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(place, compression=None) as stream:
                    for data in read_frames(stream):
                        rows.append(parse_record(data))
                        seen += 1
                        held += len(data)
                        if held >= 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{path} has {seen} records, {records} were written")
                yield batch(rows)

    return read


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives named in ``path`` (with their number in ``records``), about one archive per task: the number
    of tasks is given, as their rows are too small for Spark to tell how much work they are."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if with_payload else "")
    names = archives.select("path", "records")
    return names.repartitionByRange(max(1, names.count()), "path").mapInArrow(_reader(with_payload), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read back from archives of all pages."""
    return read_archives(write_archives(pages), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest FROM p),
o AS (SELECT digest, max(page_id) AS owner FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN owner IS NULL OR owner = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM d LEFT JOIN o ON d.digest = o.digest AND n >= 1000
"""
