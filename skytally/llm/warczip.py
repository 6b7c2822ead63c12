"""ZIP-packaged web archives: a writer, and a reader that range-reads records without extraction.

An archive is a ZIP file of stored members: `archive/data.warc.gz`, one gzip member a WARC record, and `indexes/index.cdxj`, one JSON line a record with offset and length within the data member.
It is written as a stream, members' sizes following their data, and always with ZIP64 sizes, offsets, end record and locator. The reader takes the end of the file, follows the ZIP64 locator
where there is one, parses the central directory, finds where the stored members begin from their local headers, reads the part of the index that the manifest gives for the records asked for, and then
reads only the byte ranges of these records.

Archives lie in the folder given, normally in the shared one; they are written under a name of their own for each attempt, so a repeated task leaves a file that no
manifest names, and are reached through pyarrow's file systems (local, s3, gs, hdfs).

Defined results for pages. A null html is an empty payload. Of the records with equal payloads of at least dedup_bytes, the one with the
largest page_id is a response and the others are revisits that refer to it; records that share that largest page_id are all responses; a null page_id is the largest only
if all are null. A null url is written as `urn:page:<page_id>`. Columns of other names are not archived. An empty table gives an archive-less manifest and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, materialise, shared_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A slice of an archive: its records, and where their lines are in the index member.
MANIFEST = "path string, first long, records long, index_at long, index_bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: A new archive begins after so many bytes, and a reading task takes so many records.
ARCHIVE_BYTES, SLICE = 128 << 20, 500


def file_system(path: str):
    """pyarrow's file system for a URI or an absolute path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC 1.1 record, gzipped. A revisit carries the headers only, with the digest and the length of the full payload."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
    name = uuid.uuid4().urn if page_id is None else f"urn:page:{page_id}"
    headers = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    headers += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    if kind == "revisit":
        headers += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"X-Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    headers += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(headers).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def parse_record(raw: bytes) -> dict:
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    known = lambda x: None if x is None else int(x)
    response = fields["WARC-Type"] == "response"
    return {
        "page_id": known(fields.get("X-Page-ID")), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": known(fields.get("X-Refers-To-Page")),
        "payload_bytes": len(payload) if response else int(fields["X-Payload-Length"]), "payload_digest": base32_sha1(payload) if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload": payload if response else None,
    }


class ZipWriter:
    """Stored members, one after another, into a stream that can't go back; every size and offset is a ZIP64 one."""

    #: Version 4.5; sizes after the data, names in UTF-8; 1980-01-01.
    VERSION, FLAGS, TIME, DATE, FULL = 45, 0x0808, 0, 0x21, 0xFFFFFFFF

    def __init__(self, out):
        self.out, self.at, self.directory, self.name = out, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.begun, self.crc, self.size = name.encode(), self.at, 0, 0
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", self.VERSION, self.FLAGS, 0, self.TIME, self.DATE, 0, self.FULL, self.FULL, len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._put(data)

    def end(self) -> None:
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", self.crc, self.size, self.size))
        head = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", self.VERSION, self.VERSION, self.FLAGS, 0, self.TIME, self.DATE, self.crc, self.FULL, self.FULL, len(self.name), 28, 0, 0, 0, 0, self.FULL)
        self.directory.append(head + self.name + struct.pack("<HHQQQ", 1, 24, self.size, self.size, self.begun))

    def close(self) -> None:
        begun, entries, n = self.at, b"".join(self.directory), len(self.directory)
        self._put(entries)
        end = self.at
        self._put(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, self.VERSION, self.VERSION, 0, 0, n, n, len(entries), begun))
        self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, self.FULL, self.FULL, 0))


class ArchiveWriter:
    """Writes records into archives below a folder, one after another; close() gives the slices of each as rows of MANIFEST."""

    def __init__(self, folder: str, most: int = ARCHIVE_BYTES):
        self.folder, self.most, self.done, self.zip = folder, most, [], None

    def add(self, *record) -> None:
        if self.zip is None:
            self.path = f"{self.folder}/{uuid.uuid4().hex}.wacz"
            fs, at = file_system(self.path)
            self.out = fs.open_output_stream(at)
            self.zip, self.index, self.size = ZipWriter(self.out), [], 0
            self.zip.begin(DATA)
        raw = record_bytes(*record)
        self.zip.write(raw)
        self.index.append(json.dumps({"id": record[0], "offset": self.size, "length": len(raw)}).encode() + b"\n")
        self.size += len(raw)
        if self.size >= self.most:
            self.close()

    def close(self) -> list[tuple]:
        if self.zip is not None:
            self.zip.end()
            self.zip.begin(INDEX)
            at = 0
            for first in range(0, len(self.index), SLICE):
                lines = b"".join(self.index[first : first + SLICE])
                self.zip.write(lines)
                self.done.append((self.path, first, len(self.index[first : first + SLICE]), at, len(lines)))
                at += len(lines)
            self.zip.end()
            self.zip.close()
            self.out.close()
            self.zip = None
        return self.done


class ZipReader:
    """Members of a ZIP archive by range reads. read(offset, length) and size describe the file."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = self._directory()

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        tail_at = max(0, self.size - 65_557)  # the end record and the longest comment
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of a central directory")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        locator_at = tail_at + end - 20
        locator = self.read(locator_at, 20) if locator_at >= 0 else b""
        if locator[:4] == b"PK\x06\x07":
            end64 = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record where the locator points")
            count, length, at = struct.unpack_from("<QQQ", end64, 32)
        elif 0xFFFF == count or 0xFFFFFFFF in (length, at):
            raise ValueError("ZIP64 values without a locator")
        directory, members, p = self.read(at, length), {}, 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, = struct.unpack_from("<H", directory, p + 10)
            packed, full = struct.unpack_from("<II", directory, p + 20)
            n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, p + 28)
            local, = struct.unpack_from("<I", directory, p + 42)
            name = directory[p + 46 : p + 46 + n_name].decode()
            extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
            while q + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, q)
                if kind == 1:  # the 64-bit values of those fields that are full, in this order
                    values = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    local = next(values) if local == 0xFFFFFFFF else local
                q += 4 + n
            members[name] = (method, packed, local)
            p += 46 + n_name + n_extra + n_comment
        return members

    def where(self, name: str) -> tuple[int, int]:
        """Offset and length in the file of a stored member's data."""
        method, length, local = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        head = self.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return local + 30 + n_name + n_extra, length


def open_archive(path: str):
    fs, at = file_system(path)
    file = fs.open_input_file(at)

    def read(offset: int, length: int) -> bytes:
        return file.read_at(length, offset)

    return file, ZipReader(read, file.size())


def read_records(path: str, index_at: int = 0, index_bytes: int | None = None) -> Iterator[dict]:
    """The records of a part of an archive's index (all by default), each by a range read."""
    file, archive = open_archive(path)
    with file:
        start, length = archive.where(INDEX)
        entries = archive.read(start + index_at, length - index_at if index_bytes is None else index_bytes).splitlines()
        start, _ = archive.where(DATA)
        for entry in entries:
            entry = json.loads(entry)
            yield parse_record(archive.read(start + entry["offset"], entry["length"]))


def with_record_types(pages: DataFrame, dedup_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, kind and refers_to of every page. Groups of equal payloads are found on digests alone, pre-aggregated before the shuffle."""
    payload = F.coalesce(pages["html"].cast("binary"), F.lit("").cast("binary"))
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("bytes"))
    groups = p.where(F.col("bytes") >= dedup_bytes).groupBy("sha1", "bytes").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    repeated = materialise(groups.where("n > 1").drop("n"))
    p = lookup(p, repeated, ["sha1", "bytes"], row_bytes=64, spread=F.col("page_id"))
    revisit = F.col("page_id").isNull() & F.col("largest").isNotNull() | (F.col("page_id") != F.col("largest"))
    return p.select("page_id", "url", "payload", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("kind"), F.when(revisit, F.col("largest")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, dedup_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes every page as a record; returns the manifest, a written table with a row a slice of an archive."""
    folder = folder or shared_folder(pages.sparkSession)
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)

    def write(batches):
        import pyarrow as pa

        out = ArchiveWriter(folder, archive_bytes)
        for batch in batches:
            for page_id, url, payload, kind, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                url = f"urn:page:{page_id}" if url is None else re.sub(r"[\r\n]", " ", url)
                out.add(page_id, url, payload, base32_sha1(payload), kind, refers_to)
        found, names = out.close(), [x.split()[0] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_pydict({k: [x[i] for x in found] for i, k in enumerate(names)}, schema=pa.schema([(k, pa.int64() if i else pa.string()) for i, k in enumerate(names)]))

    return materialise(with_record_types(pages, dedup_bytes).mapInArrow(write, MANIFEST), folder, "manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives of a manifest; every task range-reads its slices."""
    wanted = [x.split()[0] for x in RECORD.split(", ") if payloads or not x.startswith("payload binary")]

    def read(batches):
        import pyarrow as pa

        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(k, kinds.get(k, pa.string())) for k in wanted])
        for batch in batches:
            for row in batch.to_pylist():
                rows, size = [], 0
                for record in read_records(row["path"], row["index_at"], row["index_bytes"]):
                    rows.append({k: record[k] for k in wanted})
                    size += record["payload_bytes"] if payloads else 0
                    if size > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    n = manifest.count()  # one row a slice of an archive
    dealt = manifest.repartition(max(1, min(n, 10_000)))
    return dealt.mapInArrow(read, ", ".join(x for x in RECORD.split(", ") if x.split()[0] in wanted))
