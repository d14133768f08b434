"""WARC records in ZIP packages: writer and range reader.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj``, both stored without compression, so that a record is one range of the
package: local header, then the offset that the index gives.  The reader parses the end
record, the ZIP64 locator and the central directory itself and never extracts a member.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import open_fs, shared_dir, stored, table, write_once

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Records and bytes after which a task starts another package.
PACKAGE_RECORDS, PACKAGE_BYTES = 20_000, 128_000_000


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored_size: int
    header: int  # place of the local header
    crc: int


class ZipReader:
    """Members of a ZIP file and ranges of stored members, over any seekable pyarrow file."""

    def __init__(self, uri: str) -> None:
        system, path = open_fs(uri)
        self.uri, self.file = uri, system.open_input_file(path)
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> Iterator[Member]:
        size = self.file.size()
        tail_at = max(0, size - 22 - 65_535)
        tail = self.file.read_at(size - tail_at, tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError(f"{self.uri}: no end of central directory")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF:
            locator = self.file.read_at(20, tail_at + end - 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError(f"{self.uri}: no ZIP64 locator")
            record = self.file.read_at(56, struct.unpack_from("<Q", locator, 8)[0])
            if record[:4] != b"PK\x06\x06":
                raise ValueError(f"{self.uri}: no ZIP64 end record")
            count, length, at = struct.unpack_from("<QQQ", record, 32)
        directory, pos = self.file.read_at(length, at), 0
        for _ in range(count):
            if directory[pos : pos + 4] != b"PK\x01\x02":
                raise ValueError(f"{self.uri}: damaged central directory")
            flags, method = struct.unpack_from("<HH", directory, pos + 8)
            crc, packed, plain, n, m, k = struct.unpack_from("<IIIHHH", directory, pos + 16)
            header = struct.unpack_from("<I", directory, pos + 42)[0]
            name = directory[pos + 46 : pos + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, end_extra = pos + 46 + n, pos + 46 + n + m
            while extra + 4 <= end_extra:  # the ZIP64 field has only those of the values that overflow
                kind, width = struct.unpack_from("<HH", directory, extra)
                if kind == 1:
                    field = extra + 4
                    if plain == 0xFFFFFFFF:
                        plain, field = struct.unpack_from("<Q", directory, field)[0], field + 8
                    if packed == 0xFFFFFFFF:
                        packed, field = struct.unpack_from("<Q", directory, field)[0], field + 8
                    if header == 0xFFFFFFFF:
                        header = struct.unpack_from("<Q", directory, field)[0]
                extra += 4 + width
            yield Member(name, method, plain, packed, header, crc)
            pos = end_extra + k

    def start(self, name: str) -> int:
        """Place of a stored member's first byte in the package."""
        member = self.members[name]
        if member.method != zipfile.ZIP_STORED:
            raise ValueError(f"{self.uri}: {name} is compressed; only stored members can be read by range")
        head = self.file.read_at(30, member.header)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{self.uri}: no local header for {name}")
        n, m = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + n + m

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        member = self.members[name]
        length = member.size - offset if length is None else length
        if offset < 0 or offset + length > member.size:
            raise ValueError(f"{self.uri}: range outside of {name}")
        return self.file.read_at(length, self.start(name) + offset)


def _field(value: object) -> str:
    return "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header, with the length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (both with lower-case names) and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}, payload


def write_package(uri: str, records: list[tuple[dict, bytes]]) -> None:
    """Writes compressed records with index entries as one package."""

    def write(stream) -> None:
        with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED) as package:
            lines, at = [], 0
            with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
                for entry, data in records:
                    member.write(data)
                    lines.append(json.dumps(entry | {"offset": at, "length": len(data)}))
                    at += len(data)
            for name, text in ((INDEX, "".join(f"{x}\n" for x in lines)), ("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": DATA}, {"path": INDEX}]}))):
                package.writestr(zipfile.ZipInfo(name), text)

    write_once(uri, write)


def read_package(uri: str, read_bytes: int = 8_000_000) -> Iterator[tuple[dict, bytes]]:
    """Index entries with their records, by ranges of about ``read_bytes`` over neighbouring records."""
    package = ZipReader(uri)
    base, entries = package.start(DATA), [json.loads(x) for x in package.read(INDEX).splitlines()]
    i = 0
    while i < len(entries):
        j = i + 1
        while j < len(entries) and entries[j]["offset"] == entries[j - 1]["offset"] + entries[j - 1]["length"] and entries[j]["offset"] + entries[j]["length"] - entries[i]["offset"] <= read_bytes:
            j += 1
        first, last = entries[i]["offset"], entries[j - 1]["offset"] + entries[j - 1]["length"]
        block = package.file.read_at(last - first, base + first)
        for e in entries[i:j]:
            yield e, zlib.decompress(block[e["offset"] - first : e["offset"] - first + e["length"]], 31)
        i = j


def read_one(uri: str, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A single record by its index entry: one range of the package."""
    return parse_record(zlib.decompress(ZipReader(uri).read(DATA, offset, length), 31))


def first_of_payload(pages: DataFrame, out_dir: str, least_bytes: int = 100, salts: int = 16) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: refers_to is the smallest page_id of an equal payload elsewhere, or null.

    Groups of equal payloads are counted with partial sums and only those of two or more pages
    are kept, as a written table whose size the planner knows; beyond the broadcast limit the
    join is on digest and salt, so that a payload that many pages share is dealt out.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    groups = stored(groups.select("digest", "first_id"), f"{out_dir}/groups")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    joined = rows.join(groups, ["digest", "salt"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("first_id") != F.col("page_id"), F.col("first_id")).alias("refers_to"))


def write_packages(pages: DataFrame, out_dir: str) -> DataFrame:
    """Writes ``page_id, url, html`` as packages; returns their manifest ``path, records``.

    Null html is an empty payload.  Payloads under 100 bytes are always responses.  Rows that
    repeat the smallest page_id of a payload are responses too; a null page_id is never
    the one referred to.  Payloads of any length are one record; of equal digests the least
    page_id is the response, whatever the order of rows.  Other columns are ignored, whatever
    their names.  An empty table gives no package.

    An attempt's packages have its number in their names, and the manifest lists those of the
    attempts that Spark committed: what a lost or late attempt leaves behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, size, records, done = 0, 0, [], []
        task = f"part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"

        def close() -> None:
            nonlocal k, size
            uri = f"{out_dir}/{task}-{k:04d}.wacz"
            write_package(uri, records)
            done.append((uri, len(records)))
            records.clear()
            k, size = k + 1, 0

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = squeeze.compress(record(page_id, url, payload, digest, refers_to)) + squeeze.flush()
                records.append(({"page_id": page_id, "digest": f"sha256:{digest}"}, data))
                size += len(data)
                if len(records) >= PACKAGE_RECORDS or size >= PACKAGE_BYTES:
                    close()
        if records:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return stored(first_of_payload(pages, out_dir).mapInArrow(run, "path string, records long"), f"{out_dir}/manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """One row per record (``SCHEMA``), the digest of each response's payload computed anew and held against its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows = []
                for entry, data in read_package(uri):
                    fields, http, payload = parse_record(data)
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    kind, refers = fields["warc-type"], fields.get("warc-refers-to")
                    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                        raise ValueError(f"{uri}: the payload at {entry['offset']} does not match its digest")
                    name = fields["warc-record-id"][len("<urn:page:") : -1]
                    rows.append((int(name) if name else None, int(http["content-length"]), digest, kind, int(refers[len("<urn:page:") : -1]) if refers else None))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, SCHEMA)


def op2_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_packages(write_packages(table(spark, sf_dir, "pages"), shared_dir(spark, "packages")))


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
