"""Web archives: write page records into ZIP packages, find and range-read them again.

Records are compressed one by one, and the members that hold them are stored as they are.

Each Spark task streams its pages into packages of bounded size on shared storage; a retried
task writes new files, and only those of the attempt that won are in the manifest, which is
staged. Reading goes manifest -> central directory -> index -> byte ranges; ranges are
dealt out by package and region, so one large package is read by many tasks.

Of pages with equal payloads the one with the largest id is stored; the others are revisit
records without a payload, which carry its digest and length. Defined cases: NULL html is
the empty payload and NULL url an empty one; a NULL id loses to every id; rows that share
the largest id of their payload are all stored; an empty input gives no package and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zipfile
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.llm.base import staged
from tripstrata.llm.zip_archive import data_offset, index_lines, members, open_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 256 << 20
REGION_BYTES = 16 << 20
RECORD = "urn:page:"

MANIFEST = "path string, bytes bigint, records bigint"
RANGES = "path string, start bigint, length bigint"
FOUND = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def record_bytes(page_id, url: str, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One record: header block, HTTP head, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Fields of one record; a stored payload is checked against its digest."""
    head, _, block = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(n) if (n := fields.get(name, "").strip("<>").removeprefix(RECORD)) else None
    if fields["WARC-Type"] == "response" and (len(payload) != length or sha1_base32(payload) != digest):
        raise ValueError(f"payload of record {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields["WARC-Target-URI"],
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_owner(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """``(page_id, url, html, owner)``; the owner of a payload that occurs more than once is its largest id.

    Payloads that occur once need no owner: the table of owners holds repeated ones only, and Spark
    broadcasts it where it is small, so that no html is shuffled.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("html"), F.unhex(F.sha1(payload)).alias("digest")
    )
    owners = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    repeated = staged(owners.where("n > 1").select("digest", "owner"), "payload-owners")
    return rows.join(repeated, "digest", "left").select("page_id", "url", "html", "owner")


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write every page as a record; the manifest ``(path, bytes, records)``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            # plain integers: a column with NULLs would come as doubles, which do not hold every id
            for page_id, owner, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if package is None:
                    package = PackageWriter(folder)
                package.add(page_id, url, html.as_py().encode(), owner)
                if package.size >= package_bytes:
                    done.append(package.close())
                    package = None
        if package is not None:
            done.append(package.close())
        if done:
            yield batch_of([dict(zip(("path", "bytes", "records"), x, strict=True)) for x in done], MANIFEST)

    rows = with_owner(pages, id_col, url_col, html_col, min_bytes).select("page_id", "owner", "url", "html")
    return staged(rows.mapInArrow(write, MANIFEST), "warc-manifest")


class PackageWriter:
    """One package, streamed; its index is kept until the end and grows with the package's records only."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        files, place = open_path(self.path)
        self.out = files.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, url: str, payload: bytes, owner: int | None) -> None:
        revisit = owner is not None and page_id != owner
        record = gzip.compress(record_bytes(page_id, url, payload, sha1_base32(payload), owner, revisit), 6, mtime=0)
        self.data.write(record)
        self.lines.append(json.dumps({"offset": self.size, "length": len(record)}))
        self.size += len(record)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "\n".join(self.lines))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return self.path, size, len(self.lines)


def locate(manifest: DataFrame) -> DataFrame:
    """``(path, start, length)``: the byte range of every record, from directories and indexes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = open_path(path)
                with files.open_input_file(place) as source:
                    read = lambda offset, length, f=source: f.read_at(length, offset)
                    found = {m.name: m for m in members(read, source.size())}
                    start, index = data_offset(read, found[DATA]), found[INDEX]
                    rows = []
                    for line in index_lines(read, data_offset(read, index), index.size):
                        rows.append({"path": path, "start": start + line["offset"], "length": line["length"]})
                        if len(rows) == 10_000:
                            yield batch_of(rows, RANGES)
                            rows = []
                    if rows:
                        yield batch_of(rows, RANGES)

    return staged(manifest.mapInArrow(scan, RANGES), "warc-ranges")


def read_records(ranges: DataFrame, with_payload: bool = True, batch_bytes: int = 8 << 20, region_bytes: int = REGION_BYTES) -> DataFrame:
    """The records at ``ranges``, each read by its own byte range, in about one task per region."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_path: dict[str, list[tuple[int, int]]] = {}
            for path, start, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                by_path.setdefault(path, []).append((start, length))
            for path, own in by_path.items():
                files, place = open_path(path)
                with files.open_input_file(place) as source:
                    rows, size = [], 0
                    for start, length in own:
                        row = parse_record(gzip.decompress(source.read_at(length, start)))
                        rows.append(row if with_payload else row | {"payload": None})
                        size += length
                        if size >= batch_bytes:
                            yield batch_of(rows, FOUND)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows, FOUND)

    # the number is given: ranges are few bytes, but what they stand for is not
    regions = ranges.select("path", F.floor(F.col("start") / region_bytes).alias("region"))
    tasks = regions.distinct().count()
    dealt = ranges.repartition(max(1, tasks), "path", F.floor(F.col("start") / region_bytes))
    return dealt.mapInArrow(fetch, FOUND)


def batch_of(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [column.split() for column in schema.split(", ")]
    return pa.RecordBatch.from_pylist(rows, pa.schema([(name, kinds[kind]) for name, kind in fields]))

