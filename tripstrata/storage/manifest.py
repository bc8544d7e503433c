"""What a generation's files hold: rows, bytes, time bounds, latest load and a digest, one entry per file.

A generation never changes, so its manifest is written once, beside it, before the pointer that
makes it count. It is made by reading back the pickup time, load time and fingerprint of what was
written. The driver holds one entry per file, as Spark's own file index does.

The digest of a set of rows is their number, the sums of three parts of a 64-bit hash per row, and
the exclusive or of the hashes. It does not depend on order, and the digest of two
sets together follows from theirs.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1)


@dataclass(frozen=True)
class Digest:
    rows: int = 0
    low: int = 0
    middle: int = 0
    high: int = 0
    xor: int = 0

    def __add__(self, other: Digest) -> Digest:
        return Digest(self.rows + other.rows, self.low + other.low, self.middle + other.middle, self.high + other.high, self.xor ^ other.xor)


def digest_columns(fingerprint: Column) -> list[Column]:
    """Aggregates that make a :class:`Digest`, in its field order."""
    mark, part = F.xxhash64(fingerprint), F.lit((1 << 22) - 1)
    # parts of 22 bits: their sums fit 64 bits over two million million rows
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(mark.bitwiseAND(part)), F.lit(0)).alias("low"),
        F.coalesce(F.sum(F.shiftrightunsigned(mark, 22).bitwiseAND(part)), F.lit(0)).alias("middle"),
        F.coalesce(F.sum(F.shiftrightunsigned(mark, 44)), F.lit(0)).alias("high"),
        F.coalesce(F.bit_xor(mark), F.lit(0)).alias("xor"),
    ]


DIGEST_FIELDS = tuple(f.name for f in fields(Digest))


@dataclass(frozen=True)
class FileEntry:
    """A file of a generation. Times are microseconds since 1970; None where the file has none."""

    folder: str
    name: str
    rows: int
    bytes: int
    first: int | None = None
    last: int | None = None
    loaded: int | None = None
    digest: tuple[int, ...] | None = None

    def as_json(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}

    @classmethod
    def from_json(cls, entry: dict) -> FileEntry:
        digest = entry.get("digest")
        return cls(**entry | {"digest": tuple(digest) if digest else None})

    @property
    def values(self) -> tuple[str, ...]:
        """Partition values of the file's folder."""
        return folder_values(self.folder)

    @property
    def path(self) -> str:
        return f"{self.folder}/{self.name}" if self.folder else self.name

    def touches(self, start: datetime, end: datetime) -> bool:
        """May the file hold a time in ``[start, end)``?"""
        return self.first is not None and self.first < micros(end) and self.last >= micros(start)

    def inside(self, start: datetime, end: datetime) -> bool:
        """Do all times of the file lie in ``[start, end)``? Rows without a time may be among them."""
        return self.first is not None and self.first >= micros(start) and self.last < micros(end)


def folder_values(folder: str) -> tuple[str, ...]:
    """Partition values of a folder, as Spark escaped them in its name."""
    return tuple(unquote(part.split("=", 1)[1]) for part in folder.split("/") if part)


def micros(moment: datetime) -> int:
    """Microseconds since 1970 of a wall-clock time or an instant."""
    plain = moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment
    passed = plain - EPOCH
    return (passed.days * 86_400 + passed.seconds) * 1_000_000 + passed.microseconds


def instant(value: int) -> datetime:
    """The instant ``value`` microseconds after 1970."""
    seconds, rest = divmod(value, 1_000_000)
    return datetime.fromtimestamp(seconds, timezone.utc).replace(microsecond=rest)


def measure(written: DataFrame, marker: str, time: str | None, loaded: str | None, fingerprint: str | None) -> list[FileEntry]:
    """Entries of the files of ``written``; ``marker`` is the path part their folders follow."""
    since = f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {{}}({time}))"
    nothing = F.lit(None).cast("bigint")
    counters = digest_columns(F.col(fingerprint)) if fingerprint else [F.count(F.lit(1)).alias("rows"), *[nothing.alias(n) for n in DIGEST_FIELDS[1:]]]
    per_file = written.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(
        *counters,
        (F.expr(since.format("min")) if time else nothing).alias("first"),
        (F.expr(since.format("max")) if time else nothing).alias("last"),
        (F.unix_micros(F.max(loaded)) if loaded else nothing).alias("loaded"),
    )
    entries = []
    for r in per_file.collect():
        folder, _, name = unquote(r["path"]).split(marker, 1)[1].rpartition("/")
        digest = tuple(r[n] for n in DIGEST_FIELDS[1:]) if fingerprint else None
        entries.append(FileEntry(folder, name, r["rows"], r["bytes"], r["first"], r["last"], r["loaded"], digest))
    return sorted(entries, key=lambda e: e.path)


def total(entries: Iterable[FileEntry]) -> Digest:
    """Digest of all rows of the files."""
    found = Digest()
    for entry in entries:
        found += Digest(entry.rows, *(entry.digest or ()))
    return found
