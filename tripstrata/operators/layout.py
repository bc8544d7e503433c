"""The clean table's folder layout: batch, then pickup month or ``default``."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstrata.functions.temporal import month_key
from tripstrata.operators.batches import built_from
from tripstrata.operators.staging import enriched, fingerprinted
from tripstrata.operators.windows import DEFAULT_MONTH, batch_month_bounds, in_window, months_between
from tripstrata.schemas import CLEAN, CLEAN_STORED
from tripstrata.storage.manifest import FileEntry
from tripstrata.storage.warehouse import ALL, Warehouse


@dataclass(frozen=True)
class Span:
    """Months that have a range of their own, as sorted keys."""

    months: tuple[str, ...]

    def plus(self, more: list[str]) -> Span:
        return Span(tuple(sorted(set(self.months) | set(more))))

    @property
    def text(self) -> str:
        return ",".join(f"{low}-{high}" for low, high in _runs(self.months))

    def touches(self, entry: FileEntry) -> bool:
        """May a file of ``default`` hold trips of a month that has a range?"""
        return any(entry.touches(_month_start(low), _next_month(_month_start(high), 1)) for low, high in _runs(self.months))


def _month_start(key: str) -> datetime:
    return datetime(int(key[:4]), int(key[4:]), 1)


def _next_month(moment: datetime, count: int) -> datetime:
    month = moment.month - 1 + count
    return datetime(moment.year + month // 12, month % 12 + 1, 1)


def batch_span(batches: DataFrame) -> Span:
    """First batch month to one month past the last one; nothing without a real batch month."""
    first, last = batch_month_bounds(batches).first()
    if first is None:
        return Span(())
    return Span(tuple(months_between(first, _next_month(last, 2))))


def route_month(span: Span) -> Column:
    """The folder a trip goes to."""
    key = month_key("pickup_ts")
    if not span.months:
        return F.lit(DEFAULT_MONTH)
    ranges = _runs(span.months)
    inside = key.between(*ranges[0])
    for low, high in ranges[1:]:
        inside = inside | key.between(low, high)
    # lexical order is time order only for six-digit keys
    return F.when(inside & (F.length(key) == 6), key).otherwise(F.lit(DEFAULT_MONTH))


def _runs(months: tuple[str, ...]) -> list[tuple[str, str]]:
    """Consecutive months as (first, last) pairs."""
    runs: list[tuple[str, str]] = []
    for key in months:
        year, month = divmod(int(key), 100)
        before = f"{year - 1:04d}12" if month == 1 else f"{year:04d}{month - 1:02d}"
        if runs and runs[-1][1] == before:
            runs[-1] = (runs[-1][0], key)
        else:
            runs.append((key, key))
    return runs


def routed(clean: DataFrame, span: Span) -> DataFrame:
    return clean.withColumn("pickup_month", route_month(span)).select(*CLEAN_STORED.fieldNames())


def arranged(stored: DataFrame) -> DataFrame:
    """Rows brought together by batch, month and day, and sorted by pickup time.

    Each file then covers few days, so a day query skips files and row groups by their
    min/max. Rebalancing lets AQE merge small days and split one that holds far more
    than its share; no sampling pass over the input is needed. A missing folder value is written as
    an empty one, which is the same folder: columns that are never NULL are in order for the writer
    as they are, and it does not sort the rows again.
    """
    named = stored.withColumns({c: F.coalesce(c, F.lit("")) for c in ("batch_id", "pickup_month")})
    by_day = named.withColumn("_day", F.to_date("pickup_ts")).hint("rebalance", "batch_id", "pickup_month", "_day")
    return by_day.sortWithinPartitions("batch_id", "pickup_month", "pickup_ts").drop("_day")


def table_span(warehouse: Warehouse) -> Span:
    """Span of the loaded batches plus the months the table has folders for: a range, once made, stays."""
    known = [(batch,) for batch in warehouse.values("raw")]
    batches = warehouse.spark.createDataFrame(known, "batch_id string")
    return batch_span(batches).plus([m for m in warehouse.second_values("clean") if m != DEFAULT_MONTH])


def write_clean(warehouse: Warehouse, valid: DataFrame, span: Span, batches: list[str] | str) -> list[str]:
    """Replace whole batches, with every month they touched before; the ledger keeps what they were built from.

    ``valid`` are typed trips: derived columns and fingerprints are added when the rows are in place.
    """
    built = built_from(warehouse, warehouse.batches("raw") if batches == ALL else batches)
    built = {batch: facts | {"span": span.text} for batch, facts in built.items()}
    placed = arranged(valid.withColumn("pickup_month", route_month(span)))
    return warehouse.publish("clean", fingerprinted(enriched(placed)), batches, built=built)


def rehome_default(warehouse: Warehouse, span: Span) -> list[str]:
    """Move ``default`` trips whose month now has a range; returns the batches touched.

    Reads only ``default`` files that may hold such trips, of batches that were routed by another
    span, and rewrites the folders of affected batches only, together with the month folders
    their trips move to.
    """
    ledger = warehouse.state("clean").ledger
    older = {batch for batch, facts in ledger.items() if facts.get("span") != span.text}
    if not older:
        return []
    moved = _rehome(warehouse, span, older, ledger)
    warehouse.annotate("clean", {batch: {"span": span.text} for batch in older})
    return moved


def _rehome(warehouse: Warehouse, span: Span, older: set[str], ledger: dict[str, dict]) -> list[str]:
    doubtful = lambda e: e.values[0] in older and e.values[1] == DEFAULT_MONTH and span.touches(e)
    if not any(doubtful(entry) for entry in warehouse.entries("clean")):
        return []
    clean = warehouse.read_files("clean", doubtful)
    stray = clean.where((F.col("pickup_month") == DEFAULT_MONTH) & (route_month(span) != DEFAULT_MONTH))
    moves = [(row[0], row[1]) for row in stray.select("batch_id", route_month(span)).distinct().collect()]
    if moves:
        batches = sorted({batch for batch, _ in moves})
        slices = sorted({*moves, *((batch, DEFAULT_MONTH) for batch in batches)})
        months = sorted({month for _, month in slices})
        touched = F.struct("batch_id", "pickup_month").isin([F.struct(F.lit(b), F.lit(m)) for b, m in slices])
        rows = warehouse.read("clean", batches=batches).where(F.col("pickup_month").isin(months) & touched).select(*CLEAN.fieldNames())
        warehouse.publish("clean", arranged(routed(rows, span)), slices, built={b: ledger[b] for b in batches})
    return sorted({batch for batch, _ in moves})


def convert_flat_clean(warehouse: Warehouse, flat: DataFrame | None = None) -> bool:
    """Give an unpartitioned clean table the folder layout; False when it has it already.

    The flat files are read from the clean folder itself unless ``flat`` is given. They are
    removed once the new table counts.
    """
    path, files = warehouse.path("clean"), warehouse.files
    if warehouse.exists("clean"):
        return False
    own = flat is None
    if own:
        if not files.exists(path):
            return False
        flat = warehouse.spark.read.schema(CLEAN).parquet(path)
    span = batch_span(flat.select("batch_id").distinct())
    warehouse.publish("clean", arranged(routed(flat.select(*CLEAN.fieldNames()), span)), ALL)
    for name in files.names(path) if own else []:
        if name.startswith(("part-", "_SUCCESS")):
            files.delete(f"{path}/{name}")
    return True


def write_flat_snapshot(warehouse: Warehouse, path: str) -> DataFrame:
    """The clean rows without folders, to compare pruned and full scans; the caller drops it."""
    warehouse.read("clean").select(*CLEAN.fieldNames()).write.mode("overwrite").parquet(path)
    return warehouse.spark.read.schema(CLEAN).parquet(path)


def files_of(warehouse: Warehouse, layer: str = "clean") -> DataFrame:
    """``(batch_id, pickup_month, path, rows, bytes, first_ts, last_ts)`` of the layer's files, from the manifests."""
    files = [(*e.values, *[None] * (2 - len(e.values)), e.path, e.rows, e.bytes, e.first, e.last) for e in warehouse.entries(layer)]
    listed = warehouse.spark.createDataFrame(files, "batch_id string, pickup_month string, path string, rows bigint, bytes bigint, first bigint, last bigint")
    moment = lambda name: F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {name} / 1000000BD)")
    return listed.select("batch_id", "pickup_month", "path", "rows", "bytes", moment("first").alias("first_ts"), moment("last").alias("last_ts"))


def manifest_differences(warehouse: Warehouse, layer: str = "clean") -> DataFrame:
    """Files that the manifests and the file system do not agree on, by presence or size."""
    spark = warehouse.spark
    stored = spark.createDataFrame([(f"{folder}/{name}", size) for folder, name, size in warehouse.listed(layer)], "path string, stored bigint")
    both = files_of(warehouse, layer).join(stored, "path", "full_outer")
    return both.where(~F.col("bytes").eqNullSafe(F.col("stored"))).select("path", "bytes", "stored")


def list_partitions(warehouse: Warehouse) -> DataFrame:
    """One row per month of clean: bounds, rows, files and bytes, without reading a trip."""
    start = F.try_to_date(F.concat(F.nullif(F.col("pickup_month"), F.lit(DEFAULT_MONTH)), F.lit("01")), "yyyyMMdd")
    return (
        files_of(warehouse)
        .groupBy("pickup_month")
        .agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
        .select(
            "pickup_month",
            start.cast("timestamp_ntz").alias("from_ts"),
            F.add_months(start, 1).cast("timestamp_ntz").alias("to_ts"),
            "rows",
            "files",
            "bytes",
        )
    )


def partition_hits(warehouse: Warehouse, start: datetime, end: datetime) -> DataFrame:
    """Months of clean that hold rows of a window, with their row counts.

    Files that lie wholly in the window count by their manifest; only those at its ends are read.
    """
    whole = [(e.values[1], e.rows) for e in warehouse.entries("clean") if e.inside(start, end)]
    ends = warehouse.read_files("clean", lambda e: e.touches(start, end) and not e.inside(start, end))
    counted = in_window(ends, start, end).groupBy("pickup_month").agg(F.count(F.lit(1)).alias("rows_seen"))
    known = warehouse.spark.createDataFrame(whole, "pickup_month string, rows_seen bigint")
    return counted.unionByName(known).groupBy("pickup_month").agg(F.sum("rows_seen").alias("rows_seen"))

