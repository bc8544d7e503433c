"""Which batches to load or rebuild, and the load itself."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tripstrata.rules import rules_print
from tripstrata.sources.trips import FILE, ingest_errors, may_reject, raw_from_batched, read_by_schema, rejected, run_moment
from tripstrata.storage.manifest import micros
from tripstrata.storage.warehouse import Warehouse

DATASET = "yellow"


def batch_list(value: str | Iterable[object] | None) -> list[str]:
    """Batch ids from a comma-separated text or a list; trimmed, blanks dropped, order kept."""
    if value is None:
        return []
    parts = value.split(",") if isinstance(value, str) else [str(v) for v in value]
    return list(dict.fromkeys(p.strip() for p in parts if p.strip()))


def has_batch(trips: DataFrame, batch_id: str) -> bool:
    """Existence probe: stops at the first row found."""
    return not trips.where(F.col("batch_id") == batch_id).limit(1).isEmpty()


def latest_load(trips: DataFrame) -> DataFrame:
    return trips.groupBy("batch_id").agg(F.max("ingested_at").alias("loaded_at"))


def changed_batches(source: DataFrame, target: DataFrame) -> DataFrame:
    """Batches absent from the target or loaded later than what the target holds.

    For any two frames of trips: both sides are aggregated to one row per batch before they
    meet. Layers have a ledger, so :func:`stale_batches` reads no trips.
    """
    built = latest_load(target).withColumnRenamed("loaded_at", "built_at")
    newer = F.col("built_at").isNull() | (F.col("loaded_at") > F.col("built_at"))
    return latest_load(source).join(built, "batch_id", "left").where(newer).select("batch_id")


def stale_batches(warehouse: Warehouse, target: str, source: str = "raw") -> list[str]:
    """Batches of ``source`` that ``target`` was not built from, by the ledgers alone.

    A batch is stale when the target never saw it, saw an earlier load of it, or was built
    by another rule list. One that was built and left no rows is not.
    """
    wanted = rules_print()
    built = warehouse.batches(target)
    stale = []
    for batch, facts in warehouse.batches(source).items():
        if batch not in built:
            stale.append(batch)
            continue
        own = built[batch]["built"]
        before = own.get("loaded", built[batch]["loaded"])
        loaded = facts["loaded"]
        if (loaded is not None and (before is None or loaded > before)) or own.get("rules", wanted) != wanted:
            stale.append(batch)
    return stale


def built_from(warehouse: Warehouse, batches: Iterable[str], source: str = "raw") -> dict[str, dict]:
    """Ledger entries of rows built now from these batches of ``source``; batches that left it have none."""
    known = warehouse.batches(source)
    return {batch: {"loaded": known[batch]["loaded"], "rules": rules_print()} for batch in batches if batch in known}


def trips_of(trips: DataFrame, batches: DataFrame | list[str]) -> DataFrame:
    """Trips of the given batches: a list prunes folders, a frame is a semi join."""
    if isinstance(batches, list):
        return trips.where(F.col("batch_id").isin(batches))
    return trips.join(batches, "batch_id", "left_semi")


def distinct_batches(trips: DataFrame) -> DataFrame:
    return trips.where(F.col("batch_id").isNotNull()).select("batch_id").distinct().orderBy("batch_id")


@dataclass(frozen=True)
class LoadResult:
    batch_id: str
    action: str  # loaded, skipped or replaced
    deleted: int = 0
    rows: int = 0
    rejected: int = 0


def delete_batch(warehouse: Warehouse, batch_id: str) -> int:
    """Remove one raw batch; returns how many rows went."""
    held = warehouse.batches("raw")
    if batch_id not in held:
        return 0
    warehouse.publish("raw", warehouse.read("raw").limit(0), [batch_id])
    return held[batch_id]["rows"]


def load_files(warehouse: Warehouse, paths: Mapping[str, str], replace: bool = False, moment: datetime | None = None) -> list[LoadResult]:
    """Load the months' files that are not there; with ``replace``, put all of them in place of what is.

    Files of one schema are read together, and all are written by one job and swapped in by one
    rename: either every month of a call is loaded or none. Rejected values are counted on the
    way; only when there are any does a second job write the error rows, which take the place of
    the batches' earlier ones before the batches themselves are swapped in.
    """
    moment = moment or run_moment()
    before = warehouse.batches("raw")
    wanted = {batch: path for batch, path in paths.items() if replace or batch not in before}
    if wanted:
        sources = read_by_schema(warehouse.spark, wanted)
        watched = [(Observation(), source) for source in sources if may_reject(source)]
        # raw rows do not name their file: looking it up for every row is left to the error rows
        counted = [source.drop(FILE).observe(seen, F.count_if(rejected(source)).alias("rejected")) for seen, source in watched]
        certain = [source.drop(FILE) for source in sources if not may_reject(source)]
        rows = reduce(DataFrame.unionAll, [raw_from_batched(c, moment) for c in counted + certain])

        def replace_errors() -> None:
            bad = [source for seen, source in watched if seen.get["rejected"]]
            if bad:
                errors = reduce(DataFrame.unionAll, [ingest_errors(source, moment) for source in bad])
                warehouse.publish("ingest_errors", errors, list(wanted))
            elif set(wanted) & set(warehouse.values("ingest_errors")):
                warehouse.publish("ingest_errors", warehouse.read("ingest_errors").limit(0), list(wanted))

        # a file without rows is a batch, too: it is there, with no rows
        facts = {batch: {"path": path, "loaded": micros(moment)} for batch, path in wanted.items()}
        warehouse.publish("raw", rows, list(wanted), replace_errors, facts)
    now, errors = warehouse.batches("raw"), warehouse.batches("ingest_errors")
    results = []
    for batch in paths:
        if batch in wanted:
            action, deleted = ("replaced", before[batch]["rows"]) if batch in before else ("loaded", 0)
            results.append(LoadResult(batch, action, deleted, now[batch]["rows"], errors.get(batch, {"rows": 0})["rows"]))
        else:
            results.append(LoadResult(batch, "skipped"))
    return results


def load_batch(warehouse: Warehouse, batch_id: str, path: str, replace: bool = False, moment: datetime | None = None) -> LoadResult:
    """Load one month."""
    return load_files(warehouse, {batch_id: path}, replace, moment)[0]


def load_frame(warehouse: Warehouse, rows: DataFrame, batches: list[str] | str) -> None:
    """Replace the given batches (``ALL``: the table) by raw rows of several batches at once.

    The rows of a batch are brought together first. Otherwise every task would write a
    small file into every batch it has rows of.
    """
    warehouse.publish("raw", rows.hint("rebalance", "batch_id"), batches)


def load_source(warehouse: Warehouse, source: DataFrame, moment: datetime, batches: list[str] | str) -> None:
    """:func:`load_frame` of source rows with a ``batch_id``: they are conformed when a batch's rows are together.

    Raw rows are several times as wide as what most sources have.
    """
    warehouse.publish("raw", raw_from_batched(source.hint("rebalance", "batch_id"), moment), batches)


def load_months(
    warehouse: Warehouse,
    months: str | Iterable[str],
    paths: Mapping[str, str],
    dataset: str = DATASET,
    replace: bool = False,
) -> list[LoadResult]:
    """Load the listed months together."""
    if dataset != DATASET:
        raise ValueError(f"only dataset {DATASET!r} is supported: {dataset!r}")
    return load_files(warehouse, {month: paths[month] for month in batch_list(months)}, replace)
