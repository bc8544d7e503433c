"""Layer builds: clean, quarantine and marts."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.operators.audit import assert_in_sync, audit_batches
from tripstrata.operators.batches import batch_list, built_from, stale_batches
from tripstrata.operators.checks import Policy, evaluate, schema_tests, suite_summary, suites
from tripstrata.operators.layout import rehome_default, table_span, write_clean
from tripstrata.operators.marts import FROM_STATE, MARTS, STATES, mart_of_state, state_months
from tripstrata.operators.staging import quarantined_by_batch, stage, typed, valid_trips
from tripstrata.operators.windows import DEFAULT_LOOKBACK, MartWindow, in_window, mart_window
from tripstrata.schemas import LAYERS, STAGE_RELATION
from tripstrata.storage.manifest import Digest
from tripstrata.storage.warehouse import ALL, Warehouse


def staged(warehouse: Warehouse) -> DataFrame:
    return stage(warehouse.read("raw"))


def trips_between(warehouse: Warehouse, start: datetime, end: datetime) -> DataFrame:
    """Clean trips with pickup in ``[start, end)``, from the files that may hold such."""
    return in_window(warehouse.read_between("clean", start, end), start, end)


def build_clean(warehouse: Warehouse, rebuild: str | Iterable[str] | None = None) -> list[str]:
    """Rebuild changed batches, or the listed ones, or ``ALL``; returns the batches rebuilt.

    What changed is known from the ledgers, so a build with nothing to do reads no trip. A
    listed batch that has no rows any more is removed; a batch that merely vanished from raw
    is kept until it is listed. ``default`` trips
    whose month got a range are re-homed on the way.
    """
    if rebuild == ALL:
        batches = sorted({*warehouse.values("raw"), *warehouse.values("clean")})
    else:
        batches = batch_list(rebuild)
        if not batches:
            batches = stale_batches(warehouse, "clean")
    span = table_span(warehouse)
    rehome_default(warehouse, span)
    if batches:
        rows = valid_trips(typed(warehouse.read("raw")).where(F.col("batch_id").isin(batches)))
        write_clean(warehouse, rows, span, batches)
    return batches


def build_quarantine(warehouse: Warehouse, full: bool = True) -> list[str]:
    """Rebuild quarantine from all staged rows, or from changed batches only.

    The partial build ends with the same rows as the full one while the rules stay the
    same: it redoes each batch that was not seen, was loaded later or was built by other rules,
    and drops batches that left raw.
    """
    trips = typed(warehouse.read("raw"))
    if full:
        warehouse.publish("quarantine", quarantined_by_batch(trips), ALL, built=built_from(warehouse, warehouse.batches("raw")))
        return warehouse.values("raw")
    gone = set(warehouse.batches("quarantine")) - set(warehouse.batches("raw"))
    redo = sorted({*stale_batches(warehouse, "quarantine"), *gone})
    if redo:
        warehouse.publish("quarantine", quarantined_by_batch(trips.where(F.col("batch_id").isin(redo))), redo, built=built_from(warehouse, redo))
    return redo


def _months(mart_rows: DataFrame) -> list[str]:
    return sorted(row[0] for row in mart_rows.select("trip_month").distinct().collect())


def refresh_state(warehouse: Warehouse, layer: str, full: bool = False) -> list[str]:
    """Bring a mart state up to clean: only batches that were written since are read. Returns them.

    A state holds few rows, so it is written whole: those of the other batches are copied.
    """
    versions = {batch: facts.get("version") for batch, facts in warehouse.state("clean").ledger.items()}
    before = {batch: facts["of"] for batch, facts in warehouse.state(layer).ledger.items()}
    changed = sorted(b for b, version in versions.items() if full or before.get(b) != version)
    gone = set(before) - set(versions)
    if changed or gone:
        fresh = STATES[layer](warehouse.read("clean", batches=changed))
        others = warehouse.read(layer).where(~F.col("batch_id").isin([*changed, *gone]))
        fields = LAYERS[layer].schema.fieldNames()
        # what an aggregate leaves is coalesced already; copied rows are brought together with it
        copied = set(before) - {*changed, *gone}
        rows = others.select(*fields).unionByName(fresh.select(*fields)).hint("rebalance") if copied else fresh
        warehouse.publish(layer, rows, ALL, built={b: {"of": version} for b, version in versions.items()})
    return changed


def build_mart(warehouse: Warehouse, name: str, window: MartWindow | None) -> list[str]:
    """Rebuild one mart in full, or replace the window's months; returns the months replaced.

    Marts are added up from what each batch contributes, so trips are read of batches that
    changed and of no others; a full build reads all trips again. A mart holds few rows, so it is
    written whole, as few files: the months outside the window are copied. A mart that was
    never built is built in full.
    """
    layer = FROM_STATE[name][0]
    refresh_state(warehouse, layer, full=window is None)
    return _write_mart(warehouse, name, window)


def _write_mart(warehouse: Warehouse, name: str, window: MartWindow | None) -> list[str]:
    state = warehouse.read(FROM_STATE[name][0])
    if window is None or not warehouse.exists(name):
        warehouse.publish_whole(name, mart_of_state(name, state))
        return _months(warehouse.read(name))
    fresh = mart_of_state(name, state.where(state_months(name).isin(window.months)))
    fields = LAYERS[name].schema.fieldNames()
    others = warehouse.read(name).where(~F.col("trip_month").isin(window.months))
    warehouse.publish_whole(name, others.select(*fields).unionByName(fresh.select(*fields)).hint("rebalance"))
    return window.months


def rolling_window(warehouse: Warehouse, lookback: object = DEFAULT_LOOKBACK) -> MartWindow:
    """The window from the loaded batches; listing them takes no scan."""
    loaded = [(batch,) for batch in warehouse.values("raw")]
    return mart_window(warehouse.spark.createDataFrame(loaded, "batch_id string"), lookback)


def build_marts(
    warehouse: Warehouse, lookback: object = DEFAULT_LOOKBACK, full: bool = False, only: Iterable[str] | None = None
) -> dict[str, list[str]]:
    window = None if full else rolling_window(warehouse, lookback)
    names = [name for name in MARTS if only is None or name in only]
    for layer in dict.fromkeys(FROM_STATE[name][0] for name in names):
        refresh_state(warehouse, layer, full)
    return {name: _write_mart(warehouse, name, window) for name in names}


def audit(warehouse: Warehouse) -> DataFrame:
    """Per batch, rows of clean against what raw says they should be; clean's digests come from its manifests."""
    return audit_batches(staged(warehouse), warehouse.read("clean"), _digests(warehouse))


def check_sync(warehouse: Warehouse, batches: list[str] | None = None) -> None:
    assert_in_sync(staged(warehouse), warehouse.read("clean"), batches, _digests(warehouse))


def _digests(warehouse: Warehouse) -> dict[str, Digest]:
    return {batch: facts["digest"] for batch, facts in warehouse.batches("clean").items()}


def run_schema_tests(warehouse: Warehouse) -> DataFrame:
    marts = {name: warehouse.read(name) for name in MARTS if warehouse.exists(name)}
    return schema_tests({"stg": staged(warehouse), **marts})


def check_clean(warehouse: Warehouse, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """Expectation results and their summary per suite."""
    results = evaluate(warehouse.read("clean"), suites(policy), policy)
    return results, suite_summary(results)


def row_counts(warehouse: Warehouse) -> DataFrame:
    """Rows per relation; NULL for one that was never built. No trip is read."""
    counts = {
        LAYERS[layer].relation: warehouse.row_count(layer) if warehouse.exists(layer) else None
        for layer in ("raw", "clean", "quarantine", "daily_revenue", "hourly_peak")
    }
    # the staged view has exactly the raw rows
    counts[STAGE_RELATION] = counts[LAYERS["raw"].relation]
    return warehouse.spark.createDataFrame(list(counts.items()), "relation string, row_count bigint")


def register_views(warehouse: Warehouse) -> None:
    """Temporary views named like the relations without their schema, for SQL users."""
    for layer in LAYERS:
        warehouse.read(layer).createOrReplaceTempView(LAYERS[layer].relation.split(".")[1])
    staged(warehouse).createOrReplaceTempView(STAGE_RELATION.split(".")[1])

