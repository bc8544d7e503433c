"""The end-to-end run."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from tripstrata.operators.batches import DATASET, LoadResult, batch_list, load_months
from tripstrata.operators.checks import Policy, QualityError, enforce, settled, suite_summary, write_run
from tripstrata.operators.marts import MARTS
from tripstrata.operators.windows import DEFAULT_LOOKBACK
from tripstrata.plans.builds import (
    build_clean,
    build_marts,
    build_quarantine,
    check_clean,
    check_sync,
    run_schema_tests,
)
from tripstrata.schemas import LAYERS
from tripstrata.sources.trips import run_moment
from tripstrata.sources.zones import load_zones, read_zones
from tripstrata.storage.warehouse import Warehouse

BUILDS = ("clean", "quarantine", *MARTS)
GROUPS = {"marts": tuple(MARTS)}


@dataclass
class RunReport:
    loads: list[LoadResult] = field(default_factory=list)
    clean_batches: list[str] = field(default_factory=list)
    quarantine_batches: list[str] = field(default_factory=list)
    mart_months: dict[str, list[str]] = field(default_factory=dict)
    failed_tests: int = 0


def selected_builds(select: str | Iterable[str] | None) -> list[str]:
    """Builds by name or group, in order; all of them when nothing is selected."""
    wanted = batch_list(select)
    if not wanted:
        return list(BUILDS)
    names = {name for item in wanted for name in GROUPS.get(item, (item,))}
    unknown = sorted(names - set(BUILDS))
    if unknown:
        raise ValueError(f"unknown builds: {unknown}")
    return [name for name in BUILDS if name in names]


def run_all(
    warehouse: Warehouse,
    months: str | Iterable[str],
    paths: Mapping[str, str],
    *,
    zones_path: str | None = None,
    dataset: str = DATASET,
    replace: bool = False,
    full_refresh: bool = False,
    lookback: object = DEFAULT_LOOKBACK,
    select: str | Iterable[str] | None = None,
    policy: Policy = Policy(),
    report_folder: str | None = None,
    skip_ingest: bool = False,
    skip_build: bool = False,
    skip_tests: bool = False,
    skip_checks: bool = False,
    skip_audit: bool = False,
) -> RunReport:
    """Load zones and months, build, test and check.

    ``replace`` reloads the months and rebuilds exactly them in clean. Quarantine is rebuilt
    in full each time, so that a changed rule applies to all batches. ``full_refresh``
    rebuilds the marts in full; clean stays incremental, as rebuilding it is asked for by
    naming batches. The audit compares the batches that were rebuilt with their source.
    """
    wanted = batch_list(months)
    if not wanted:
        raise ValueError("no months given")
    report = RunReport()
    if not skip_ingest:
        if zones_path:
            load_zones(warehouse, read_zones(warehouse.spark, zones_path))
        report.loads = load_months(warehouse, wanted, paths, dataset, replace)
    if not skip_build:
        builds = selected_builds(select)
        if "clean" in builds:
            report.clean_batches = build_clean(warehouse, wanted if replace else None)
        if "quarantine" in builds:
            report.quarantine_batches = build_quarantine(warehouse)
        marts = [name for name in builds if name in MARTS]
        if marts:
            report.mart_months = build_marts(warehouse, lookback, full_refresh, marts)
    if not skip_tests:
        failures = run_schema_tests(warehouse).where(F.col("failures") > 0).orderBy("table_name", "test", "column_name").collect()
        report.failed_tests = len(failures)
        if failures:
            raise QualityError("; ".join(f"{r[0]}.{r[2]} {r[1]}: {r[3]}" for r in failures))
    if not skip_audit:
        check_sync(warehouse, report.clean_batches)
    if not skip_checks:
        results = settled(check_clean(warehouse, policy)[0])
        if report_folder:
            write_run(warehouse.read("clean"), results, report_folder, LAYERS["clean"].relation, run_moment(), policy)
        enforce(suite_summary(results), policy)
    return report
