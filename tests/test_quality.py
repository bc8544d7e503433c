"""Tolerance semantics on counts from stored results, policy, samples and rule laws."""

from __future__ import annotations

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import raw_trips, source, trip
from tripstrata.operators import checks
from tripstrata.operators.checks import (
    Policy,
    QualityError,
    between,
    duplicate_keys,
    enforce,
    evaluate,
    fail_decision,
    in_set,
    null_counts,
    pair_not_below,
    read_runs,
    run_results,
    settled,
    suite_summary,
    suites,
    unexpected_sample,
    write_results,
    write_run,
)
from tripstrata.operators.staging import clean_trips, quarantined_trips, stage, with_reason
from tripstrata.plans.builds import build_clean
from tripstrata.plans.run import run_all
from tripstrata.storage.warehouse import ALL

META = {"severity": "critical", "domain": "d", "rationale": "r"}


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def codes(spark, total: int, missing: int, unexpected: int):
    """``total`` rows of which some miss the value and some hold code 9."""
    value = F.when(F.col("id") < missing, F.lit(None)).when(F.col("id") < missing + unexpected, F.lit(9)).otherwise(F.lit(1))
    return spark.range(total).select(value.alias("code"))


@pytest.mark.parametrize(("mostly", "success"), [(0.999, False), (0.95, True)])
def test_four_percent_unexpected(spark, mostly, success):
    found = only(evaluate(codes(spark, 2_872_094, 0, 117_287), (in_set("code", (1, 2), mostly=mostly, **META),)))
    assert found.unexpected_percent == pytest.approx(4.08367553429658)
    assert found.success is success


def test_missing_rows_leave_the_denominator(spark):
    found = only(evaluate(codes(spark, 2_872_094, 117_287, 1), (between("code", low=0, high=8, mostly=0.999, **META),)))
    assert (found.element_count, found.missing_count, found.unexpected_count) == (2_872_094, 117_287, 1)
    assert found.unexpected_percent == pytest.approx(3.630018e-05, rel=1e-6)
    assert found.unexpected_percent_total == pytest.approx(3.481780e-05, rel=1e-6)
    assert found.success


def test_column_without_values_passes(spark):
    found = only(evaluate(codes(spark, 5, 5, 0), (between("code", low=0, **META),)))
    assert found.success and found.unexpected_percent is None and found.missing_percent == 100.0


def test_empty_table_passes(spark):
    found = evaluate(clean_trips(stage(raw_trips(spark, [trip("2024-01", 1, "2024-01-01 10:00")]))).limit(0), suites(Policy()))
    assert all(r.success and r.element_count == 0 for r in found.collect())


def test_exactly_at_the_tolerance(spark):
    assert only(evaluate(codes(spark, 1000, 0, 1), (in_set("code", (1,), mostly=0.999, **META),))).success
    assert not only(evaluate(codes(spark, 1000, 0, 2), (in_set("code", (1,), mostly=0.999, **META),))).success


def test_zero_duration_passes_the_loose_pair_only(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01' as a, timestamp_ntz'2024-01-01' as b union all select null, timestamp_ntz'2024-01-01'")
    loose = only(evaluate(df, (pair_not_below("a", "b", **META),)))
    strict = only(evaluate(df, (pair_not_below("a", "b", or_equal=False, **META),)))
    assert (loose.success, loose.missing_count) == (True, 1)
    assert (strict.success, strict.unexpected_count) == (False, 1)


def test_sample_is_capped_and_counted(spark):
    found = unexpected_sample(codes(spark, 351_861, 0, 351_861), (in_set("code", (1,), **META),)).collect()
    assert [(r.value, r.sample_count) for r in found] == [("9", 20)]


def test_policy(spark):
    rows = "'critical' as severity, 'c' as suite, 'v1' as suite_version, {} as success"
    ok_critical = spark.sql(f"select {rows.format('true')}")
    bad_critical = spark.sql(f"select {rows.format('false')}")
    warning = rows.replace("critical", "warning").replace("'c'", "'w'")
    ok_warning, bad_warning = (spark.sql(f"select {warning.format(s)}") for s in ("true", "false"))

    enforce(suite_summary(ok_critical.unionAll(bad_warning)))
    with pytest.raises(QualityError, match="w: 1 failed"):
        enforce(suite_summary(ok_critical.unionAll(bad_warning)), Policy(fail_on_warning=True))
    with pytest.raises(QualityError, match="c: 1 failed"):
        enforce(suite_summary(bad_critical.unionAll(ok_warning)))
    enforce(suite_summary(bad_critical.unionAll(ok_warning)), Policy(fail_on_critical=False))


def test_no_result_is_a_failure(spark):
    empty = spark.createDataFrame([], "severity string, suite string, suite_version string, success boolean")
    with pytest.raises(QualityError, match="no result"):
        enforce(suite_summary(empty))
    unknown = spark.sql("select 'critical' as severity, 'c' as suite, 'v1' as suite_version, cast(null as boolean) as success")
    assert only(fail_decision(suite_summary(unknown))).blocks_run


def test_suite_names():
    policy = Policy(critical_version="2", warning_version=" ")
    assert policy.suite("critical") == "clean_yellow_trips__critical__v2"
    assert policy.suite("warning") == "clean_yellow_trips__warning__v1"
    assert [e.severity for e in suites(policy)].count("critical") == 6


def test_results_as_json(spark, tmp_path):
    trips = clean_trips(stage(raw_trips(spark, [trip("2024-01", 1, "2024-01-01 10:00")])))
    results = evaluate(trips, suites(Policy()))
    write_results(results, suite_summary(results), str(tmp_path))
    assert spark.read.json(f"{tmp_path}/results/severity=critical").count() == 6
    assert spark.read.json(f"{tmp_path}/summary").count() == 2


def test_null_counts_and_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, 2), (None, 2), (None, None)], "a int, b int")
    assert {r.column_name: r.failures for r in null_counts(df, ["a", "b"]).collect()} == {"a": 2, "b": 2}
    assert [(r.a, r.n) for r in duplicate_keys(df, ["a"]).collect()] == [(1, 2)]
    assert duplicate_keys(df, ["a", "b"]).collect() == []


# ---------------------------------------------------------------- rules

CASES = [
    (dict(), None),
    (dict(payment_type=None, RatecodeID=None), None),
    (dict(RatecodeID=99.0, payment_type=0), None),
    (dict(tpep_dropoff_datetime=None, total_amount=-1.0), "missing_datetime"),
    (dict(tpep_dropoff_datetime="2024-01-01 09:59", PULocationID=None), "negative_duration"),
    (dict(DOLocationID=None, trip_distance=0.0), "missing_location"),
    (dict(trip_distance=0.0, total_amount=None), "invalid_distance"),
    (dict(trip_distance=None), "invalid_distance"),
    (dict(total_amount=-0.01, payment_type=7), "invalid_total_amount"),
    (dict(payment_type=7, RatecodeID=7.0), "invalid_payment_type"),
    (dict(RatecodeID=7.0, trip_distance=900.0), "invalid_rate_code"),
    (dict(trip_distance=900.0), "unrealistic_speed"),
    (dict(tpep_dropoff_datetime="2024-01-01 10:00"), None),
]


@pytest.mark.parametrize(("changes", "reason"), CASES)
def test_first_broken_rule_wins(spark, changes, reason):
    staged = stage(raw_trips(spark, [trip("2024-01", 1, "2024-01-01 10:00", **changes)]))
    assert only(with_reason(staged)).reason_code == reason
    assert clean_trips(staged).count() == int(reason in (None, "unrealistic_speed"))
    assert quarantined_trips(staged).count() == int(reason is not None)


def test_speed_limit_itself_is_fine(spark):
    staged = stage(raw_trips(spark, [trip("2024-01", 1, "2024-01-01 10:00", minutes=60, trip_distance=200.0)]))
    row = only(with_reason(staged))
    assert (row.avg_speed_kmh, row.reason_code) == (200.0, None)


def test_zero_duration_has_no_speed(spark):
    staged = stage(raw_trips(spark, [trip("2024-01", 1, "2024-01-01 10:00", minutes=0)]))
    row = only(clean_trips(staged))
    assert row.avg_speed_kmh is None and row.trip_duration_sec == 0


# ---------------------------------------------------------------- run documents


def scans(df) -> int:
    return len(re.findall(r"Scan parquet|FileScan", df._jdf.queryExecution().executedPlan().toString()))


def test_run_document(spark, warehouse, tmp_path):
    rows = [trip("2024-01", n, f"2024-01-{n:02d} 10:00", payment_type=0 if n % 2 else 1) for n in range(1, 11)]
    warehouse.publish("raw", raw_trips(spark, rows), ALL)
    build_clean(warehouse)
    clean, policy, folder = warehouse.read("clean"), Policy(), str(tmp_path / "reports")
    results = evaluate(clean, suites(policy), policy)
    assert scans(results) == 1
    results = settled(results)
    assert scans(results) == 0
    first = write_run(clean, results, folder, "t", datetime(2024, 6, 1), policy)
    with pytest.raises(FileExistsError):
        write_run(clean, results, folder, "t", datetime(2024, 6, 1), policy)
    write_run(clean, results, folder, "t", datetime(2024, 6, 2, 3), Policy(fail_on_warning=True))
    (tmp_path / "reports" / ".draft-x").mkdir()
    runs = {r.run: r for r in read_runs(spark, folder).collect()}
    assert list(runs) == ["20240601T000000000000", "20240602T030000000000"] and first.endswith("run=20240601T000000000000")
    one = runs["20240601T000000000000"]
    assert (one.run_time, one.table_name, one.success, one.blocked) == ("2024-06-01T00:00:00", "t", False, False)
    assert runs["20240602T030000000000"].blocked
    assert [(s.severity, s.evaluated_expectations, s.failed_expectations, len(s.results)) for s in one.suites] == [("critical", 6, 0, 6), ("warning", 3, 1, 3)]
    payment = one.suites[1].results[2]
    assert [(v.value, v.sample_count) for v in payment.unexpected] == [("0", 5)] and payment.unexpected_percent == 50.0
    assert all(r.unexpected == [] for s in one.suites for r in s.results if r.position != payment.position)
    table = run_results(read_runs(spark, folder))
    assert table.count() == 18 and {"suite_success", "success", "blocks_run", "unexpected"} <= set(table.columns)


def test_report_of_a_whole_run(spark, warehouse, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    source(spark, [trip("2024-01", 1, "2024-01-05 10:00")]).drop("batch_id").write.parquet(path)
    run_all(warehouse, "2024-01", {"2024-01": path}, report_folder=folder)
    (run,) = read_runs(spark, folder).collect()
    assert run.success and not run.blocked and run.table_name == "clean.clean_yellow_trips"


def test_unexpected_lists_need_no_second_scan_when_there_are_none(spark, tmp_path, monkeypatch):
    trips = clean_trips(stage(raw_trips(spark, [trip("2024-01", 1, "2024-01-01 10:00")])))
    monkeypatch.setattr(checks, "unexpected_sample", lambda *a: pytest.fail("read again"))
    write_run(trips, settled(evaluate(trips, suites(Policy()))), str(tmp_path), "t", datetime(2024, 6, 1))


def test_merges_of_the_sample_are_bounded(spark):
    rows = spark.range(0, 5000, 1, 40).select((F.col("id") % 977).alias("code"))
    found = unexpected_sample(rows, (between("code", high=-1, **META),), 3)
    assert [(r.value, r.sample_count) for r in found.orderBy("value").collect()] == [("0", 3)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # a limit per task, per merger, and in all
    assert plan.count("WindowGroupLimit") >= 3 and "hashpartitioning(position" in plan
