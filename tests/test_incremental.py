"""Batch replacement, re-homing and the marts' window on small fixtures."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import FIRST_LOAD, folders, raw_trips, source, trip
from tripstrata.operators.audit import BatchMismatch, assert_in_sync, extra_rows, missing_rows, surplus
from tripstrata.operators.batches import delete_batch, load_batch, load_months
from tripstrata.operators.checks import QualityError
from tripstrata.operators.layout import convert_flat_clean, list_partitions, table_span, write_flat_snapshot
from tripstrata.operators.staging import stage
from tripstrata.operators.windows import MartWindow, in_window, lookback_months, mart_window, months_between
from tripstrata.plans.builds import build_clean, build_mart, build_marts, build_quarantine, staged
from tripstrata.plans.run import run_all, selected_builds
from tripstrata.session import scratch_dir
from tripstrata.storage.warehouse import ALL

LATER = FIRST_LOAD + timedelta(days=1)
JAN = [trip("2024-01", 1, "2024-01-10 10:00"), trip("2024-01", 2, "2024-02-01 09:00")]
FEB = [trip("2024-02", 3, "2024-02-01 09:30"), trip("2024-02", 4, "2024-02-20 08:00")]


def put(warehouse, trips, batches, loaded_at=FIRST_LOAD):
    warehouse.publish("raw", raw_trips(warehouse.spark, trips, loaded_at), batches)


def vendors(warehouse, layer="clean"):
    return sorted(r[0] for r in warehouse.read(layer).select("vendor_id").collect())


def test_replacing_a_batch_leaves_the_other_alone(warehouse):
    put(warehouse, JAN + FEB, ALL)
    assert build_clean(warehouse) == ["2024-01", "2024-02"]
    put(warehouse, JAN[:1], ["2024-01"], LATER)
    assert build_clean(warehouse) == ["2024-01"]
    assert vendors(warehouse) == [1, 3, 4]
    assert folders(warehouse, "clean") == {("2024-01", "202401"), ("2024-02", "202402")}


def test_second_run_does_nothing(warehouse):
    put(warehouse, JAN + FEB, ALL)
    build_clean(warehouse)
    assert build_clean(warehouse) == []
    assert vendors(warehouse) == [1, 2, 3, 4]


def test_batch_without_valid_rows_is_built_once(warehouse):
    put(warehouse, [trip("2024-01", 1, "2024-01-10 10:00", total_amount=-1.0)], ALL)
    assert build_clean(warehouse) == ["2024-01"]
    assert build_clean(warehouse) == []
    assert vendors(warehouse) == []
    put(warehouse, JAN, ["2024-01"], LATER)
    assert build_clean(warehouse) == ["2024-01"]


def test_vanished_batch_stays_until_listed(warehouse):
    put(warehouse, JAN + FEB, ALL)
    build_clean(warehouse)
    assert delete_batch(warehouse, "2024-01") == 2
    assert delete_batch(warehouse, "2024-01") == 0
    assert build_clean(warehouse) == []
    assert vendors(warehouse) == [1, 2, 3, 4]
    build_clean(warehouse, "2024-01")
    assert vendors(warehouse) == [3, 4]


def test_rebuild_all(warehouse):
    put(warehouse, JAN + FEB, ALL)
    build_clean(warehouse)
    delete_batch(warehouse, "2024-02")
    assert build_clean(warehouse, ALL) == ["2024-01", "2024-02"]
    assert vendors(warehouse) == [1, 2]


def test_default_month_is_found_and_rehomed(warehouse):
    far = trip("2024-01", 9, "2024-05-03 10:00")
    ancient = trip("2024-01", 8, "2002-12-31 23:00")
    put(warehouse, JAN + [far, ancient], ALL)
    build_clean(warehouse)
    assert ("2024-01", "default") in folders(warehouse, "clean")
    window = (datetime(2024, 5, 1), datetime(2024, 6, 1))
    assert in_window(warehouse.read("clean"), *window).count() == 1

    put(warehouse, [trip("2024-05", 5, "2024-05-09 10:00")], ["2024-05"])
    assert build_clean(warehouse) == ["2024-05"]
    assert folders(warehouse, "clean") == {
        ("2024-01", "202401"), ("2024-01", "202402"), ("2024-01", "202405"), ("2024-01", "default"), ("2024-05", "202405"),
    }
    assert vendors(warehouse) == [1, 2, 5, 8, 9]
    assert in_window(warehouse.read("clean"), *window).count() == 2
    assert_in_sync(staged(warehouse), warehouse.read("clean"))


def test_ranges_stay_once_made(warehouse):
    put(warehouse, JAN + [trip("2024-03", 6, "2024-04-02 10:00")], ALL)
    build_clean(warehouse)
    delete_batch(warehouse, "2024-03")
    assert "202404" in table_span(warehouse).months


def test_no_batch_month_means_default_only(warehouse):
    put(warehouse, [trip("test", 1, "2024-01-10 10:00"), trip("2024-13", 2, "2024-01-10 10:00")], ALL)
    build_clean(warehouse)
    assert {month for _, month in folders(warehouse, "clean")} == {"default"}


def test_failed_load_keeps_the_old_batch(spark, warehouse):
    good, bad = scratch_dir(spark, "good"), scratch_dir(spark, "bad")
    source(spark, JAN).drop("batch_id").write.mode("overwrite").parquet(good)
    source(spark, JAN).drop("batch_id").withColumn("total_amount", F.lit("?")).write.mode("overwrite").parquet(bad)
    load_batch(warehouse, "2024-01", good)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_batch(warehouse, "2024-01", bad, replace=True)
    assert warehouse.read("raw").count() == 2
    assert warehouse.recover() == {}


def test_failed_swap_is_undone(warehouse, monkeypatch):
    from tripstrata.storage.files import Files

    put(warehouse, JAN + FEB, ALL)
    build_clean(warehouse)
    before = folders(warehouse, "clean")

    def breaks(self, origin, target):
        raise OSError("lost the file system")

    monkeypatch.setattr(Files, "move", breaks)
    with pytest.raises(OSError):
        build_clean(warehouse, ALL)
    monkeypatch.undo()
    assert folders(warehouse, "clean") == before
    assert vendors(warehouse) == [1, 2, 3, 4]
    assert warehouse.recover() == {}


@pytest.mark.parametrize("step", ["_point", "vacuum"])
def test_killed_before_or_after_the_swap(warehouse, monkeypatch, step):
    """Readers see the old or the new table; recovery removes what is left over."""
    put(warehouse, JAN + FEB, ALL)
    build_clean(warehouse)
    put(warehouse, [JAN[0] | {"VendorID": 9}], ["2024-01"], LATER)

    class Killed(BaseException):
        pass

    def stop(self, *args):
        raise Killed

    monkeypatch.setattr(type(warehouse), step, stop)
    with pytest.raises(Killed):
        build_clean(warehouse)
    monkeypatch.undo()
    assert vendors(warehouse) == ([1, 2, 3, 4] if step == "_point" else [3, 4, 9])
    assert list(warehouse.recover()) == (["clean"] if step == "_point" else [])
    assert warehouse.recover() == {}
    assert vendors(warehouse) == ([1, 2, 3, 4] if step == "_point" else [3, 4, 9])
    build_clean(warehouse)
    assert vendors(warehouse) == [3, 4, 9]


def test_one_rename_whatever_the_number_of_slices(warehouse, monkeypatch):
    from tripstrata.storage.files import Files

    moves, move = [], Files.move
    monkeypatch.setattr(Files, "move", lambda self, a, b: (moves.append(b), move(self, a, b)))
    put(warehouse, [trip(f"2024-{m:02d}", m, f"2024-{m:02d}-05 10:00") for m in range(1, 13)], ALL)
    put(warehouse, [trip(f"2024-{m:02d}", m, f"2024-{m:02d}-06 10:00") for m in range(1, 13)], ALL)
    assert len(moves) == 2


def test_rows_outside_the_replaced_slices_are_refused(warehouse):
    with pytest.raises(ValueError, match="outside"):
        put(warehouse, JAN + FEB, ["2024-01"])
    assert warehouse.values("raw") == []


def test_batch_names_with_odd_characters(warehouse):
    put(warehouse, [trip("a/b c=d:%", 1, "2024-01-10 10:00")], ALL)
    assert warehouse.values("raw") == ["a/b c=d:%"]
    build_clean(warehouse)
    build_clean(warehouse, ["a/b c=d:%"])
    assert vendors(warehouse) == [1]


def test_window_replace_equals_full_build_inside_the_window(warehouse, spark):
    put(warehouse, JAN + FEB, ALL)
    build_clean(warehouse)
    build_marts(warehouse)
    put(warehouse, [trip("2024-03", 5, "2024-03-09 10:00"), trip("2024-03", 6, "2024-02-20 11:00")], ["2024-03"])
    build_clean(warehouse)
    months = build_marts(warehouse, lookback=2)["daily_revenue"]
    assert months == ["202402", "202403"]
    partial = {tuple(r) for r in warehouse.read("daily_revenue").collect()}
    build_marts(warehouse, full=True)
    assert partial == {tuple(r) for r in warehouse.read("daily_revenue").collect()}


def test_rows_older_than_the_window_wait_for_a_full_build(warehouse):
    put(warehouse, JAN + FEB + [trip("2024-03", 5, "2024-03-09 10:00")], ALL)
    build_clean(warehouse)
    build_marts(warehouse)
    put(warehouse, JAN + [trip("2024-01", 7, "2024-01-11 10:00")], ["2024-01"], LATER)
    build_clean(warehouse)
    build_marts(warehouse, lookback=2)
    days = {r.trip_date for r in warehouse.read("daily_revenue").collect()}
    assert date(2024, 1, 11) not in days
    build_marts(warehouse, lookback=3)
    assert date(2024, 1, 11) in {r.trip_date for r in warehouse.read("daily_revenue").collect()}


def test_emptied_window_month_vanishes_from_marts(warehouse):
    put(warehouse, JAN + FEB, ALL)
    build_clean(warehouse)
    build_marts(warehouse)
    put(warehouse, [t | {"total_amount": -1.0} for t in JAN[1:] + FEB], ["2024-01", "2024-02"], LATER)
    build_clean(warehouse)
    build_marts(warehouse)
    for layer in ("daily_revenue", "hourly_peak", "daily_zone"):
        assert warehouse.read(layer).count() == 0


def test_outliers_are_in_full_builds_only(warehouse):
    put(warehouse, JAN + [trip("2024-01", 8, "2002-12-31 23:00")], ALL)
    build_clean(warehouse)
    build_marts(warehouse)  # first build is a full one
    assert warehouse.read("daily_revenue").count() == 3
    window = MartWindow(datetime(2024, 1, 1), datetime(2024, 2, 1))
    build_mart(warehouse, "daily_revenue", window)
    assert warehouse.read("daily_revenue").count() == 3


@pytest.mark.parametrize("batches", [["2024-13", "test"], []])
def test_anchor_falls_back_to_this_month(spark, batches):
    found = mart_window(spark.createDataFrame([(b,) for b in batches], "batch_id string"), 1)
    now = datetime.now(timezone.utc)
    assert found.start == datetime(now.year, now.month, 1)


def test_window_of_given_batches(spark):
    batches = spark.createDataFrame([("2024-01",), ("2023-12",), ("2024-13",), ("x",)], "batch_id string")
    assert mart_window(batches) == MartWindow(datetime(2023, 12, 1), datetime(2024, 2, 1))
    assert mart_window(batches, 14).start == datetime(2022, 12, 1)


def test_lookback_values():
    assert [lookback_months(v) for v in (2, "3", 0, -5, "x", "", None, "2.7", "inf")] == [2, 3, 1, 1, 1, 1, 1, 2, 1]


def test_months_between():
    assert months_between(datetime(2023, 11, 1), datetime(2024, 2, 1)) == ["202311", "202312", "202401"]
    assert months_between(datetime(2024, 1, 31), datetime(2024, 2, 1)) == ["202401"]


def test_audit_counts_repeats(warehouse):
    twins = [JAN[0], dict(JAN[0])]
    put(warehouse, twins + FEB, ALL)
    build_clean(warehouse)
    assert_in_sync(staged(warehouse), warehouse.read("clean"))
    clean = warehouse.read("clean")
    with pytest.raises(BatchMismatch, match="2024-01: expected=2 actual=6 missing=0 extra=4; 2024-02: expected=2 actual=6"):
        assert_in_sync(staged(warehouse), clean.unionAll(clean).unionAll(clean))
    with pytest.raises(BatchMismatch, match="missing=1"):
        assert_in_sync(staged(warehouse), clean.dropDuplicates(["row_fingerprint"]))
    assert_in_sync(staged(warehouse), clean.dropDuplicates(["row_fingerprint"]), ["2024-02"])


def test_surplus_is_except_all_counted(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (3, "c"), (4, "d")], "k int, v string")
    counted = {(r.k, r.v): r.n for r in surplus(left, right).collect()}
    assert counted == {(1, "a"): 2, (2, None): 1}
    assert sorted(tuple(r) for r in missing_rows(left, right).collect()) == [(1, "a"), (1, "a"), (2, None)]
    assert sorted(tuple(r) for r in extra_rows(left, right).collect()) == [(3, "c"), (4, "d")]


def test_quarantine_partial_equals_full(warehouse):
    bad = trip("2024-01", 11, "2024-01-10 10:00", minutes=None)
    put(warehouse, JAN + FEB + [bad], ALL)
    build_quarantine(warehouse)
    put(warehouse, [bad | {"VendorID": 12}, JAN[0]], ["2024-01"], LATER)
    put(warehouse, [bad | {"VendorID": 13, "batch_id": "2024-03"}], ["2024-03"], LATER)
    build_quarantine(warehouse, full=False)
    assert vendors(warehouse, "quarantine") == [12, 13]
    delete_batch(warehouse, "2024-03")
    build_quarantine(warehouse, full=False)
    assert vendors(warehouse, "quarantine") == [12]


def test_conversion_of_a_flat_table(warehouse, spark):
    put(warehouse, JAN + FEB, ALL)
    build_clean(warehouse)
    before = {tuple(r) for r in warehouse.read("clean").collect()}
    other = type(warehouse)(spark, scratch_dir(spark, "flat"))
    write_flat_snapshot(warehouse, other.path("clean"))
    assert convert_flat_clean(other) is True
    assert convert_flat_clean(other) is False
    assert {tuple(r) for r in other.read("clean").collect()} == before


def test_partition_listing(warehouse):
    put(warehouse, JAN + FEB + [trip("2024-01", 8, "2002-12-31 23:00")], ALL)
    build_clean(warehouse)
    found = {r.pickup_month: r for r in list_partitions(warehouse).collect()}
    assert {m: r.rows for m, r in found.items()} == {"202401": 1, "202402": 3, "default": 1}
    assert found["202402"].from_ts == datetime(2024, 2, 1) and found["202402"].to_ts == datetime(2024, 3, 1)
    assert found["default"].from_ts is None
    assert all(r.bytes > 0 and r.files > 0 for r in found.values())


# ---------------------------------------------------------------- the whole run


@pytest.fixture()
def files(spark):
    paths = {}
    for month, trips in (("2024-01", JAN), ("2024-02", FEB)):
        paths[month] = scratch_dir(spark, f"file-{month}")
        source(spark, trips).drop("batch_id").write.mode("overwrite").parquet(paths[month])
    return paths


def test_run_twice_and_replace(warehouse, files):
    first = run_all(warehouse, "2024-01,2024-02", files, skip_audit=False)
    assert [r.action for r in first.loads] == ["loaded", "loaded"]
    second = run_all(warehouse, "2024-01,2024-02", files)
    assert [r.action for r in second.loads] == ["skipped", "skipped"] and second.clean_batches == []
    third = run_all(warehouse, "2024-01", files, replace=True, skip_audit=False)
    assert [(r.action, r.deleted, r.rows) for r in third.loads] == [("replaced", 2, 2)]
    assert third.clean_batches == ["2024-01"]
    assert vendors(warehouse) == [1, 2, 3, 4]


def test_run_loads_zones(warehouse, files, spark):
    zones = scratch_dir(spark, "zones")
    spark.createDataFrame([(1, "B", "Z", "S")], "LocationID int, Borough string, Zone string, service_zone string").write.mode(
        "overwrite"
    ).option("header", True).csv(zones)
    run_all(warehouse, "2024-01", files, zones_path=zones, skip_build=True, skip_tests=True, skip_checks=True)
    assert warehouse.read("zones").count() == 1 and vendors_of_raw(warehouse) == [1, 2]


def vendors_of_raw(warehouse):
    return sorted(r[0] for r in warehouse.read("raw").select("vendorid").collect())


def test_run_stages_can_be_skipped(warehouse, files):
    run_all(warehouse, "2024-01", files, select="clean")
    assert warehouse.exists("clean") and not warehouse.exists("quarantine") and not warehouse.exists("daily_zone")
    report = run_all(warehouse, "2024-02", files, skip_ingest=True, select=["marts"], skip_tests=True, skip_checks=True)
    assert set(report.mart_months) == {"daily_revenue", "hourly_peak", "daily_zone"} and report.loads == []
    run_all(warehouse, "2024-02", files, skip_build=True, skip_tests=True, skip_checks=True)
    assert vendors(warehouse) == [1, 2]


def test_run_stops_on_failed_tests_and_suites(warehouse, files, spark):
    put(warehouse, [trip("2024-01", 1, "2024-01-10 10:00", minutes=None)] + JAN, ALL)
    with pytest.raises(QualityError, match="stg.dropoff_ts not_null: 1"):
        run_all(warehouse, "2024-01", files, skip_ingest=True)


def test_run_arguments(warehouse):
    with pytest.raises(ValueError, match="no months"):
        run_all(warehouse, " , ", {})
    with pytest.raises(ValueError, match="unknown builds"):
        selected_builds("gold")
    assert selected_builds("marts,clean") == ["clean", "daily_revenue", "hourly_peak", "daily_zone"]


def test_load_months_in_order(warehouse, files):
    results = load_months(warehouse, ["2024-02", " ", "2024-01"], files)
    assert [r.batch_id for r in results] == ["2024-02", "2024-01"]
    assert stage(warehouse.read("raw")).count() == 4
