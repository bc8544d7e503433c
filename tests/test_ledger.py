"""Ledger, manifests, digests, earlier versions, joint loads and per-batch mart states."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import FIRST_LOAD, raw_trips, source, trip
from tripstrata import rules
from tripstrata.operators import batches as B
from tripstrata.operators.audit import BatchMismatch, missing_rows, repeated
from tripstrata.operators.batches import delete_batch, load_files, load_months, stale_batches
from tripstrata.operators.layout import files_of, list_partitions, manifest_differences, partition_hits, table_span
from tripstrata.operators.marts import MARTS, STATES, mart, mart_of_state
from tripstrata.operators.windows import MartWindow, in_window, month_window
from tripstrata.plans import workload as W
from tripstrata.plans.builds import audit, build_clean, build_mart, build_marts, build_quarantine, check_sync, refresh_state, row_counts, trips_between
from tripstrata.session import scratch_dir
from tripstrata.storage.manifest import Digest, digest_columns, micros
from tripstrata.storage.warehouse import ALL, Warehouse

LATER = FIRST_LOAD + timedelta(days=1)
JAN = [trip("2024-01", 1, "2024-01-10 10:00"), trip("2024-01", 2, "2024-02-01 09:00")]
FEB = [trip("2024-02", 3, "2024-02-01 09:30"), trip("2024-02", 4, "2024-02-20 08:00")]


def put(warehouse, trips, batches, loaded_at=FIRST_LOAD):
    warehouse.publish("raw", raw_trips(warehouse.spark, trips, loaded_at), batches)


@pytest.fixture()
def built(warehouse):
    put(warehouse, JAN + FEB, ALL)
    build_clean(warehouse)
    build_quarantine(warehouse)
    return warehouse


def no_reading(monkeypatch):
    def stop(*args, **kwargs):
        raise AssertionError("trips are read")

    monkeypatch.setattr(Warehouse, "_frame", stop)


# ---------------------------------------------------------------- ledger


def test_nothing_changed_reads_no_trip(built, monkeypatch):
    build_quarantine(built, full=False)
    no_reading(monkeypatch)
    assert build_clean(built) == []
    assert stale_batches(built, "clean") == stale_batches(built, "quarantine") == []
    monkeypatch.undo()


def test_far_trips_are_not_read_again(built, monkeypatch):
    put(built, JAN + [trip("2024-01", 9, "2025-05-03 10:00"), trip("2024-01", 8, "2002-12-31 23:00")], ["2024-01"], LATER)
    assert build_clean(built) == ["2024-01"]
    no_reading(monkeypatch)
    assert build_clean(built) == []


def test_changed_rules_mark_all_batches(built, monkeypatch):
    monkeypatch.setattr(B, "rules_print", lambda: rules.rules_print(rules.RULES[:-1]))
    assert stale_batches(built, "clean") == ["2024-01", "2024-02"]
    assert build_clean(built) == ["2024-01", "2024-02"]
    assert build_clean(built) == []


def test_ledger_of_batches(built):
    held = built.batches("raw")
    assert {b: (f["rows"], f["loaded"]) for b, f in held.items()} == {b: (2, micros(FIRST_LOAD)) for b in ("2024-01", "2024-02")}
    clean = built.batches("clean")
    assert {b: f["built"]["loaded"] for b, f in clean.items()} == {b: micros(FIRST_LOAD) for b in held}
    want = built.read("clean").where("batch_id = '2024-01'").agg(*digest_columns(F.col("row_fingerprint"))).first()
    assert clean["2024-01"]["digest"] == Digest(*want)


def test_a_batch_can_hold_no_rows(spark, warehouse):
    path = scratch_dir(spark, "empty")
    source(spark, JAN).drop("batch_id").limit(0).write.mode("overwrite").parquet(path)
    paths = {"2024-01": path}
    assert [(r.action, r.rows) for r in load_files(warehouse, paths)] == [("loaded", 0)]
    assert [r.action for r in load_files(warehouse, paths)] == ["skipped"]
    assert build_clean(warehouse) == ["2024-01"] and build_clean(warehouse) == []


# ---------------------------------------------------------------- earlier versions


def test_a_frame_outlives_a_write(built):
    before, days = built.read("clean"), trips_between(built, datetime(2024, 1, 1), datetime(2024, 3, 1))
    for n in range(3):
        put(built, JAN[:1], ["2024-01"], LATER + timedelta(days=n))
        assert build_clean(built) == ["2024-01"]
        assert built.read("clean").count() == 3
    assert before.count() == days.count() == 4
    assert [built.read("clean", as_of=v).count() for v in built.versions("clean")] == [4, 3, 3, 3]
    assert [built.batches("raw")["2024-01"]["rows"], built.row_count("raw")] == [1, 3]


def test_vacuum_keeps_the_last_versions_and_the_grace_time(built):
    for n in range(3):
        put(built, JAN[:1], ["2024-01"], LATER + timedelta(days=n))
        build_clean(built)
    assert built.vacuum(["clean"]) == {}
    assert built.vacuum(["clean"], keep=2, grace=timedelta(0)) == {"clean": [1, 2]}
    assert built.versions("clean") == [3, 4]
    with pytest.raises(ValueError, match="version 1 is not there"):
        built.read("clean", as_of=1)
    assert [built.read("clean", as_of=v).count() for v in (3, 4)] == [3, 3]
    assert len(built.files.folders(built._data("clean"))) == len(built.files.names(f"{built.path('clean')}/_manifest")) == 3
    assert built.recover() == {}
    # February lies in the first generation still
    assert sorted(r[0] for r in built.read("clean").select("vendor_id").collect()) == [1, 3, 4]
    impatient = Warehouse(built.spark, built.root, keep=1, grace=timedelta(0))
    put(impatient, JAN, ["2024-01"], LATER + timedelta(days=9))
    assert impatient.versions("raw") == [max(impatient.versions("raw"))]


def test_a_version_is_written_once(built):
    state = built.state("clean")
    with pytest.raises(RuntimeError, match="another run"):
        built._point("clean", state)


# ---------------------------------------------------------------- manifests


def test_manifest_agrees_with_the_files(built):
    assert manifest_differences(built).isEmpty()
    rows = {(r.p, r.n, r.low, r.high) for r in files_of(built).selectExpr("path p", "rows n", "first_ts low", "last_ts high").collect()}
    found = built.read("clean").groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n"), F.min("pickup_ts").alias("a"), F.max("pickup_ts").alias("b"))
    assert rows == {(r.f.split("/gen=", 1)[1].split("/", 1)[1], r.n, r.a, r.b) for r in found.collect()}
    victim = built.listed("clean")[0]
    generation = next(iter(built.state("clean").live))
    built.files.delete(f"{built._data('clean')}/gen={generation}/{victim[0]}/{victim[1]}")
    assert [r.path for r in manifest_differences(built).collect()] == [f"{victim[0]}/{victim[1]}"]


def test_reports_read_no_trip(built, monkeypatch):
    found = {r.pickup_month: (r.rows, r.files > 0, r.bytes > 0) for r in list_partitions(built).collect()}
    assert found == {"202401": (1, True, True), "202402": (3, True, True)}
    assert "Scan parquet" not in list_partitions(built)._jdf.queryExecution().executedPlan().toString()
    assert {r.pickup_month: r.rows_seen for r in partition_hits(built, datetime(2024, 1, 1), datetime(2024, 2, 1, 9, 15)).collect()} == {"202401": 1, "202402": 1}
    no_reading(monkeypatch)
    counts = {r.relation: r.row_count for r in row_counts(built).collect()}
    assert counts["raw.yellow_trips"] == counts["clean.clean_yellow_trips"] == 4 and counts["marts.marts_hourly_peak"] is None


def test_a_day_opens_only_its_files(built):
    far = [trip("2024-03", 5, f"2024-03-{d:02d} 10:00") for d in range(1, 29)]
    put(built, far, ["2024-03"])
    build_clean(built)
    start, end = datetime(2024, 2, 1), datetime(2024, 2, 2)
    day = trips_between(built, start, end)
    opened = {e.path for e in built.entries("clean") if e.touches(start, end)}
    assert {p.split("/")[1] for p in opened} == {"pickup_month=202402"}
    assert len(day.inputFiles()) == len(opened) < len(built.entries("clean"))
    assert sorted(r[0] for r in W.top_pickup_zones(day, start, end).select("trips").collect()) == [2]
    assert in_window(built.read("clean"), start, end).count() == day.count() == 2


def test_odd_folder_names_are_found(warehouse):
    put(warehouse, [trip("a/b c=d:%", 1, "2024-01-10 10:00")], ALL)
    build_clean(warehouse)
    assert trips_between(warehouse, datetime(2024, 1, 10), datetime(2024, 1, 11)).count() == 1
    assert warehouse.batches("clean")["a/b c=d:%"]["rows"] == 1
    assert manifest_differences(warehouse).isEmpty()


# ---------------------------------------------------------------- digests


def test_audit_recounts_only_what_differs(built, monkeypatch):
    check_sync(built)
    put(built, FEB + [dict(FEB[0])], ["2024-02"], LATER)
    looked = []
    from tripstrata.operators import audit as A

    recount = A.recount
    monkeypatch.setattr(A, "recount", lambda s, c: (looked.append({r[0] for r in s.select("batch_id").distinct().collect()}), recount(s, c))[1])
    found = {r.batch_id: tuple(r)[1:] for r in audit(built).collect()}
    assert found == {"2024-01": (2, 2, 0, 0), "2024-02": (3, 2, 1, 0)}
    assert looked == [{"2024-02"}]
    with pytest.raises(BatchMismatch, match="2024-02: expected=3 actual=2"):
        check_sync(built)
    check_sync(built, ["2024-01"])
    delete_batch(built, "2024-02")
    assert {r.batch_id: tuple(r)[1:] for r in audit(built).collect()}["2024-02"] == (0, 2, 0, 2)


def test_digests_add_up(spark):
    rows = spark.range(1000).selectExpr("id % 7 as k", "md5(cast(id % 300 as string)) as f")
    whole = Digest(*rows.agg(*digest_columns(F.col("f"))).first())
    parts = [Digest(*r[1:]) for r in rows.groupBy("k").agg(*digest_columns(F.col("f"))).collect()]
    assert sum(parts, Digest()) == whole
    assert Digest(*rows.where("k < 0").agg(*digest_columns(F.col("f"))).first()) == Digest()
    swapped = rows.withColumn("f", F.when(F.col("k") == 1, F.lit("x")).otherwise(F.col("f")))
    assert Digest(*swapped.agg(*digest_columns(F.col("f"))).first()) != whole


def test_copies_of_one_row_are_written_by_several_tasks(spark):
    one = spark.createDataFrame([("a", 1_000_000), ("b", 3), ("c", 0)], "k string, n bigint").where("n > 0")
    spread = repeated(one, copies_per_task=50_000)
    assert {r.k: r["count"] for r in spread.groupBy("k").count().collect()} == {"a": 1_000_000, "b": 3}
    tasks = spread.where("k = 'a'").groupBy(F.spark_partition_id().alias("t")).count().collect()
    assert len(tasks) > 3 and max(r["count"] for r in tasks) < 600_000
    left = spark.createDataFrame([(1, None)] * 5 + [(2, "x")], "k int, v string")
    assert sorted(map(tuple, missing_rows(left, left.limit(2)).collect()), key=str) == sorted(map(tuple, left.exceptAll(left.limit(2)).collect()), key=str)


# ---------------------------------------------------------------- joint loads


def test_months_of_differing_schemas_load_in_one_job(spark, warehouse, monkeypatch):
    shapes = {
        "2024-01": lambda d: d,
        "2024-02": lambda d: d.drop("tip_amount").withColumn("PULocationID", F.col("PULocationID").cast("string")),
        "2024-03": lambda d: d,
        "2024-04": lambda d: d.withColumn("RatecodeID", F.lit(1.5)).withColumn("batch_id", F.lit("not this one")),
    }
    paths = {}
    for n, (month, shape) in enumerate(shapes.items()):
        paths[month] = f"{scratch_dir(spark, 'month')}/a b%20{n}"
        shape(source(spark, [trip(month, 10 * n + i, f"{month}-05 10:00") for i in range(n + 1)]).drop("batch_id")).write.parquet(paths[month])
    # one is a single file instead of a folder
    name = next(n for n in warehouse.files.names(paths["2024-03"]) if n.startswith("part-"))
    folder = paths["2024-03"]
    frames = [n for n in warehouse.files.names(folder) if n.startswith("part-")]
    if len(frames) == 1:
        paths["2024-03"] = f"{folder}/{name}"
    writes, publish = [], Warehouse.publish
    monkeypatch.setattr(Warehouse, "publish", lambda self, layer, *a, **k: (writes.append(layer), publish(self, layer, *a, **k))[1])
    results = load_months(warehouse, list(shapes), paths)
    assert writes == ["raw", "ingest_errors"]
    assert [(r.batch_id, r.action, r.rows, r.rejected) for r in results] == [(m, "loaded", n + 1, 4 if n == 3 else 0) for n, m in enumerate(shapes)]
    found = {r.vendorid: r for r in warehouse.read("raw").collect()}
    assert {v: r.batch_id for v, r in found.items()} == {10 * n + i: m for n, m in enumerate(shapes) for i in range(n + 1)}
    assert found[10].tip_amount is None and found[10].pulocationid == 1 and found[0].tip_amount == 1
    errors = warehouse.read("ingest_errors").collect()
    assert {(e.batch_id, e.source_file) for e in errors} == {("2024-04", paths["2024-04"])}
    again = load_months(warehouse, ["2024-04", "2024-01"], paths, replace=True)
    assert [(r.batch_id, r.action, r.deleted, r.rows) for r in again] == [("2024-04", "replaced", 4, 4), ("2024-01", "replaced", 1, 1)]
    assert [r.action for r in load_months(warehouse, ["2024-02"], paths)] == ["skipped"]


def test_one_file_for_several_months(spark, warehouse):
    path = scratch_dir(spark, "twice")
    source(spark, JAN).drop("batch_id").write.mode("overwrite").parquet(path)
    assert [r.rows for r in load_files(warehouse, {"2024-01": path, "2024-02": path})] == [2, 2]
    assert sorted(r[0] for r in warehouse.read("raw").select("batch_id").collect()) == ["2024-01"] * 2 + ["2024-02"] * 2


# ---------------------------------------------------------------- mart states


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_states_add_up_to_the_marts(built):
    build_marts(built)
    for name in MARTS:
        whole = mart(name, built.read("clean"))
        assert rows_of(built.read(name)) == rows_of(whole.select(*built.read(name).columns))


def test_only_changed_batches_are_read(built, monkeypatch):
    build_marts(built)
    read, publish = [], Warehouse.read
    monkeypatch.setattr(Warehouse, "read", lambda self, layer, *a, **k: (read.append((layer, k.get("batches"))), publish(self, layer, *a, **k))[1])
    put(built, [trip("2024-03", 5, "2024-03-09 10:00"), trip("2024-03", 6, "2024-02-20 11:00")], ["2024-03"])
    put(built, FEB[:1], ["2024-02"], LATER)
    build_clean(built)
    read.clear()
    assert build_marts(built, lookback=2)["daily_zone"] == ["202402", "202403"]
    assert [r for r in read if r[0] == "clean"] == [("clean", ["2024-02", "2024-03"])] * 2
    read.clear()
    build_marts(built, lookback=2)
    assert not [r for r in read if r[0] == "clean"]
    partial = {name: rows_of(built.read(name)) for name in MARTS}
    build_marts(built, full=True)
    assert partial == {name: rows_of(built.read(name)) for name in MARTS}


def test_a_batch_that_goes_is_subtracted(built):
    build_marts(built)
    delete_batch(built, "2024-01")
    build_clean(built, "2024-01")
    assert refresh_state(built, "hour_state") == []
    assert {r.batch_id for r in built.read("hour_state").collect()} == {"2024-02"}
    build_mart(built, "hourly_peak", month_window(datetime(2024, 2, 20), 2))
    assert rows_of(built.read("hourly_peak")) == rows_of(mart("hourly_peak", built.read("clean")).select(*built.read("hourly_peak").columns))


def test_rehoming_leaves_the_states(built):
    put(built, [*JAN, trip("2024-01", 9, "2024-05-03 10:00")], ["2024-01"], LATER)
    build_clean(built)
    build_marts(built)
    put(built, [trip("2024-05", 5, "2024-05-09 10:00")], ["2024-05"])
    assert build_clean(built) == ["2024-05"]
    assert refresh_state(built, "zone_state") == ["2024-05"]
    assert ("2024-01", "202405") in built.slices("clean", 2) and "202406" in table_span(built).months


@pytest.mark.parametrize("name", sorted(STATES))
def test_states_take_one_shuffle(built, name):
    text = STATES[name](built.read("clean"))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert mart_of_state("hourly_peak", built.read("hour_state")).columns == ["pickup_hour", "hr", "trips", "trip_month"]


def test_month_windows():
    assert month_window(datetime(2024, 1, 31), 2) == MartWindow(datetime(2023, 12, 1), datetime(2024, 2, 1))
    assert month_window(datetime(2023, 12, 1), 1) == MartWindow(datetime(2023, 12, 1), datetime(2024, 1, 1))
