from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import source, trip
from tripstrata.operators.batches import batch_list, load_batch, load_months
from tripstrata.operators.staging import stage, with_reason
from tripstrata.schemas import RUN_LOG, SOURCE_TYPES
from tripstrata.session import scratch_dir, shuffle_partitions_for
from tripstrata.operators.timings import compare_files, resolve_files
from tripstrata.sources.runlog import list_run_logs, parse_log_name, read_run_logs, write_run_log
from tripstrata.sources.trips import conform
from tripstrata.sources.zones import conform_zones, load_zones, read_zones


def test_conform_mixed_case_and_missing(spark):
    found = conform(source(spark, [trip("2024-01", 7, "2024-01-05 10:00:00")]))
    assert found.columns == list(SOURCE_TYPES)
    assert {f.name: f.dataType for f in found.schema} == SOURCE_TYPES
    row = found.first()
    assert row.vendorid == 7 and row.cbd_congestion_fee is None and row.extra is None


@pytest.mark.parametrize(
    ("text", "code"),
    [("1", 1), ("1.0", 1), ("1.5", None), ("x", None), ("", None), (" 3 ", 3), ("1e2", 100), ("1d", None), (None, None),
     ("9007199254740993", 9007199254740993), ("1e30", None), ("-4", -4), ("nan", None)],
)
def test_text_codes(spark, text, code):
    df = spark.createDataFrame([(text,)], "PULocationID string")
    assert conform(df).first().pulocationid == code


@pytest.mark.parametrize(("number", "code"), [(1.0, 1), (1.5, None), (float("nan"), None), (float("inf"), None), (1e30, None)])
def test_fractional_codes(spark, number, code):
    df = spark.createDataFrame([(number,)], "RatecodeID double")
    assert conform(df).first().ratecodeid == code


def test_instants_read_as_utc(spark):
    df = spark.sql("select timestamp'2024-01-01 12:00:00+02:00' as tpep_pickup_datetime")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert conform(df).first().tpep_pickup_datetime == datetime(2024, 1, 1, 10)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_bad_amount_fails_the_load(spark, warehouse):
    path = scratch_dir(spark, "bad")
    spark.createDataFrame([("abc",)], "total_amount string").write.mode("overwrite").parquet(path)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_batch(warehouse, "2024-01", path)
    assert warehouse.values("raw") == []


def test_rejected_codes_are_logged_and_rows_kept(spark, warehouse):
    path = scratch_dir(spark, "codes")
    rows = [("1", 1.5), ("x", 1.0), ("2", 2.0), (None, float("nan"))]
    spark.createDataFrame(rows, "PULocationID string, RatecodeID double").write.mode("overwrite").parquet(path)
    result = load_batch(warehouse, "2024-01", path)
    assert (result.rows, result.rejected) == (4, 2)
    assert warehouse.read("raw").count() == 4
    errors = {r.error_reason for r in warehouse.read("ingest_errors").collect()}
    assert errors == {"not a whole number: ratecodeid", "not a whole number: pulocationid"}


def test_zone_header(spark, warehouse):
    folder = scratch_dir(spark, "zones")
    df = spark.createDataFrame([("1", "B", None, "S")], "a string, b string, c string, d string").toDF(
        " LocationID", "BOROUGH ", "Zone", "service_zone"
    )
    df.write.mode("overwrite").option("header", True).csv(folder)
    load_zones(warehouse, read_zones(spark, folder))
    load_zones(warehouse, read_zones(spark, folder))
    assert [tuple(r) for r in warehouse.read("zones").collect()] == [(1, "B", None, "S")]


def test_zone_errors(spark, warehouse):
    with pytest.raises(ValueError, match="service_zone"):
        conform_zones(spark.createDataFrame([(1, "b", "z")], "locationid int, borough string, zone string"))
    twice = spark.createDataFrame([(1, "b", "z", "s"), (1, "c", "y", "s")], "locationid int, borough string, zone string, service_zone string")
    with pytest.raises(ValueError, match="repeated"):
        load_zones(warehouse, twice)


def test_other_datasets_are_refused(warehouse):
    with pytest.raises(ValueError, match="green"):
        load_months(warehouse, "2024-01", {}, dataset="green")


def test_batch_list():
    assert batch_list(" 2024-01, ,2024-02,2024-01 ") == ["2024-01", "2024-02"]
    assert batch_list([" 2024-03 ", "", 7]) == ["2024-03", "7"]
    assert batch_list(None) == []


def test_run_logs_of_both_generations_as_plain_files(spark, tmp_path):
    (tmp_path / "benchmarks_r1_before.csv").write_text("run_id,phase,query,iter,elapsed_ms\nr1,before,q1,1,10.5\n")
    (tmp_path / "benchmarks_before_20260110_134736.csv").write_text("phase,query,iter,elapsed_ms\nbefore,q1,1,119.422\n")
    (tmp_path / "benchmarks_after_20260110_134736.csv").write_text("phase,query,iter,elapsed_ms\nafter,q1,1,36.853\n")
    log = spark.createDataFrame([("r1", "after", "q1", 1, 5.25)], "run_id string, phase string, query string, iter int, elapsed_ms double")
    write_run_log(log.withColumn("elapsed_ms", F.col("elapsed_ms").cast("decimal(18,3)")), str(tmp_path), "r1", "after")
    found = read_run_logs(spark, str(tmp_path))
    assert found.columns == RUN_LOG.fieldNames()
    assert sorted((r.run_id, r.phase, float(r.elapsed_ms)) for r in found.collect()) == [
        ("20260110_134736", "after", 36.853),
        ("20260110_134736", "before", 119.422),
        ("r1", "after", 5.25),
        ("r1", "before", 10.5),
    ]


def test_no_logs(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_run_logs(spark, str(tmp_path))


def test_phase_is_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        write_run_log(spark.createDataFrame([], RUN_LOG), str(tmp_path), "r", "during")


def test_shuffle_width():
    assert shuffle_partitions_for(1) == 8
    assert shuffle_partitions_for(100 << 40, cores=4000) == 409_600
    assert shuffle_partitions_for(1 << 40) == 4096


def test_amounts_are_kept_exactly(spark, warehouse, tmp_path):
    """No digit is rounded; what an amount cannot hold is an error row."""
    rows = [
        trip("2024-01", 1, "2024-01-01 10:00:00", trip_distance=0.004),
        trip("2024-01", 2, "2024-01-01 10:00:00", total_amount=-0.004),
        trip("2024-01", 3, "2024-01-01 10:00:00", Passenger_Count=8.04),
        trip("2024-01", 4, "2024-01-01 10:00:00", total_amount=16.300000000000001),
        trip("2024-01", 5, "2024-01-01 10:00:00", total_amount=1e-25),
        trip("2024-01", 6, "2024-01-01 10:00:00", trip_distance=1e30),
    ]
    path = str(tmp_path / "month")
    source(spark, rows).drop("batch_id").write.parquet(path)
    done = load_batch(warehouse, "2024-01", path)
    assert (done.rows, done.rejected) == (6, 2)
    errors = {r.error_reason for r in warehouse.read("ingest_errors").collect()}
    assert errors == {"too many digits: total_amount", "too many digits: trip_distance"}
    reasons = {r.vendor_id: r.reason_code for r in with_reason(stage(warehouse.read("raw"))).collect()}
    assert reasons == {1: None, 2: "invalid_total_amount", 3: None, 4: None, 5: "invalid_total_amount", 6: "invalid_distance"}
    kept = {r.vendorid: r for r in warehouse.read("raw").collect()}
    assert str(kept[3].passenger_count).rstrip("0") == "8.04"
    assert str(kept[4].total_amount).rstrip("0") == "16.3"


def test_errors_go_with_their_batch(spark, warehouse, tmp_path):
    bad, good = str(tmp_path / "bad"), str(tmp_path / "good")
    source(spark, [trip("2024-01", 1, "2024-01-01 10:00:00", RatecodeID=1.5)]).drop("batch_id").write.parquet(bad)
    source(spark, [trip("2024-01", 1, "2024-01-01 10:00:00")]).drop("batch_id").write.parquet(good)
    for path, left in ((bad, 1), (bad, 1), (good, 0)):
        load_batch(warehouse, "2024-01", path, replace=True)
        assert warehouse.read("ingest_errors").count() == left


def test_logs_by_file(spark, tmp_path):
    here, there = tmp_path / "here", tmp_path / "there"
    here.mkdir()
    there.mkdir()
    new = "run_id,phase,query,iter,elapsed_ms\n"
    (here / "benchmarks_r1_before.csv").write_text(f"{new}r1,before,q1,1,10\nr1,before,q1,2,30\n")
    (here / "benchmarks_r1_after.csv").write_text(f"{new}r1,after,q1,1,5\n")
    (here / "benchmarks_r2_before.csv").write_text(f"{new}r2,before,q1,1,7\n")
    (here / "notes.csv").write_text("x\n")
    (there / "benchmarks_after_r1.csv").write_text("phase,query,iter,elapsed_ms\nafter,q1,1,4\nafter,q2,1,9\n")
    (there / "mine.csv").write_text(f"{new}r9,after,q1,1,2\n")
    assert [(log.run_id, log.phase, log.older) for log in list_run_logs(spark, str(there))] == [("r1", "after", True)]
    assert parse_log_name("/a/benchmarks_x_y_after.csv/").run_id == "x_y" and parse_log_name("benchmarks_x.csv") is None

    def result(**choice):
        return {r.query: (r.before_ms, r.after_ms, r.speedup_x) for r in compare_files(spark, **choice).collect()}

    before, older, odd = str(here / "benchmarks_r1_before.csv"), str(there / "benchmarks_after_r1.csv"), str(there / "mine.csv")
    assert result(folder=str(here)) == result(folder=str(here), run_id=" r1 ") == {"q1": (20.0, 5.0, 4.0)}
    assert result(before_file=before, after_file=older) == {"q1": (20.0, 4.0, 5.0), "q2": (None, 9.0, None)}
    assert result(folder=str(here), run_id="r1", after_file=older)["q1"] == (20.0, 4.0, 5.0)
    assert result(before_file=before, after_file=odd, allow_mismatched=True) == {"q1": (20.0, 2.0, 10.0)}
    for choice, error, text in (
        (dict(before_file=before), ValueError, "both"),
        (dict(before_file=before, after_file=odd), ValueError, "neither run nor phase"),
        (dict(before_file=older, after_file=before), ValueError, "no before log"),
        (dict(before_file=str(here / "benchmarks_r2_before.csv"), after_file=older), ValueError, "different runs"),
        (dict(folder=str(here), run_id="r2"), FileNotFoundError, "no after log"),
        (dict(folder=str(here), run_id="r1", before_file=str(here / "benchmarks_r2_before.csv")), ValueError, "not of run r1"),
        (dict(folder=str(there)), FileNotFoundError, "both a before and an after"),
        (dict(before_file=before, after_file=f"{older}x"), FileNotFoundError, "no after log at"),
    ):
        with pytest.raises(error, match=text):
            resolve_files(spark, **choice)
