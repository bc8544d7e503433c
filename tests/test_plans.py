"""The physical plans are the ones meant for large data."""

from __future__ import annotations

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tripstrata.catalogue.base import Q1_END, Q1_START, built_warehouse, clean, staged
from tripstrata.operators.audit import audit_batches, batch_digests
from tripstrata.operators.checks import Policy, evaluate, in_set, suites, unexpected_sample
from tripstrata.operators.layout import arranged
from tripstrata.operators.marts import mart
from tripstrata.operators.staging import clean_trips
from tripstrata.operators.windows import in_window
from tripstrata.plans import workload as W
from tripstrata.plans.builds import audit
from tripstrata.session import scratch_dir
from tripstrata.sources.tables import nation_zones


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"^\(\d+\) Exchange\s*$", plan(df), re.M))


def read_columns(df) -> list[set[str]]:
    return [set(re.findall(r"(\w+):", part)) for part in re.findall(r"ReadSchema: struct<(.*)>", plan(df))]


@pytest.fixture(scope="module")
def stored(spark, sf_dir):
    return built_warehouse(spark, sf_dir)


def test_day_query_prunes_folders_and_columns(stored):
    query = W.top_pickup_zones(stored.read("clean"), datetime(1998, 3, 1), datetime(1998, 3, 2))
    text = plan(query)
    assert re.search(r"PartitionFilters: \[.*pickup_month.*199803.*default", text)
    assert "GreaterThanOrEqual(pickup_ts" in text
    assert "TakeOrderedAndProject" in text
    assert read_columns(query) == [{"pickup_ts", "pu_location_id"}]


def test_window_reads_only_its_folders(stored):
    window = in_window(stored.read("clean"), datetime(1998, 3, 1), datetime(1998, 5, 1))
    files = window.selectExpr("_metadata.file_path as f").distinct().collect()
    assert {re.search(r"pickup_month=(\w+)", r.f).group(1) for r in files} == {"199803", "199804"}


def test_files_of_a_month_are_sorted_by_pickup(stored):
    rows = stored.read("clean").where("batch_id = '1998-01'").selectExpr("_metadata.file_path as f", "pickup_ts").collect()
    per_file: dict[str, list] = {}
    for r in rows:
        per_file.setdefault(r.f, []).append(r.pickup_ts)
    assert all(times == sorted(times) for times in per_file.values())


def test_zone_query_aggregates_before_a_broadcast_join(spark, sf_dir, stored):
    query = W.top_zones(stored.read("clean"), stored.read("zones"))
    text = final_plan(query)
    assert "BroadcastHashJoin" in text
    join = text.index("BroadcastHashJoin")
    assert text.index("HashAggregate", join) < text.index("FileScan", join)
    assert {"pu_location_id", "total_amount"} in read_columns(query)


def test_large_zone_table_is_not_broadcast(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        query = W.top_zones(clean(spark, sf_dir, "ev"), nation_zones(spark, sf_dir))
        assert "BroadcastHashJoin" not in plan(query) and "BroadcastNestedLoop" not in plan(query)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["daily_revenue", "hourly_peak", "daily_zone"])
def test_marts_take_one_shuffle(stored, name):
    assert shuffles(mart(name, stored.read("clean"))) == 1


def test_rules_reach_the_reader(spark, sf_dir, stored):
    from tripstrata.operators.staging import clean_trips
    from tripstrata.plans.builds import staged as from_raw

    text = plan(clean_trips(from_raw(stored)))
    pushed = re.search(r"PushedFilters: \[(.*)", text).group(1)
    for part in ("IsNotNull(tpep_dropoff_datetime)", "GreaterThan(trip_distance", "GreaterThanOrEqual(total_amount"):
        assert part in pushed


def test_quality_is_one_scan(spark, stored):
    df = evaluate(stored.read("clean"), suites(Policy()))
    assert plan(df).count("Scan parquet") == 2  # once in the tree, once in the details
    assert shuffles(df) == 1


def test_audit_in_sync_shuffles_a_row_per_batch_and_task(spark, stored):
    from tripstrata.plans.builds import staged as from_raw

    digests = batch_digests(clean_trips(from_raw(stored)))
    assert re.findall(r"hashpartitioning\(([^,]*),", plan(digests)) and shuffles(digests) == 1
    assert re.search(r"HashAggregate\s*\n.*partial|Functions \[\d+\]: \[partial_count", plan(digests))
    # nothing is left to compare row by row, whether clean's digests are read back or known
    for found in (audit_batches(from_raw(stored), stored.read("clean")), audit(stored)):
        assert "Scan parquet" not in plan(found) and shuffles(found) == 0
        assert {(r.missing, r.extra) for r in found.collect()} == {(0, 0)}


def test_sample_is_limited_before_the_shuffle(spark, sf_dir):
    meta = {"severity": "warning", "domain": "d", "rationale": "r"}
    text = plan(unexpected_sample(staged(spark, sf_dir, "ev"), (in_set("payment_type", (1,), **meta),)))
    assert "WindowGroupLimit" in text


def test_first_day_of_events_prunes(spark, sf_dir):
    events = built_warehouse(spark, sf_dir, "ev").read("clean")
    assert in_window(events, Q1_START, Q1_END).count() > 0


def test_hot_day_is_split_on_write(spark):
    """A third of all rows on one day: its rows go to several tasks, all of them kept."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    path = f"{scratch_dir(spark, 'hot')}/t"
    day = "CASE WHEN id % 3 = 0 THEN 9 ELSE CAST(id % 30 AS INT) END"
    rows = spark.range(0, 300_000, 1, 8).selectExpr(
        "'2024-01' AS batch_id", "'202401' AS pickup_month", "md5(CAST(id AS STRING)) AS fp",
        f"timestamp_ntz'2024-01-01' + make_dt_interval({day}, CAST(id % 24 AS INT)) AS pickup_ts",
    )
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        arranged(rows).write.partitionBy("batch_id", "pickup_month").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    per_file = (
        spark.read.parquet(path)
        .groupBy(F.to_date("pickup_ts").alias("d"), F.col("_metadata.file_path").alias("f"))
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    hot = [r.n for r in per_file if r.d == date(2024, 1, 10)]
    assert sum(r.n for r in per_file) == 300_000
    assert len(hot) >= 3 and max(hot) < 60_000
