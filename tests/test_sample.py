"""The five-trip sample, with results worked out by hand."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest

from tripstrata.operators.checks import Policy, enforce
from tripstrata.plans import workload as W
from tripstrata.plans.builds import build_clean, build_marts, build_quarantine, check_clean, register_views, row_counts, staged
from tripstrata.sources.sample import load_sample
from tripstrata.session import scratch_dir
from tripstrata.storage.warehouse import Warehouse


@pytest.fixture(scope="module")
def built(spark):
    warehouse = Warehouse(spark, scratch_dir(spark, "sample"))
    for _ in range(2):  # loading and building again must change nothing
        load_sample(warehouse)
        build_clean(warehouse)
        build_quarantine(warehouse)
        build_marts(warehouse)
    return warehouse


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_all_clean_none_quarantined(built):
    assert built.read("clean").count() == 5
    assert built.read("quarantine").count() == 0


def test_durations(built):
    found = built.read("clean").orderBy("pickup_ts").select("trip_duration_sec").collect()
    assert [int(r[0]) for r in found] == [900, 1200, 900, 1680, 1080]


def test_february_pickup_has_its_own_month(built):
    assert built.second_values("clean") == ["202401", "202402"]


def test_queries(built):
    clean, zones = built.read("clean"), built.read("zones")
    assert rows(W.top_pickup_zones(clean, datetime(2024, 1, 31), datetime(2024, 2, 1))) == [(1, 2), (2, 1), (3, 1)]
    days = [(date(2024, 1, 31), 4, Decimal("80.70")), (date(2024, 2, 1), 1, Decimal("18.30"))]
    assert rows(W.revenue_by_day(clean)) == days
    assert rows(W.payment_stats(clean)) == [(1, 3, 2.0), (2, 1, 3.0), (3, 1, 4.0)]
    hours = [(0, 1), (7, 1), (9, 1), (12, 1), (18, 1)]
    assert rows(W.hourly_ranking(clean)) == hours
    assert rows(W.top_zones(clean, zones))[0] == ("Manhattan", "Financial District", 2, 14.3)


def test_marts_agree_with_clean(built):
    clean = built.read("clean")
    assert rows(W.revenue_by_day_from_mart(built.read("daily_revenue"))) == rows(W.revenue_by_day(clean))
    assert rows(W.hourly_ranking_from_mart(built.read("hourly_peak"))) == rows(W.hourly_ranking(clean))


def test_suites_pass(built):
    results, summary = check_clean(built)
    assert results.count() == 9
    enforce(summary, Policy(fail_on_warning=True))


def test_row_counts(built, spark):
    found = dict(rows(row_counts(built)))
    assert found["stg.stg_yellow_trips"] == found["clean.clean_yellow_trips"] == 5
    empty = dict(rows(row_counts(Warehouse(spark, scratch_dir(spark, "nothing")))))
    assert set(empty.values()) == {None} and set(empty) == set(found)


def test_sql_views(built, spark):
    register_views(built)
    found = spark.sql(
        "select payment_type, count(*) as trips, avg(tip_amount) as avg_tip from clean_yellow_trips group by 1 order by trips desc"
    )
    assert found.first()["trips"] == 3
    assert spark.sql("select count(*) from stg_yellow_trips").first()[0] == staged(built).count()
