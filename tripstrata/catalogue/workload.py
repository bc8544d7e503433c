"""W01-W08, O01 and the flagship query."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.catalogue.base import (
    Q1_END,
    Q1_START,
    built_warehouse,
    doubles,
    exact_avg_sql,
    exact_sum_sql,
    query,
    sql,
)
from tripstrata.operators.marts import daily_revenue, hourly_peak
from tripstrata.plans import workload as W
from tripstrata.plans.builds import trips_between

WINDOW = (datetime(1998, 3, 1), datetime(1998, 6, 1))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean as it is stored, all of it."""
    return built_warehouse(spark, sf_dir, "ev").read("clean")


@query(
    "W01_top_pickup_zones_day",
    sql("ev", """SELECT pu_location_id, count(*) AS trips FROM ev_clean
        WHERE pickup_ts >= TIMESTAMP '2024-01-15' AND pickup_ts < TIMESTAMP '2024-01-16'
        GROUP BY 1 ORDER BY trips DESC, pu_location_id LIMIT 20"""),
)
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = trips_between(built_warehouse(spark, sf_dir, "ev"), Q1_START, Q1_END)
    return W.top_pickup_zones(trips, Q1_START, Q1_END)


_DAILY = "SELECT CAST(pickup_ts AS DATE) AS trip_date, count(*) AS trips, " + exact_sum_sql("total_amount") + " AS revenue"


@query("W02_revenue_by_day", sql("ev", f"{_DAILY} FROM ev_clean GROUP BY 1 ORDER BY 1"))
def w02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(W.revenue_by_day(stored(spark, sf_dir)))


@query("W03_revenue_by_day_from_mart", sql("yr", f"{_DAILY} FROM yr_clean GROUP BY 1 ORDER BY 1"))
def w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(W.revenue_by_day_from_mart(built_warehouse(spark, sf_dir).read("daily_revenue")))


@query(
    "W04_top_zones_join",
    sql("ev", f"""SELECT borough, zone, count(*) AS trips, {exact_avg_sql('total_amount')} AS avg_total
        FROM ev_clean JOIN zones ON locationid = pu_location_id
        GROUP BY 1, 2 ORDER BY trips DESC, borough, zone LIMIT 20""", zones=True),
)
def w04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.top_zones(stored(spark, sf_dir), built_warehouse(spark, sf_dir, "ev").read("zones"))


@query(
    "W05_payment_type_stats",
    sql("ev", f"""SELECT payment_type, count(*) AS trips, {exact_avg_sql('tip_amount')} AS avg_tip
        FROM ev_clean GROUP BY 1 ORDER BY trips DESC"""),
)
def w05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.payment_stats(stored(spark, sf_dir))


_HOURS = "SELECT CAST(hour(pickup_ts) AS INTEGER) AS hr, count(*) AS trips"


@query("W06_hourly_peak", sql("ev", f"{_HOURS} FROM ev_clean GROUP BY 1 ORDER BY trips DESC"))
def w06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.hourly_ranking(stored(spark, sf_dir))


@query("W07_hourly_peak_from_mart", sql("ev", f"{_HOURS} FROM ev_clean GROUP BY 1 ORDER BY trips DESC"))
def w07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.hourly_ranking_from_mart(built_warehouse(spark, sf_dir, "ev").read("hourly_peak"))


@query(
    "W08_window_revenue",
    sql("yr", f"""{_DAILY} FROM yr_clean
        WHERE pickup_ts >= TIMESTAMP '1998-03-01' AND pickup_ts < TIMESTAMP '1998-06-01' GROUP BY 1 ORDER BY 1"""),
)
def w08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(W.window_revenue(trips_between(built_warehouse(spark, sf_dir), *WINDOW), *WINDOW))


@query(
    "O01_pruned_window",
    sql("yr", """SELECT batch_id, row_fingerprint FROM yr_clean
        WHERE pickup_ts >= TIMESTAMP '2000-11-15' AND pickup_ts < TIMESTAMP '2001-05-02'"""),
)
def o01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window reaches past the batch span, so part of it lies in the default folder."""
    trips = trips_between(built_warehouse(spark, sf_dir), datetime(2000, 11, 15), datetime(2001, 5, 2))
    return trips.select("batch_id", "row_fingerprint")


@query(
    "W02_W06_mart_agreement",
    sql("ev", """SELECT 'daily' AS mart, count(DISTINCT CAST(pickup_ts AS DATE)) AS rows_in_mart, CAST(0 AS BIGINT) AS differing
        FROM ev_clean UNION ALL
        SELECT 'hourly', count(DISTINCT date_trunc('hour', pickup_ts)), 0 FROM ev_clean"""),
)
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored marts against the same aggregates over clean."""
    warehouse = built_warehouse(spark, sf_dir, "ev")
    trips = warehouse.read("clean")
    parts = []
    for name, layer, fresh in (
        ("daily", "daily_revenue", daily_revenue(trips)),
        ("hourly", "hourly_peak", hourly_peak(trips)),
    ):
        stored = warehouse.read(layer).drop("trip_month")
        both = stored.unionAll(fresh.select(*stored.columns)).groupBy(*stored.columns).agg(F.count(F.lit(1)).alias("n"))
        differing = F.count_if(F.col("n") != 2).alias("differing")
        parts.append(both.agg(F.count_if(F.col("n") == 2).alias("rows_in_mart"), differing).select(F.lit(name).alias("mart"), "*"))
    return parts[0].unionAll(parts[1])
