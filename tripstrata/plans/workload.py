"""The analytical queries over clean trips and marts.

Top lists and rankings break ties by their key, so that results are reproducible.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstrata.functions.scalars import exact_avg
from tripstrata.operators.marts import daily_revenue
from tripstrata.operators.windows import in_window
from tripstrata.operators.zoning import zone_totals

TOP = 20


def _by_trips(keys: tuple[str, ...]) -> list[Column]:
    return [F.col("trips").desc(), *[F.col(k).asc_nulls_last() for k in keys]]


def _ranked(counted: DataFrame, *keys: str) -> DataFrame:
    return counted.orderBy(*_by_trips(keys))


def _in_order(report: DataFrame, *order: Column | str) -> DataFrame:
    """A report of few rows (a day, an hour or a code each), sorted in one task: a global sort would sample it in a job of its own."""
    return report.repartition(1).sortWithinPartitions(*order)


def top_pickup_zones(clean: DataFrame, start: datetime, end: datetime, top: int = TOP) -> DataFrame:
    counted = in_window(clean, start, end).groupBy("pu_location_id").agg(F.count(F.lit(1)).alias("trips"))
    return _ranked(counted, "pu_location_id").limit(top)


def revenue_by_day(clean: DataFrame) -> DataFrame:
    return _in_order(daily_revenue(clean), "trip_date")


def revenue_by_day_from_mart(mart: DataFrame) -> DataFrame:
    """The mart is a few small files: they are read by the task that sorts."""
    return mart.select("trip_date", "trips", "revenue").coalesce(1).sortWithinPartitions("trip_date")


def top_zones(clean: DataFrame, zones: DataFrame, top: int = TOP) -> DataFrame:
    return _ranked(zone_totals(clean, zones), "borough", "zone").limit(top)


def payment_stats(clean: DataFrame) -> DataFrame:
    counted = clean.groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("trips"), exact_avg(F.col("tip_amount")).alias("avg_tip")
    )
    return _in_order(counted, *_by_trips(("payment_type",)))


def hourly_ranking(clean: DataFrame) -> DataFrame:
    return _in_order(clean.groupBy(F.hour("pickup_ts").alias("hr")).agg(F.count(F.lit(1)).alias("trips")), *_by_trips(("hr",)))


def hourly_ranking_from_mart(mart: DataFrame) -> DataFrame:
    return mart.coalesce(1).groupBy("hr").agg(F.sum("trips").alias("trips")).sortWithinPartitions(*_by_trips(("hr",)))


def window_revenue(clean: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return _in_order(daily_revenue(in_window(clean, start, end)), "trip_date")
