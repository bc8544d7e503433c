"""The three marts as aggregates over clean trips.

All group keys are few per partition of the input, so Spark's partial aggregation
reduces the data before the shuffle; a hot day or zone costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripstrata.functions.scalars import exact_avg, exact_sum
from tripstrata.functions.temporal import day_of, hour_of_day_start, month_key


def daily_revenue(clean: DataFrame) -> DataFrame:
    return clean.groupBy(day_of("pickup_ts").alias("trip_date")).agg(
        F.count(F.lit(1)).alias("trips"), exact_sum(F.col("total_amount")).alias("revenue")
    )


def hourly_peak(clean: DataFrame) -> DataFrame:
    """Grouped by day and hour number; the hour's timestamp is built once per group."""
    counted = clean.groupBy(day_of("pickup_ts").alias("_day"), F.hour("pickup_ts").alias("hr")).agg(
        F.count(F.lit(1)).alias("trips")
    )
    return counted.select(hour_of_day_start(F.col("_day"), F.col("hr")).alias("pickup_hour"), "hr", "trips")


def daily_zone(clean: DataFrame) -> DataFrame:
    return clean.groupBy(day_of("pickup_ts").alias("trip_date"), "pu_location_id").agg(
        F.count(F.lit(1)).alias("trips"),
        exact_avg(F.col("total_amount")).alias("avg_total_amount"),
        exact_avg(F.col("tip_amount")).alias("avg_tip_amount"),
        exact_avg(F.col("trip_distance")).alias("avg_distance"),
        exact_avg(F.col("trip_duration_sec")).alias("avg_duration_sec"),
    )


# layer -> (builder, time column the mart's month comes from)
MARTS = {
    "daily_revenue": (daily_revenue, "trip_date"),
    "hourly_peak": (hourly_peak, "pickup_hour"),
    "daily_zone": (daily_zone, "trip_date"),
}


def mart(name: str, clean: DataFrame) -> DataFrame:
    """A mart with the month it is stored under."""
    build, time_column = MARTS[name]
    return build(clean).withColumn("trip_month", month_key(time_column))


# ---------------------------------------------------------------- by batch

_AVERAGED = {"total_amount": "avg_total_amount", "tip_amount": "avg_tip_amount", "trip_distance": "avg_distance", "trip_duration_sec": "avg_duration_sec"}


def zone_state(clean: DataFrame) -> DataFrame:
    """What each batch adds per day and zone: sums and counts."""
    parts = [x for name in _AVERAGED for x in (F.sum(name).alias(f"{name}_sum"), F.count(name).alias(f"{name}_count"))]
    return clean.groupBy("batch_id", day_of("pickup_ts").alias("trip_date"), "pu_location_id").agg(F.count(F.lit(1)).alias("trips"), *parts)


def hour_state(clean: DataFrame) -> DataFrame:
    """What each batch adds per hour."""
    counted = clean.groupBy("batch_id", day_of("pickup_ts").alias("_day"), F.hour("pickup_ts").alias("hr")).agg(F.count(F.lit(1)).alias("trips"))
    return counted.select("batch_id", hour_of_day_start(F.col("_day"), F.col("hr")).alias("pickup_hour"), "hr", "trips")


STATES = {"zone_state": zone_state, "hour_state": hour_state}


def _revenue_of(state: DataFrame) -> DataFrame:
    return state.groupBy("trip_date").agg(F.sum("trips").alias("trips"), F.sum("total_amount_sum").alias("revenue"))


def _peak_of(state: DataFrame) -> DataFrame:
    return state.groupBy("pickup_hour", "hr").agg(F.sum("trips").alias("trips"))


def _zone_of(state: DataFrame) -> DataFrame:
    averages = [
        (F.sum(f"{name}_sum").cast("double") / F.nullif(F.sum(f"{name}_count"), F.lit(0)).cast("double")).alias(target)
        for name, target in _AVERAGED.items()
    ]
    return state.groupBy("trip_date", "pu_location_id").agg(F.sum("trips").alias("trips"), *averages)


# mart -> (state it is added up from, how)
FROM_STATE = {
    "daily_revenue": ("zone_state", _revenue_of),
    "hourly_peak": ("hour_state", _peak_of),
    "daily_zone": ("zone_state", _zone_of),
}


def mart_of_state(name: str, state: DataFrame) -> DataFrame:
    """A mart, with the month it is stored under, added up over the batches; the same rows as from their trips."""
    return FROM_STATE[name][1](state).withColumn("trip_month", month_key(MARTS[name][1]))


def state_months(name: str) -> Column:
    """Month of a state's rows."""
    return month_key(MARTS[name][1])
