"""Time windows and the rolling rebuild window of the marts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.functions.temporal import batch_month, current_month, plus_months, ts_literal

DEFAULT_MONTH = "default"
DEFAULT_LOOKBACK = 2


def month_text(moment: datetime) -> str:
    return f"{moment.year:04d}{moment.month:02d}"


def months_between(start: datetime, end: datetime) -> list[str]:
    """Month keys touched by ``[start, end)``."""
    keys, year, month = [], start.year, start.month
    while datetime(year, month, 1) < end:
        keys.append(f"{year:04d}{month:02d}")
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return keys


def in_window(trips: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Trips with pickup in ``[start, end)``.

    Spark does not derive directory filters from ``pickup_ts``, so stored trips also
    get the months the window touches. The ``default`` month stays in: it holds
    pickups of any time.
    """
    kept = trips.where((F.col("pickup_ts") >= ts_literal(start)) & (F.col("pickup_ts") < ts_literal(end)))
    if "pickup_month" in trips.columns:
        last = end - timedelta(microseconds=1)
        month = F.col("pickup_month")
        kept = kept.where(month.between(month_text(start), month_text(last)) | (month == DEFAULT_MONTH))
    return kept


@dataclass(frozen=True)
class MartWindow:
    start: datetime
    end: datetime

    @property
    def months(self) -> list[str]:
        return months_between(self.start, self.end)


def lookback_months(value: object = DEFAULT_LOOKBACK) -> int:
    """At least 1; text that is not a number counts as 1."""
    try:
        return max(1, int(float(str(value).strip())))
    except (ValueError, OverflowError):
        return 1


def anchor_month(batches: DataFrame) -> DataFrame:
    """Latest real batch month, or the current month when there is none."""
    latest = F.max(batch_month("batch_id"))
    return batches.agg(F.coalesce(latest, current_month()).alias("anchor"))


def window_bounds(batches: DataFrame, lookback: object = DEFAULT_LOOKBACK) -> DataFrame:
    months = lookback_months(lookback)
    return anchor_month(batches).select(
        plus_months("anchor", 1 - months).alias("start_ts"), plus_months("anchor", 1).alias("end_ts")
    )


def mart_window(batches: DataFrame, lookback: object = DEFAULT_LOOKBACK) -> MartWindow:
    """The bounds as plain values, so that the mart build prunes folders at planning time."""
    start, end = window_bounds(batches, lookback).first()
    return MartWindow(start, end)


def month_window(newest: datetime, months: int) -> MartWindow:
    """The ``months`` calendar months that end with the one of ``newest``."""
    last = newest.year * 12 + newest.month - 1
    first = last + 1 - months
    return MartWindow(datetime(first // 12, first % 12 + 1, 1), datetime((last + 1) // 12, (last + 1) % 12 + 1, 1))


def batch_month_bounds(batches: DataFrame) -> DataFrame:
    month = batch_month("batch_id")
    return batches.agg(F.min(month).alias("first_month"), F.max(month).alias("last_month"))
