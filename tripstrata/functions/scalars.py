"""Scalar expressions on trip columns and run timings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The columns a fingerprint covers, in order.
FINGERPRINT_COLUMNS = (
    "vendor_id",
    "pickup_ts",
    "dropoff_ts",
    "pu_location_id",
    "do_location_id",
    "trip_distance",
    "total_amount",
)
_AMOUNTS = {"trip_distance", "total_amount"}


def speed(distance: Column, seconds: Column) -> Column:
    """Distance units per hour; NULL unless the trip took time."""
    hours = seconds.cast("double") / F.lit(3600.0)
    return F.when(seconds > 0, distance.cast("double") / hours)


def text(column: Column) -> Column:
    return column.cast("string")


def plain_number(amount: Column) -> Column:
    """An amount's text without trailing zeros."""
    return F.regexp_replace(text(amount), r"\.0*$|(\.[0-9]*[1-9])0+$", "$1")


def blank_to_null(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def row_fingerprint() -> Column:
    """md5 over the seven key columns' text. Amounts are written without trailing zeros."""
    parts = []
    for name in FINGERPRINT_COLUMNS:
        written = plain_number(F.col(name)) if name in _AMOUNTS else text(F.col(name))
        parts.append(F.coalesce(written, F.lit("")))
    return F.md5(F.concat_ws("|", *parts))


def exact_sum(column: Column) -> Column:
    """Order-independent sum of a decimal amount."""
    return F.sum(column)


def exact_avg(column: Column) -> Column:
    """Mean as the exact decimal sum over the number of non-NULL values; NULL without any."""
    return F.sum(column).cast("double") / F.nullif(F.count(column), F.lit(0)).cast("double")


def _rounded(value: Column, places: int) -> Column:
    """Scaled, rounded with ties to even, scaled back, as array libraries do it."""
    unit = F.lit(float(10**places))
    return F.rint(value * unit) / unit


def speedup(before: Column, after: Column) -> Column:
    return _rounded(before / F.nullif(after, F.lit(0.0)), 2)


def improvement_pct(before: Column, after: Column) -> Column:
    return _rounded((F.lit(1.0) - after / F.nullif(before, F.lit(0.0))) * 100, 1)
