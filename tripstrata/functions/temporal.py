"""Time expressions on timestamps without zone; none depends on the session zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH_PATTERN = "^[0-9]{4}-[0-9]{2}$"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ts_literal(moment: datetime) -> Column:
    """A zone-free literal. A bare ``F.lit(datetime)`` would be read in the session zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Exact seconds from start to end, to the microsecond."""
    return (_col(end) - _col(start)).cast("interval second").cast("decimal(18,6)")


def day_of(ts: Column | str) -> Column:
    return F.to_date(_col(ts))


def hour_start(ts: Column | str) -> Column:
    return hour_of_day_start(day_of(ts), F.hour(_col(ts)))


def hour_of_day_start(day: Column, hour: Column) -> Column:
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)


def month_start(ts: Column | str) -> Column:
    return F.trunc(day_of(ts), "MM").cast("timestamp_ntz")


def month_key(ts: Column | str) -> Column:
    """``YYYYMM`` as text."""
    moment = _col(ts)
    return F.lpad((F.year(moment) * 100 + F.month(moment)).cast("string"), 6, "0")


def plus_months(ts: Column | str, months: int) -> Column:
    return _col(ts) + F.make_ym_interval(F.lit(0), F.lit(months))


def batch_month(batch_id: Column | str) -> Column:
    """First instant of a ``YYYY-MM`` batch; NULL for other text and for months that do not exist."""
    batch = _col(batch_id)
    parsed = F.try_to_date(F.concat(batch, F.lit("-01")), "yyyy-MM-dd").cast("timestamp_ntz")
    return F.when(batch.rlike(BATCH_PATTERN), parsed)


def current_month() -> Column:
    return F.trunc(F.current_date(), "MM").cast("timestamp_ntz")
