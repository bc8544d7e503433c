"""Raw to staged trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.functions.scalars import row_fingerprint, speed
from tripstrata.functions.temporal import seconds_between
from tripstrata.rules import is_valid, reason_code
from tripstrata.schemas import CLEAN, QUARANTINE, STAGE, STAGE_COLUMNS

_TYPES = {field.name: field.dataType for field in STAGE.fields}


def typed(raw: DataFrame) -> DataFrame:
    """Renamed and typed, without the derived columns: what shuffles carry."""
    return raw.select(*[F.col(source).cast(_TYPES[name]).alias(name) for name, source in STAGE_COLUMNS.items()])


def enriched(trips: DataFrame) -> DataFrame:
    seconds = seconds_between("pickup_ts", "dropoff_ts")
    return trips.select(
        "*",
        seconds.alias("trip_duration_sec"),
        speed(F.col("trip_distance"), seconds).alias("avg_speed_kmh"),
    )


def stage(raw: DataFrame) -> DataFrame:
    """Rename, type and enrich. A view: it is never stored."""
    return enriched(typed(raw))


def valid_trips(staged: DataFrame) -> DataFrame:
    return staged.where(is_valid())


def fingerprinted(trips: DataFrame) -> DataFrame:
    return trips.withColumn("row_fingerprint", row_fingerprint())


def clean_trips(staged: DataFrame) -> DataFrame:
    """Valid trips with their fingerprint."""
    return fingerprinted(valid_trips(staged)).select(*CLEAN.fieldNames())


def with_reason(staged: DataFrame) -> DataFrame:
    return staged.withColumn("reason_code", reason_code())


def quarantined_trips(staged: DataFrame) -> DataFrame:
    return with_reason(staged).where(F.col("reason_code").isNotNull()).select(*QUARANTINE.fieldNames())


def quarantined_by_batch(trips: DataFrame) -> DataFrame:
    """:func:`quarantined_trips` of typed trips, those of a batch brought together.

    Few rows of each input task end up here, and else every task would leave a small file. What is
    derived is derived again after the shuffle, which carries the trips as they were.
    """
    flagged = enriched(trips).where(reason_code().isNotNull()).select(*trips.columns).hint("rebalance", "batch_id")
    return with_reason(enriched(flagged)).select(*QUARANTINE.fieldNames())


