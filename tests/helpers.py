"""Small trip fixtures."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from tripstrata.sources.trips import raw_from_batched

FIRST_LOAD = datetime(2024, 6, 1, tzinfo=timezone.utc)

SOURCE = (
    "batch_id string, VendorID bigint, tpep_pickup_datetime string, tpep_dropoff_datetime string, "
    "Passenger_Count double, trip_distance double, RatecodeID double, PULocationID bigint, DOLocationID bigint, "
    "payment_type bigint, tip_amount double, total_amount double"
)


def trip(batch: str, vendor: int, pickup: str, minutes: float | None = 15, **changes) -> dict:
    start = datetime.fromisoformat(pickup)
    row = {
        "batch_id": batch,
        "VendorID": vendor,
        "tpep_pickup_datetime": pickup,
        "tpep_dropoff_datetime": None if minutes is None else str(start + timedelta(minutes=minutes)),
        "Passenger_Count": 1.0,
        "trip_distance": 2.0,
        "RatecodeID": 1.0,
        "PULocationID": 1,
        "DOLocationID": 2,
        "payment_type": 1,
        "tip_amount": 1.0,
        "total_amount": 10.0,
    }
    return row | changes


def source(spark: SparkSession, trips: list[dict]) -> DataFrame:
    names = [part.strip().split(" ")[0] for part in SOURCE.split(",")]
    return spark.createDataFrame([tuple(t[n] for n in names) for t in trips], SOURCE)


def raw_trips(spark: SparkSession, trips: list[dict], loaded_at: datetime = FIRST_LOAD) -> DataFrame:
    return raw_from_batched(source(spark, trips), loaded_at)


def folders(warehouse, layer: str) -> set[tuple[str, ...]]:
    return warehouse.slices(layer, 2)
