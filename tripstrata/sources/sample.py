"""The five-trip, four-zone sample used for smoke runs and hand-checked tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.schemas import RAW, ZONES
from tripstrata.sources.trips import run_moment
from tripstrata.sources.zones import load_zones
from tripstrata.storage.warehouse import ALL, Warehouse

# The sample rows.
SAMPLE_ZONES = [
    (1, "Manhattan", "Financial District", "Yellow Zone"),
    (2, "Queens", "JFK Airport", "Airports"),
    (3, "Brooklyn", "Williamsburg", "Boro Zone"),
    (4, "Manhattan", "Midtown Center", "Yellow Zone"),
]
# vendor, pickup, dropoff, passengers, distance, pickup zone, dropoff zone, payment, fare, extra, tip, total
SAMPLE_TRIPS = [
    (1, "2024-01-31 00:10", "2024-01-31 00:25", 1, "2.1", 1, 2, 1, "12.00", "0.5", "2.5", "15.80"),
    (2, "2024-01-31 07:15", "2024-01-31 07:35", 2, "4.3", 2, 1, 2, "18.00", "0.5", "3.0", "22.30"),
    (1, "2024-01-31 12:05", "2024-01-31 12:20", 1, "1.8", 1, 3, 1, "10.00", "0.5", "1.5", "12.80"),
    (2, "2024-01-31 18:00", "2024-01-31 18:28", 3, "6.2", 3, 4, 3, "24.00", "1.0", "4.0", "29.80"),
    (1, "2024-02-01 09:00", "2024-02-01 09:18", 1, "3.6", 4, 1, 1, "15.00", "0.5", "2.0", "18.30"),
]
SAMPLE_BATCH = "2024-01"
# The same on every row.
SAMPLE_CONSTANTS = {
    "ratecodeid": "1",
    "store_and_fwd_flag": "N",
    "mta_tax": "0.5",
    "tolls_amount": "0.0",
    "improvement_surcharge": "0.3",
    "congestion_surcharge": "2.5",
    "airport_fee": "0.0",
    "cbd_congestion_fee": "0.0",
}


def sample_zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_ZONES, ZONES)


def sample_raw(spark: SparkSession) -> DataFrame:
    names = (
        "vendorid string, tpep_pickup_datetime string, tpep_dropoff_datetime string, passenger_count string, "
        "trip_distance string, pulocationid string, dolocationid string, payment_type string, fare_amount string, "
        "extra string, tip_amount string, total_amount string"
    )
    rows = spark.createDataFrame([tuple(str(v) for v in row) for row in SAMPLE_TRIPS], names)
    for name, value in SAMPLE_CONSTANTS.items():
        rows = rows.withColumn(name, F.lit(value))
    rows = rows.withColumn("batch_id", F.lit(SAMPLE_BATCH)).withColumn("ingested_at", F.lit(run_moment()))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW.fields])


def load_sample(warehouse: Warehouse) -> None:
    """Replace raw trips and zones by the sample; running it again changes nothing but the load time."""
    load_zones(warehouse, sample_zones(warehouse.spark))
    warehouse.publish("raw", sample_raw(warehouse.spark), ALL)

