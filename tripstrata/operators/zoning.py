"""Trips and zones together.

No broadcast is hinted. Spark broadcasts the zone table when its measured size is
below the session's threshold and otherwise shuffles, with AQE splitting hot zones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripstrata.functions.scalars import exact_sum


def with_zone(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Trips with their pickup zone's names; trips without a known zone drop out."""
    return trips.join(zones, trips.pu_location_id == zones.locationid, "inner")


def zone_totals(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """Trips and mean total per borough and zone.

    Trips are summed per zone id before the join, so one row per id is joined instead
    of one per trip, whatever the size of the zone table or the share of a hot zone.
    """
    per_id = trips.groupBy("pu_location_id").agg(
        F.count(F.lit(1)).alias("_trips"),
        exact_sum(F.col("total_amount")).alias("_total"),
        F.count("total_amount").alias("_amounts"),
    )
    return (
        with_zone(per_id, zones)
        .groupBy("borough", "zone")
        .agg(F.sum("_trips").alias("trips"), F.sum("_total").alias("_total"), F.sum("_amounts").alias("_amounts"))
        .select(
            "borough",
            "zone",
            "trips",
            (F.col("_total").cast("double") / F.nullif(F.col("_amounts"), F.lit(0)).cast("double")).alias("avg_total"),
        )
    )
