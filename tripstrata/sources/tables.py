"""The driver's tables as monthly trip files and a zone lookup.

Each mapping yields source-shaped rows (mixed-case names, source types) plus
``batch_id``, so that every query goes through the ordinary conform step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripstrata.sources.zones import conform_zones


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per event: times within the day, every reason code, one batch."""
    return table(spark, sf_dir, "events").selectExpr(
        "date_format(ts, 'yyyy-MM') AS batch_id",
        "event_id AS VendorID",
        "ts AS tpep_pickup_datetime",
        """CASE WHEN event_id % 101 = 0 THEN NULL
                WHEN event_id % 89 = 0 THEN ts - INTERVAL 60 SECONDS
                ELSE ts + make_dt_interval(0, 0, 0, floor(value * 10)) END AS tpep_dropoff_datetime""",
        "CASE WHEN event_id % 103 <> 0 THEN user_id % 25 END AS PULocationID",
        "(user_id * 7) % 25 AS DOLocationID",
        "CAST((event_id % 97) / 4.0 AS DECIMAL(18,2)) AS Trip_Distance",
        "CAST(CAST(value AS DECIMAL(18,2)) - 1 AS DECIMAL(18,2)) AS Total_Amount",
        "CAST((event_id % 13) / 4.0 AS DECIMAL(18,2)) AS Tip_Amount",
        """CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 0
                WHEN 'error' THEN CASE WHEN event_id % 10 = 0 THEN 9 ELSE 4 END END AS payment_type""",
        "CASE WHEN event_id % 53 = 0 THEN 7 ELSE 1 + event_id % 6 END AS RatecodeID",
    )


def _line_trips(spark: SparkSession, sf_dir: str, batch_id: str) -> DataFrame:
    """Both sides are brought to the trip's columns before they are joined: small numbers shuffle in fewer bytes than keys, doubles and texts."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS VendorID",
        "l_shipdate AS tpep_dropoff_datetime",
        "l_suppkey % 25 AS PULocationID",
        "l_partkey % 25 AS DOLocationID",
        "CAST(l_discount * 100 AS DECIMAL(18,2)) AS Trip_Distance",
        "CAST(l_extendedprice AS DECIMAL(18,2)) AS Total_Amount",
        "CAST(l_quantity AS DECIMAL(18,2)) AS Tip_Amount",
        "1 + l_linenumber AS RatecodeID",
    )
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderdate", "substring(o_orderpriority, 1, 1) AS priority")
    return lines.join(orders, lines.VendorID == orders.o_orderkey).selectExpr(
        f"{batch_id} AS batch_id",
        "VendorID",
        "o_orderdate AS tpep_pickup_datetime",
        "tpep_dropoff_datetime",
        "PULocationID",
        "DOLocationID",
        "Trip_Distance",
        "Total_Amount",
        "Tip_Amount",
        "CAST(priority AS BIGINT) AS payment_type",
        "RatecodeID",
    )


def line_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip per order line, in 80 monthly batches."""
    return _line_trips(spark, sf_dir, "date_format(o_orderdate, 'yyyy-MM')")


def line_trips_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trips in one batch per year, named after its first month.

    Pickups then spread over twelve months of a batch, and those of the last year lie
    beyond the batch span from its third month on.
    """
    return _line_trips(spark, sf_dir, "concat(year(o_orderdate), '-01')")


def nation_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    joined = nations.join(regions, nations.n_regionkey == regions.r_regionkey)
    return conform_zones(
        joined.selectExpr(
            "n_nationkey AS LocationID",
            "r_name AS Borough",
            "n_name AS Zone",
            "CAST(NULL AS STRING) AS service_zone",
        )
    )
