"""Folder layout of the clean table: R01-R07."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.catalogue.base import LOADED_AT, SOURCES, built_warehouse, clean, new_warehouse, query, raw, sql
from tripstrata.operators.batches import load_source
from tripstrata.operators.layout import (
    batch_span,
    convert_flat_clean,
    list_partitions,
    partition_hits,
    routed,
    write_flat_snapshot,
)
from tripstrata.plans.builds import build_clean
from tripstrata.session import scratch_dir
from tripstrata.storage.warehouse import ALL

_MONTH = "CASE WHEN month_key BETWEEN '199501' AND '200102' THEN month_key ELSE 'default' END"
_BY_FOLDER = f"SELECT batch_id, {_MONTH} AS pickup_month, count(*) AS n FROM yr_clean GROUP BY 1, 2"


def _by_folder(stored: DataFrame) -> DataFrame:
    return stored.groupBy("batch_id", "pickup_month").agg(F.count(F.lit(1)).alias("n"))


@query("R01_route_to_month", sql("yr", _BY_FOLDER))
def r01(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = clean(spark, sf_dir, "yr")
    return _by_folder(routed(trips, batch_span(raw(spark, sf_dir, "yr"))))


@query(
    "R02_batch_span",
    sql("li", """SELECT strftime(m, '%Y%m') AS pickup_month FROM (SELECT unnest(generate_series(
          (SELECT min(CAST(batch_id || '-01' AS TIMESTAMP)) FROM li_raw),
          (SELECT max(CAST(batch_id || '-01' AS TIMESTAMP)) + INTERVAL 1 MONTH FROM li_raw), INTERVAL 1 MONTH)) AS m)"""),
)
def r02(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = batch_span(raw(spark, sf_dir, "li"))
    return spark.createDataFrame([(month,) for month in span.months], "pickup_month string")


@query("R03_rehome_default", sql("yr", f"SELECT batch_id, {_MONTH} AS pickup_month, row_fingerprint FROM yr_clean"))
def r03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built up to 1998 first: most of that year lies in default until later batches give its months ranges."""
    warehouse = new_warehouse(spark, "rehome")
    rows = SOURCES["yr"](spark, sf_dir)
    load_source(warehouse, rows.where(F.col("batch_id") <= "1998-01"), LOADED_AT, ALL)
    build_clean(warehouse)
    later = rows.where(F.col("batch_id") > "1998-01")
    load_source(warehouse, later, LOADED_AT, [r[0] for r in later.select("batch_id").distinct().collect()])
    build_clean(warehouse)
    return warehouse.read("clean").select("batch_id", "pickup_month", "row_fingerprint")


@query("R04_convert_to_folders", sql("yr", _BY_FOLDER))
def r04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat table gets folders; a second conversion finds nothing to do."""
    warehouse = new_warehouse(spark, "convert")
    clean(spark, sf_dir, "yr").write.parquet(warehouse.path("clean"))
    if not convert_flat_clean(warehouse) or convert_flat_clean(warehouse):
        raise RuntimeError("conversion should happen exactly once")
    return _by_folder(warehouse.read("clean"))


@query(
    "R05_list_partitions",
    sql("yr", f"""SELECT pickup_month, first_day AS from_ts, first_day + INTERVAL 1 MONTH AS to_ts, rows FROM (
          SELECT {_MONTH} AS pickup_month, CAST(try_strptime({_MONTH} || '01', '%Y%m%d') AS TIMESTAMP) AS first_day, count(*) AS rows
          FROM yr_clean GROUP BY 1, 2)"""),
)
def r05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_partitions(built_warehouse(spark, sf_dir)).drop("files", "bytes")


@query(
    "R06_partition_hits",
    sql("yr", f"""SELECT {_MONTH} AS pickup_month, count(*) AS rows_seen FROM yr_clean
        WHERE pickup_ts >= TIMESTAMP '2000-12-20' AND pickup_ts < TIMESTAMP '2001-04-10' GROUP BY 1"""),
)
def r06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition_hits(built_warehouse(spark, sf_dir), datetime(2000, 12, 20), datetime(2001, 4, 10))


@query("R07_flat_snapshot", sql("yr", "SELECT batch_id, count(*) AS n, count(DISTINCT row_fingerprint) AS fingerprints FROM yr_clean GROUP BY 1"))
def r07(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = write_flat_snapshot(built_warehouse(spark, sf_dir), f"{scratch_dir(spark, 'flat')}/clean")
    # a fingerprint is the text of 16 bytes, and these are what the shuffle carries
    flat = flat.select("batch_id", F.unhex("row_fingerprint").alias("row_fingerprint"))
    counts = F.count(F.lit(1)).alias("n")
    return flat.groupBy("batch_id", "row_fingerprint").agg(counts).groupBy("batch_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("fingerprints")
    )
