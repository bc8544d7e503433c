"""Batch loads and incremental builds: B01-B16. Each writes its own warehouse and reads it back."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.catalogue.aggregates import DAILY_ZONE_SQL
from tripstrata.catalogue.base import (
    LOADED_AT,
    SOURCES,
    built_warehouse,
    doubles,
    exact_sum_sql,
    month_files,
    new_warehouse,
    query,
    raw,
    source_rows,
    sql,
    staged,
)
from tripstrata.catalogue.relations import IS_CHANGED, stale_clean
from tripstrata.functions.temporal import ts_literal
from tripstrata.operators.batches import batch_list, changed_batches, delete_batch, load_months, load_source, trips_of
from tripstrata.operators.windows import month_window, window_bounds
from tripstrata.plans.builds import build_clean, build_mart, build_marts, build_quarantine, row_counts
from tripstrata.plans.run import run_all
from tripstrata.storage.warehouse import ALL, Warehouse

_LATER = LOADED_AT + timedelta(days=1)


def _count(trips: DataFrame, *keys: str) -> DataFrame:
    return trips.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "B01_load_gate",
    sql("yr", """SELECT batch_id, step, CASE step WHEN 1 THEN 'loaded' WHEN 2 THEN 'skipped' ELSE 'replaced' END AS action,
          CASE WHEN step = 3 THEN n ELSE 0 END AS deleted, CASE WHEN step <> 2 THEN n ELSE 0 END AS rows
        FROM (SELECT batch_id, count(*) AS n FROM yr_raw GROUP BY 1), (VALUES (1), (2), (3)) AS s(step)"""),
)
def b01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All months loaded, offered again without and then with replacement."""
    warehouse, paths = new_warehouse(spark, "gate"), month_files(spark, sf_dir, "yr")
    outcome = []
    for step, replace in ((1, False), (2, False), (3, True)):
        for r in load_months(warehouse, list(paths), paths, replace=replace):
            outcome.append((r.batch_id, step, r.action, r.deleted, r.rows))
    return spark.createDataFrame(outcome, "batch_id string, step int, action string, deleted bigint, rows bigint")


@query(
    "B02_delete_batch",
    sql("yr", """SELECT batch_id, count(*) AS n, (SELECT count(*) FROM yr_raw WHERE batch_id = '1997-01') AS deleted
        FROM yr_raw WHERE batch_id <> '1997-01' GROUP BY 1"""),
)
def b02(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse = new_warehouse(spark, "delete")
    load_source(warehouse, SOURCES["yr"](spark, sf_dir), LOADED_AT, ALL)
    deleted = delete_batch(warehouse, "1997-01")
    return _count(warehouse.read("raw"), "batch_id").withColumn("deleted", F.lit(deleted).cast("bigint"))


@query(
    "B03_load_months",
    sql("yr", f"SELECT batch_id, count(*) AS n, {exact_sum_sql('tip_amount')} AS tips, count(tip_amount) AS filled FROM yr_raw GROUP BY 1"),
)
def b03(spark: SparkSession, sf_dir: str) -> DataFrame:
    warehouse, paths = new_warehouse(spark, "months"), month_files(spark, sf_dir, "yr")
    load_months(warehouse, " , ".join(["", *paths, " "]), paths)
    return doubles(
        warehouse.read("raw").groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum("tip_amount").alias("tips"), F.count("tip_amount").alias("filled")
        )
    )


@query("B04_changed_batches", sql("li", f"SELECT DISTINCT batch_id FROM li_raw WHERE {IS_CHANGED}"))
def b04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changed_batches(staged(spark, sf_dir, "li"), stale_clean(spark, sf_dir))


@query(
    "B05_rebuild_list",
    sql("yr", """SELECT batch_id, count(*) AS n FROM yr_clean WHERE batch_id IN ('1996-01', '1999-01') GROUP BY 1"""),
)
def b05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the listed batches are built, although all are new."""
    warehouse = new_warehouse(spark, "listed")
    load_source(warehouse, SOURCES["yr"](spark, sf_dir), LOADED_AT, ALL)
    build_clean(warehouse, " 1999-01,, 1996-01,2030-01 ")
    return _count(trips_of(warehouse.read("clean"), batch_list([" 1996-01", "1999-01", ""])), "batch_id")


_MONTH = "CASE WHEN month_key BETWEEN '199501' AND '200102' THEN month_key ELSE 'default' END"


@query("B06_clean_build", sql("yr", f"SELECT batch_id, {_MONTH} AS pickup_month, row_fingerprint FROM yr_clean"))
def b06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_warehouse(spark, sf_dir).read("clean").select("batch_id", "pickup_month", "row_fingerprint")


@query(
    "B07_quarantine_build",
    sql("yr", """SELECT batch_id, reason_code, count(*) AS n FROM yr_reason WHERE reason_code IS NOT NULL GROUP BY 1, 2"""),
)
def b07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count(built_warehouse(spark, sf_dir).read("quarantine"), "batch_id", "reason_code")


@query(
    "B07_quarantine_changed_only",
    sql("yr", """SELECT batch_id, reason_code, count(*) AS n FROM yr_reason
        WHERE reason_code IS NOT NULL AND batch_id <> '1995-01' GROUP BY 1, 2"""),
)
def b07_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantine kept up batch by batch while batches arrive and one leaves."""
    warehouse = new_warehouse(spark, "quarantine")
    rows = SOURCES["yr"](spark, sf_dir)
    load_source(warehouse, rows.where(F.col("batch_id") < "1999-01"), LOADED_AT, ALL)
    build_quarantine(warehouse, full=False)
    load_source(warehouse, rows.where(F.col("batch_id") > "1995-01"), LOADED_AT, ALL)
    build_quarantine(warehouse, full=False)
    return _count(warehouse.read("quarantine"), "batch_id", "reason_code")


@query(
    "B08_replace_batch",
    sql("yr", f"""SELECT batch_id, {_MONTH} AS pickup_month, count(*) AS n FROM yr_clean
        WHERE batch_id <> '1997-01' OR pickup_ts < TIMESTAMP '1997-04-01' GROUP BY 1, 2"""),
)
def b08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch comes again with three months instead of twelve: the other nine vanish, nothing else moves."""
    warehouse = new_warehouse(spark, "replace")
    rows = SOURCES["yr"](spark, sf_dir)
    load_source(warehouse, rows, LOADED_AT, ALL)
    build_clean(warehouse)
    shorter = rows.where("batch_id = '1997-01' AND tpep_pickup_datetime < timestamp_ntz'1997-04-01'")
    load_source(warehouse, shorter, _LATER, ["1997-01"])
    build_clean(warehouse)
    return _count(warehouse.read("clean"), "batch_id", "pickup_month")


@query(
    "B09_mart_window",
    sql("li", """SELECT given, anchor - to_months(CAST(months - 1 AS INTEGER)) AS start_ts, anchor + INTERVAL 1 MONTH AS end_ts
        FROM (SELECT max(CAST(batch_id || '-01' AS TIMESTAMP)) AS anchor FROM li_raw),
             (VALUES ('2', 2), ('1', 1), ('0', 1), ('-4', 1), ('x', 1), ('14', 14)) AS v(given, months)"""),
)
def b09(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = raw(spark, sf_dir, "li")
    parts = None
    for given in ("2", "1", "0", "-4", "x", "14"):
        part = window_bounds(batches, given).select(F.lit(given).alias("given"), "start_ts", "end_ts")
        parts = part if parts is None else parts.unionAll(part)
    return parts


def _late_batch(spark: SparkSession, sf_dir: str, mart: str) -> Warehouse:
    """A mart built without the last batch, which then arrives and is picked up by the window."""
    warehouse = new_warehouse(spark, "window")
    rows = SOURCES["yr"](spark, sf_dir)
    load_source(warehouse, rows.where(F.col("batch_id") < "2001-01"), LOADED_AT, ALL)
    build_clean(warehouse)
    build_marts(warehouse, full=True, only=[mart])
    load_source(warehouse, rows.where(F.col("batch_id") == "2001-01"), LOADED_AT, ["2001-01"])
    build_clean(warehouse)
    build_marts(warehouse, lookback=2, only=[mart])
    return warehouse


_LATE = "batch_id < '2001-01' OR pickup_ts < TIMESTAMP '2001-02-01'"


@query(
    "B11_mart_slice_replace",
    sql("yr", f"""SELECT CAST(pickup_ts AS DATE) AS trip_date, count(*) AS trips, {exact_sum_sql('total_amount')} AS revenue
        FROM yr_clean WHERE {_LATE} GROUP BY 1"""),
)
def b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window ends with the anchor month: later pickups of the last batch stay out until a full build."""
    return doubles(_late_batch(spark, sf_dir, "daily_revenue").read("daily_revenue").drop("trip_month"))


@query(
    "B11_mart_month_emptied",
    sql("yr", """SELECT CAST(date_trunc('hour', pickup_ts) AS TIMESTAMP) AS pickup_hour, CAST(hour(pickup_ts) AS INTEGER) AS hr, count(*) AS trips
        FROM yr_clean WHERE pickup_ts < (SELECT date_trunc('month', max(pickup_ts)) - INTERVAL 1 MONTH FROM yr_raw) GROUP BY 1, 2"""),
)
def b11_emptied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips of the two newest months of the data turn invalid in a second load; their mart rows go."""
    warehouse = new_warehouse(spark, "emptied")
    rows = source_rows(spark, sf_dir, "yr")
    load_source(warehouse, rows, LOADED_AT, ALL)
    build_clean(warehouse)
    build_marts(warehouse, full=True, only=["hourly_peak"])
    newest = warehouse.read("raw").agg(F.max("tpep_pickup_datetime")).first()[0]
    window = month_window(newest, 2)
    late = F.col("tpep_pickup_datetime") >= ts_literal(window.start)
    refunded = F.when(late, F.lit(-1)).otherwise(F.col("total_amount"))
    load_source(warehouse, rows.withColumn("total_amount", refunded), _LATER, ALL)
    build_clean(warehouse)
    build_mart(warehouse, "hourly_peak", window)
    return warehouse.read("hourly_peak").drop("trip_month")


@query("B12_mart_full_build", sql("yr", f"{DAILY_ZONE_SQL}, strftime(CAST(pickup_ts AS DATE), '%Y%m') AS trip_month FROM yr_clean GROUP BY 1, 2, 8"))
def b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the partial rebuild, a full one brings in every clean trip."""
    warehouse = _late_batch(spark, sf_dir, "daily_zone")
    build_marts(warehouse, full=True, only=["daily_zone"])
    return warehouse.read("daily_zone")


@query(
    "B13_daily_revenue_mart",
    sql("ev", f"""SELECT CAST(pickup_ts AS DATE) AS trip_date, count(*) AS trips, {exact_sum_sql('total_amount')} AS revenue
        FROM ev_clean GROUP BY 1"""),
)
def b13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(built_warehouse(spark, sf_dir, "ev").read("daily_revenue").drop("trip_month"))


@query(
    "B14_hourly_peak_mart",
    sql("ev", """SELECT CAST(date_trunc('hour', pickup_ts) AS TIMESTAMP) AS pickup_hour, CAST(hour(pickup_ts) AS INTEGER) AS hr, count(*) AS trips
        FROM ev_clean GROUP BY 1, 2"""),
)
def b14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_warehouse(spark, sf_dir, "ev").read("hourly_peak").drop("trip_month")


@query("B15_daily_zone_mart", sql("ev", f"{DAILY_ZONE_SQL} FROM ev_clean GROUP BY 1, 2"))
def b15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built_warehouse(spark, sf_dir, "ev").read("daily_zone").drop("trip_month")


@query(
    "B16_end_to_end_run",
    sql("yr", """SELECT 'raw.yellow_trips' AS relation, count(*) AS row_count FROM yr_raw
        UNION ALL SELECT 'stg.stg_yellow_trips', count(*) FROM yr_stg
        UNION ALL SELECT 'clean.clean_yellow_trips', count(*) FROM yr_clean
        UNION ALL SELECT 'quarantine.quarantine_yellow_trips', count(*) FROM yr_reason WHERE reason_code IS NOT NULL
        UNION ALL SELECT 'marts.marts_daily_revenue', count(DISTINCT CAST(pickup_ts AS DATE)) FROM yr_clean
        UNION ALL SELECT 'marts.marts_hourly_peak', count(DISTINCT date_trunc('hour', pickup_ts)) FROM yr_clean"""),
)
def b16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, build, test, audit and check twice; the second time every month is replaced."""
    warehouse, paths = new_warehouse(spark, "run"), month_files(spark, sf_dir, "yr")
    run_all(warehouse, list(paths), paths, skip_audit=False)
    run_all(warehouse, list(paths), paths, replace=True, skip_audit=False)
    return row_counts(warehouse)
